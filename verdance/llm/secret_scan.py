"""Secret scanning with a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived:
every text that matches must satisfy it.  The index holds, for the trigrams that
some query asks for, postings (trigram, document) of the lower-cased texts; the
postings of each conjunction are intersected, and only documents that some
conjunction leaves are verified by the expression itself.  A rule whose
expression has no mandatory trigram is run over every text.

Everything is SQL functions.  Where matches begin follows from the pieces
between them: the text split at matches, and the matches, in turn.

Cases: a null text is empty; rows with equal doc_ids are told apart by a hash of
their text, and equal rows each get a row; positions are code points, ends
exclusive; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base

_parser = re._parser  # the standard library's parse trees


@dataclass(frozen=True)
class Rule:
    """A kind of secret. group: what must have at least ``least`` characters (0: the whole match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False
    #: What every text with a long enough match also has; lets most texts be passed over.
    sign: str = ""

    @property
    def java(self) -> str:
        return f"(?i){self.pattern}" if self.any_case else self.pattern


#: The first three rules' expressions and lengths are given; the others are public key formats.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32, sign="[0-9a-f]{32}"),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]+", 0, 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 20),
)
RULES = BASE_RULES + MORE_RULES
MASK = "[SECRET]"

# --- trigram queries -----------------------------------------------------------

#: Sets of strings or conjunctions beyond this size are given up for weaker queries.
MOST = 64
Query = frozenset[frozenset[str]]  # any of these sets of trigrams must be there in full
ALWAYS: Query = frozenset([frozenset()])


def _reduced(q: set[frozenset[str]]) -> Query:
    """Without conjunctions that others imply; too many become no constraint."""
    out = frozenset(x for x in q if not any(y < x for y in q))
    return out if len(out) <= MOST else ALWAYS


def _both(a: Query, b: Query) -> Query:
    return _reduced({x | y for x, y in product(a, b)}) if len(a) * len(b) <= MOST * MOST else a


def _of_strings(strings: set[str]) -> Query:
    return _reduced({frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings})


def _item(op: object, value: object) -> tuple[set[str] | None, Query]:
    """All strings that a part of an expression matches, if few, and its query."""
    name = str(op)
    if name == "LITERAL":
        return {chr(value).lower()}, ALWAYS
    if name == "IN":
        chars: set[str] = set()
        for kind, x in value:
            if str(kind) == "LITERAL":
                chars.add(chr(x).lower())
            elif str(kind) == "RANGE" and x[1] - x[0] < MOST:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, ALWAYS
        return (chars, ALWAYS) if len(chars) <= 8 else (None, ALWAYS)
    if name == "SUBPATTERN":
        return _sequence(value[3])
    if name == "BRANCH":
        each = [_sequence(x) for x in value[1]]
        strings = [x for x, _ in each]
        if all(x is not None for x in strings) and sum(map(len, strings)) <= MOST:
            return set().union(*strings), ALWAYS
        return None, _reduced(set().union(*(_both(q, _of_strings(x)) if x is not None else q for x, q in each)))
    if name in ("MAX_REPEAT", "MIN_REPEAT"):
        low, high, inner = value
        strings, query = _sequence(inner)
        if strings is not None and (low, high) == (0, 1):
            return strings | {""}, ALWAYS
        if strings is not None and low == high == 1:
            return strings, ALWAYS
        if low == 0:
            return None, ALWAYS
        return None, query if strings is None else _of_strings(strings)
    return None, ALWAYS


def _sequence(items: object) -> tuple[set[str] | None, Query]:
    run, query, exact = {""}, ALWAYS, True
    for op, value in items:
        strings, q = _item(op, value)
        if strings is not None and len(run) * len(strings) <= MOST:
            run = {a + b for a, b in product(run, strings)}
            continue
        query = _both(_both(query, _of_strings(run)), q)
        if strings is None:
            run = {""}
        else:
            run = strings
        exact = False
    return (run, ALWAYS) if exact else (None, _both(query, _of_strings(run)))


def trigram_query(pattern: str) -> Query:
    """The query of an expression, on lower-cased text; ALWAYS if it has none."""
    strings, query = _sequence(_parser.parse(pattern))
    return query if strings is None else _of_strings(strings)


# --- the index -------------------------------------------------------------------

def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram number, doc_id, text_key) for each of the trigrams that a text has."""
    low = docs.select("doc_id", base.text_key().alias("text_key"), F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    there = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]))
    return low.select(F.explode(there).alias("trigram"), "doc_id", "text_key")


def candidates(index: DataFrame, trigrams: list[str], queries: dict[str, Query]) -> DataFrame:
    """doc_id, text_key and, for each rule with a query, whether the text may match."""
    number = {t: i for i, t in enumerate(trigrams)}
    words = -(-len(trigrams) // 62)
    bit = F.expr("shiftleft(1L, cast(pmod(trigram, 62) as int))")
    one = lambda j: F.bit_or(F.when(F.floor(F.col("trigram") / 62) == j, bit).otherwise(F.lit(0).cast("long")))
    have = index.groupBy("doc_id", "text_key").agg(*[one(j).alias(f"have{j}") for j in range(words)])

    def holds(conjunction: frozenset[str]) -> Column:
        want = [0] * words
        for t in conjunction:
            want[number[t] // 62] |= 1 << number[t] % 62
        return reduce(lambda a, b: a & b, [F.col(f"have{j}").bitwiseAND(F.lit(x).cast("long")) == F.lit(x).cast("long") for j, x in enumerate(want) if x])

    flags = {k: reduce(lambda a, b: a | b, [holds(c) for c in q]) for k, q in queries.items()}
    out = have.select("doc_id", "text_key", *[c.alias(f"may_{k}") for k, c in flags.items()])
    return out.where(reduce(lambda a, b: a | b, [F.col(f"may_{k}") for k in flags])) if flags else out


def _spans(rule: Rule, order: int) -> Column:
    """array<struct<start, kind, end, name>> of a rule's matches that are long enough."""
    matches = F.regexp_extract_all("t", F.lit(rule.java), F.lit(0))
    held = F.regexp_extract_all("t", F.lit(rule.java), F.lit(rule.group))
    between = F.transform(F.split("t", rule.java, -1), lambda x: F.length(x))
    # what stands before each match, its length, and that of what counts
    each = F.arrays_zip(between.alias("a"), F.transform(matches, lambda x: F.length(x)).alias("b"), F.transform(held, lambda x: F.length(x)).alias("c"))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int,name:string>>").alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["a"]
        end = begin + F.coalesce(x["b"], F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(order).alias("kind"), end.alias("end"), F.lit(rule.kind).alias("name"))
        return F.struct(end.alias("at"), F.when(x["c"] >= rule.least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(each, first, add, lambda acc: acc["spans"])


def _scanned(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Whole rows as __row, and their spans as __spans."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) != ALWAYS}
    trigrams = sorted(set().union(*(c for q in queries.values() for c in q)))
    keyed = docs.select(base.whole_row(docs), "doc_id", base.text_key().alias("text_key"), F.coalesce("text", F.lit("")).alias("t"))
    if trigrams:
        may = candidates(base.stored(postings(docs, trigrams), "postings"), trigrams, queries)
        may = may.withColumnsRenamed({"doc_id": "its_id", "text_key": "its_key"})
        keyed = keyed.join(may, F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("text_key") == F.col("its_key")), "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int,name:string>>")
    found = []
    for i, r in enumerate(rules):
        test = F.coalesce(F.col(f"may_{r.kind}"), F.lit(False)) if r.kind in queries else F.lit(True)
        if r.sign:
            test = test & F.rlike("t", F.lit(r.sign))
        found.append(F.when(test, _spans(r, i)).otherwise(none))
    return keyed.select("__row", F.array_sort(F.concat(*found)).alias("__spans"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs with spans: array of (start, kind number, end, name), by start and then rule order.

    All columns of docs are kept, but for one that is called spans.
    """
    return _scanned(docs, rules).select(*[c for name, c in base.columns_of(docs) if name != "spans"], F.col("__spans").alias("spans"))


def masked(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = MASK) -> DataFrame:
    """The rows of docs, with all columns, and each stretch of their texts that holds a secret replaced by the mask."""
    text = F.col("__row").getField("text")
    covered = F.when(F.size("__spans") > 0, _covered(text, F.col("__spans"), mask)).otherwise(text)
    return _scanned(docs, rules).select(*[covered.alias("text") if name == "text" else c for name, c in base.columns_of(docs)])


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count(kind: int) -> Column:
    return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")


def _covered(text: Column, spans: Column, mask: str) -> Column:
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(acc: Column, x: Column) -> Column:
        # spans of several rules may overlap: only what lies beyond the last end is new
        kept = F.substring(text, acc["at"] + 1, x["start"] - acc["at"])
        apart = F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["parts"], F.array(kept, F.lit(mask))).alias("parts"))
        over = F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["parts"].alias("parts"))
        return F.when(x["start"] >= acc["at"], apart).otherwise(over)

    return F.aggregate(spans, first, add, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))))


def redacted(found: DataFrame, mask: str = MASK) -> DataFrame:
    """The texts of scan()'s rows with each stretch that spans cover replaced by the mask."""
    return found.withColumn("text", F.when(F.size("spans") > 0, _covered(F.col("text"), F.col("spans"), mask)).otherwise(F.col("text"))).drop("spans")
