"""Benchmark decontamination by template canonicalisation.

Texts become sequences of tokens: words without marks at their ends, in lower
case.  In the template of a text, numbers, quantities, units and names (words in
capitals within a sentence) are typed placeholders.  A unit is a known one, or any
token of up to two letters, that follows a number.  Windows of five template
tokens are hash-joined with those of the benchmark's items.  Where enough of an
item's windows are in a document, its slots are compared: nearly all must agree
with one value of the document for each value of the item and the other way round,
which tells a re-parameterised question from a text that merely has the same form.
Windows of the tokens themselves are joined too, so a verbatim passage is found
however its names and numbers are written.

Only an item's rarest windows are looked up; of these at least one must be there if
the item is, so phrases that many items share make no candidates.  Tasks drop the
documents' windows that no item asks for, by a bit array of fixed size, before the
join; documents with others, few against the corpus, are stored with these windows,
joined with the items by them, and compared with each item found.  Windows of
placeholders with fewer than two words between them are left out of templates.

Two things have further templates of their own.  In the second, words in capitals
that begin a sentence are names too.  Where windows with fewer than two words have
been left out, a template has them all, but then every slot must agree, in both
directions, and at least two different words must be opposite each other.

Cases: null texts have no tokens and match nothing; items with fewer tokens than
a window are one shorter window; an empty benchmark matches nothing; every row of
the benchmark is an item of its own and every row of documents a document of its
own, so repeated rows, and others with equal or null ids, each match; further
columns are ignored by ``matches`` and kept by ``clean``; a null item_id or doc_id
is carried along.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import base

WINDOW = 5
#: Share of an item's windows that a document must have.
SIMILARITY = 0.8
#: Share of slots that must agree with the item's values, one for one.
CONSISTENT = 0.8
#: Bytes of items' texts that a document is compared with together.
BLOCK_BYTES = 4 << 20
#: Bits of the array that tells which windows items ask for; at most an eighth of it in bytes is broadcast.
FILTER_BITS = 1 << 26

#: Number words and units of measure of four languages, in lower case.
NUMBER_WORDS = """
zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion
null zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend million
zéro deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille
cero dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien mil
""".split()
UNITS = """
mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent dollar dollars cent cents euro euros degree degrees mph kmh kph hz khz mhz ghz w kw v volt volts watt watts j joule joules n newton newtons pa
sekunde sekunden stunde stunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren gramm kilogramm pfund tonne tonnen prozent grad meile meilen
mètre mètres kilomètre kilomètres gramme grammes seconde secondes heure heures jour jours semaine semaines mois an ans année années tonnes degré degrés
metro metros kilómetro kilómetros gramo gramos kilo kilos segundo segundos minuto minutos hora horas día días semana semanas mes meses año años grado grados
""".split()
#: Letters of a token that is a unit by its place after a number alone.
UNIT_LETTERS = 2

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 58, 63]] = True  # line end ! . : ?
WORD, NUMBER, QUANTITY, UNIT, NAME = range(5)


def _names(words: list[str]) -> np.ndarray:
    buf = np.frombuffer(" ".join(words).encode(), np.uint8)
    start, stop, _ = base.words(buf, np.array([0, len(buf)]))
    return np.sort(base.word_hashes(buf, start, stop))


_NUMBER_WORDS, _UNITS = _names(NUMBER_WORDS), _names(UNITS)
_PARTS = {w.encode() for w in [*NUMBER_WORDS, "and"]}
_PLACE = base.mix(np.arange(1, 6, dtype=np.uint64))


def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    i = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[i] == values


def _upto(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags)])


def _hyphenated(low: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Tokens that are number words with hyphens between them, as one number each."""
    out = np.zeros(len(start), bool)
    hyphens = _upto(low == 45)
    for i in np.flatnonzero(hyphens[stop] > hyphens[start]).tolist():
        parts = low[start[i]:stop[i]].tobytes().split(b"-")
        out[i] = all(p in _PARTS for p in parts) and parts != [b"and"] * len(parts)
    return out


@dataclass
class Tokens:
    """Tokens of texts: their names, the template's names, their kinds; off: the texts' offsets."""

    names: np.ndarray
    template: np.ndarray
    kind: np.ndarray
    off: np.ndarray
    template_2: np.ndarray  # the same where words that begin sentences can be names
    kind_2: np.ndarray


def tokens(buf: np.ndarray, off: np.ndarray) -> Tokens:
    start, stop, _ = base.words(buf, off)
    solid = np.flatnonzero(~_PUNCTUATION[buf])
    if not len(solid):
        start = stop = np.zeros(0, np.int64)
    else:  # without the marks at both ends
        lo, hi = np.searchsorted(solid, start), np.searchsorted(solid, stop)
        keep = lo < hi  # words of marks alone are no tokens
        start, stop = solid[lo[keep]], solid[hi[keep] - 1] + 1
    low = base.lowered(buf)
    names = base.word_hashes(low, start, stop)
    digits, letters, stops = _upto(_DIGIT[buf]), _upto(_LETTER[buf]), _upto(_STOP[buf])
    n_digits, n_letters = digits[stop] - digits[start], letters[stop] - letters[start]
    first = buf[start] if len(start) else np.zeros(0, np.uint8)
    second = buf[np.minimum(start + 1, len(buf) - 1)] if len(start) else first
    at = np.searchsorted(start, off)
    begins = np.zeros(len(start), bool)
    begins[at[:-1][at[:-1] < at[1:]]] = True
    after = np.ones(len(start), bool)
    after[1:] = stops[start[1:]] > stops[stop[:-1]]
    capital = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    kind = np.zeros(len(start), np.int8)
    kind[capital & ~begins & ~after] = NAME
    kind_2 = np.where(capital, np.int8(NAME), kind)
    number = ((n_digits > 0) & (n_letters == 0)) | _in(names, _NUMBER_WORDS) | _hyphenated(low, start, stop)
    quantity = (n_digits > 0) & (n_letters > 0) & _DIGIT[first]
    unit = _in(names, _UNITS) | ((n_digits == 0) & (n_letters == stop - start) & (stop - start <= UNIT_LETTERS))
    unit[:1] = False
    unit[1:] &= number[:-1] & ~begins[1:]
    for k in (kind, kind_2):
        k[number], k[quantity], k[unit] = NUMBER, QUANTITY, UNIT
    return Tokens(names, np.where(kind == WORD, names, _PLACE[kind]), kind, at, np.where(kind_2 == WORD, names, _PLACE[kind_2]), kind_2)


@dataclass
class Item:
    """An item of the benchmark in one of the two channels."""

    item_id: int | None
    windows: np.ndarray  # hashes
    places: np.ndarray  # of each window: its first token
    values: np.ndarray  # names of all tokens
    kind: np.ndarray
    wide: int
    needed: int
    strict: bool  # all slots agree, in both directions
    bare: np.ndarray  # windows of placeholders alone, which many texts have: looked up last


#: Channels: the tokens, the template, the second one, and both with windows of few words.
TOKENS, TEMPLATE, TEMPLATE_2, SPARSE, SPARSE_2 = range(5)


def _sequences(t: Tokens) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Channel, names and kinds."""
    return [(TOKENS, t.names, t.kind), (TEMPLATE, t.template, t.kind), (TEMPLATE_2, t.template_2, t.kind_2), (SPARSE, t.template, t.kind), (SPARSE_2, t.template_2, t.kind_2)]


@dataclass
class Index:
    """Items in their channels and widths, by the row that they come from."""

    rows: list[tuple[int | None, list[tuple[int, Item]]]] = field(default_factory=list)


def channels(item_id: int | None, text: str | None, window: int = WINDOW, similarity: float = SIMILARITY) -> list[tuple[int, Item]]:
    """The item in each channel that can find it."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    t = tokens(data, np.array([0, len(data)]))
    wide = min(window, len(t.names))
    out: list[tuple[int, Item]] = []
    for channel, names, kind in _sequences(t) if wide else ():
        if channel != TOKENS and not (kind != WORD).any():
            continue  # nothing that the first channel doesn't find
        if channel in (TEMPLATE_2, SPARSE_2) and (t.kind_2 == t.kind).all():
            continue  # nothing that the first template doesn't find
        hashes = base.RangeHash(names).rolling(wide)
        words = _upto(kind == WORD)
        n_words = words[wide:] - words[:-wide]
        dense = n_words >= min(2, wide)
        strict = channel in (SPARSE, SPARSE_2)
        if strict and (dense.all() or len(np.unique(t.names[kind == WORD])) < 2):
            continue
        use = np.flatnonzero(dense) if channel in (TEMPLATE, TEMPLATE_2) else np.arange(len(hashes))
        if len(use):
            different = len(np.unique(hashes[use]))
            out.append((channel, Item(item_id, hashes[use], use, t.names, kind, wide, int(np.ceil(similarity * different - 1e-9)), strict, strict & (n_words[use] == 0))))
    return out


def index(rows: list[tuple[int | None, str | None]], window: int = WINDOW, similarity: float = SIMILARITY) -> Index:
    return Index([(item_id, channels(item_id, text, window, similarity)) for item_id, text in rows])


@dataclass
class Match:
    item_id: int | None
    n_windows: int
    n_found: int
    slots: int
    changed: int
    kind: str


def _aligned(x: Item, hashes: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Different windows found; a token of the item and the document's opposite, along the commonest offset."""
    order = np.argsort(hashes, kind="stable")
    lo = np.searchsorted(hashes, x.windows, "left", sorter=order)
    hi = np.searchsorted(hashes, x.windows, "right", sorter=order)
    there = hi > lo
    found = len(np.unique(x.windows[there]))
    if found < x.needed:
        return found, np.zeros(0, int), np.zeros(0, int)
    size = (hi - lo)[there]
    w = np.repeat(x.places[there], size)
    p = order[np.repeat(lo[there], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
    shifts, counts = np.unique(p - w, return_counts=True)
    far = np.abs(p - w - shifts[np.argmax(counts)])
    best = np.lexsort((far, w))
    first = np.concatenate([[True], np.diff(w[best]) > 0])
    w, p = w[best][first], p[best][first]
    step = np.arange(x.wide)
    pairs = np.unique(np.stack([(w[:, None] + step).ravel(), (p[:, None] + step).ravel()], 1), axis=0)
    return found, pairs[:, 0], pairs[:, 1]


def _verdict(x: Item, channel: int, hashes: np.ndarray, names: np.ndarray) -> Match | None:
    found, a, b = _aligned(x, hashes)
    if found < x.needed:
        return None
    slot = x.kind[a] != WORD
    mine, theirs = x.values[a[slot]].tolist(), names[b[slot]].tolist()
    changed = sum(u != v for u, v in zip(mine, theirs))
    if x.strict and (len(set(mine)) != len(pairs := set(zip(mine, theirs))) or len(set(theirs)) != len(pairs) or len(np.unique(x.values[a[~slot]])) < 2):
        return None
    if channel != TOKENS and mine:
        for one, other in ((mine, theirs), (theirs, mine)):
            votes: dict[int, Counter] = defaultdict(Counter)
            for u, v in zip(one, other):
                votes[u][v] += 1
            if sum(max(c.values()) for c in votes.values()) < CONSISTENT * len(mine):
                return None
    kind = "verbatim" if not changed else "reparameterised"
    return Match(x.item_id, len(np.unique(x.windows)), found, len(mine), changed, kind)


def found_in(batch_tokens: Tokens, known: Index) -> dict[int, list[Match]]:
    """Matches of each text that has any: at most one for each row of the index, in the first channel that finds it."""
    t, out, rolled = batch_tokens, defaultdict(list), {}
    sequences = {channel: names for channel, names, _ in _sequences(t)}
    for d, (lo, hi) in enumerate(zip(t.off[:-1].tolist(), t.off[1:].tolist())):
        for _, items in known.rows:
            for channel, x in items:
                if (channel, x.wide) not in rolled:
                    rolled[channel, x.wide] = base.RangeHash(sequences[channel]).rolling(x.wide)
                m = _verdict(x, channel, rolled[channel, x.wide][lo:max(lo, hi - x.wide + 1)], t.names[lo:hi])
                if m is not None:
                    out[d].append(m)
                    break
    return dict(out)


# --- the join ----------------------------------------------------------------------

ASKED = "item long, channel int, wide int, h long, bare boolean, spare int"


def _items(benchmark: DataFrame) -> DataFrame:
    """item (its row's own number), item_id, item_text."""
    rows = benchmark.select("item_id", F.col("text").alias("item_text")).where("item_text is not null")
    return base.stored(rows.withColumn("item", F.monotonically_increasing_id()), "items")


def _asked(items: DataFrame, window: int, similarity: float) -> DataFrame:
    """(channel, wide, h, item): each item's rarest windows, of which a document that holds it has one at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in base.text_blocks(batches, "item_text"):
            for item, text in zip(batch.column("item").to_pylist(), batch.column("item_text").to_pylist()):
                for channel, x in channels(item, text, window, similarity):
                    h, first = np.unique(x.windows, return_index=True)
                    same = {"item": item, "channel": channel, "wide": x.wide, "spare": len(h) - x.needed + 1}
                    cols = [np.full(len(h), same[k]) if k in same else base.signed(h) if k == "h" else x.bare[first] for k in ("item", "channel", "wide", "h", "bare", "spare")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int32()))], names=["item", "channel", "wide", "h", "bare", "spare"])

    all_ = base.stored(items.mapInArrow(run, ASKED), "windows")
    often = base.stored(all_.groupBy("channel", "wide", "h").agg(F.count(F.lit(1)).alias("often")), "often")
    rank = F.row_number().over(Window.partitionBy("item", "channel").orderBy("bare", "often", "h"))
    return all_.join(often, ["channel", "wide", "h"]).withColumn("rank", rank).where("rank <= spare").select("channel", "wide", "h", "item")


def _bits(asked: DataFrame, bits: int) -> np.ndarray:
    """The bit array of windows that are asked for, a byte for eight."""
    place = F.pmod("h", F.lit(bits))
    found = asked.groupBy(F.shiftright(place, 3).alias("byte")).agg(F.bit_or(F.expr(f"shiftleft(1, cast(pmod(h, {bits}) % 8 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 8, np.uint8)
    out[np.asarray(found.column("byte"))] = np.asarray(found.column("bits"))
    return out


HITS = "doc_id long, text string, hits array<struct<channel:int,wide:int,h:long>>"
_HIT = pa.struct([("channel", pa.int32()), ("wide", pa.int32()), ("h", pa.int64())])


def _with_hits(docs: DataFrame, asked: DataFrame, bits: int) -> DataFrame:
    """doc (its row's own number), doc_id, text, hits: documents with windows that items may ask for."""
    spark = docs.sparkSession
    kinds = sorted(map(tuple, asked.select("channel", "wide").distinct().collect()))  # at most channels x widths
    known = spark.sparkContext.broadcast(_bits(asked, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = known.value
        for batch in base.text_blocks(batches):
            t = tokens(*base.flat(batch.column("text")))
            sequences = {channel: names for channel, names, _ in _sequences(t)}
            found: dict[int, list[dict]] = defaultdict(list)
            for channel, wide in kinds:
                hashes = base.RangeHash(sequences[channel]).rolling(wide)
                place = hashes & np.uint64(bits - 1)
                at = np.flatnonzero((held[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1)
                doc = base.owner(t.off, at)
                whole = at + wide <= t.off[doc + 1]
                for d, h in np.unique(np.stack([doc[whole], base.signed(hashes[at[whole]])], 1), axis=0).tolist():
                    found[d].append({"channel": channel, "wide": wide, "h": h})
            if found:
                some = batch.take(pa.array(sorted(found), pa.int64()))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("text"), pa.array([found[d] for d in sorted(found)], pa.list_(_HIT))], names=["doc_id", "text", "hits"])

    hits = docs.select("doc_id", "text").mapInArrow(run, HITS)
    return base.stored(hits.withColumn("doc", F.monotonically_increasing_id()), "hits")


MATCHES = "doc_id long, item_id long, n_windows int, n_found int, slots int, slots_changed int, kind string"


def _matched(docs: DataFrame, benchmark: DataFrame, window: int, similarity: float, block_bytes: int, bits: int) -> DataFrame:
    """text_key and the columns of MATCHES."""
    spark = base.prepare(docs.sparkSession)
    items = _items(benchmark)
    asked = base.stored(_asked(items, window, similarity), "asked")
    found = _with_hits(docs, asked, bits)
    hits = found.select("doc", F.inline("hits"))
    # stored, so that a passage of very many documents is a side of the joins that can be split
    pairs = base.stored(hits.join(asked, ["channel", "wide", "h"]).select("doc", "item").distinct(), "pairs")
    theirs = pairs.join(items, "item")
    before = F.sum(F.octet_length("item_text")).over(Window.partitionBy("doc").orderBy("item")) - F.octet_length("item_text")
    lists = theirs.withColumn("chunk", F.floor(before / block_bytes)).groupBy("doc", "chunk").agg(F.sort_array(F.collect_list(F.struct("item", "item_id", "item_text"))).alias("items"))
    rows = found.select("doc", "doc_id", "text").join(base.stored(lists, "lists"), "doc").select("doc_id", "text", "items", base.text_key().alias("text_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[tuple[int, Item]]] = {}  # items met lately
        for batch in base.text_blocks(batches):
            out = []
            for doc_id, text, asked_for, key in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "items", "text_key")]):
                data = np.frombuffer(text.encode(), np.uint8)
                for x in asked_for:
                    if x["item_text"] not in known:
                        if len(known) > 4096:
                            known.clear()
                        known[x["item_text"]] = channels(None, x["item_text"], window, similarity)
                mine = Index([(i, known.get(x["item_text"]) or channels(None, x["item_text"], window, similarity)) for i, x in enumerate(asked_for)])
                t = tokens(data, np.array([0, len(data)]))
                for x, row in zip(asked_for, mine.rows):
                    for m in found_in(t, Index([row])).get(0, ()):
                        out.append({"text_key": key, "doc_id": doc_id, "item_id": x["item_id"], "n_windows": m.n_windows, "n_found": m.n_found, "slots": m.slots, "slots_changed": m.changed, "kind": m.kind})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("text_key", pa.int64()), ("doc_id", pa.int64()), ("item_id", pa.int64()), *[(c, pa.int32()) for c in ("n_windows", "n_found", "slots", "slots_changed")], ("kind", pa.string())]))

    return rows.repartition(base.parts(spark)).mapInArrow(run, "text_key long, " + MATCHES)


def matches(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES, filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row for each document and item that is in it."""
    return _matched(docs, benchmark, window, similarity, block_bytes, filter_bits).drop("text_key")


def clean(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The documents, with all columns, that have no item of the benchmark in them."""
    bad = _matched(docs, benchmark, window, similarity, block_bytes, filter_bits).select(F.col("doc_id").alias("its_id"), F.col("text_key").alias("its_key")).distinct()
    rows = docs.select(base.whole_row(docs), "doc_id", base.text_key().alias("text_key"))
    kept = rows.join(base.stored(bad, "bad"), F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("text_key") == F.col("its_key")), "left_anti")
    return kept.select(*[c for _, c in base.columns_of(docs)])
