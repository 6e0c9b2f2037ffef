"""SimHash near-duplicates by a self-join of binary tries.

A document's fingerprint has a bit set if over half of its shingle hashes have
it.  Fingerprints within ``budget`` differing bits are linked; a document's class
is what links reach.  Of ``budget + 1`` blocks of bits two linked fingerprints
agree in one at least, so each distinct fingerprint goes to one group for each
block, keyed by that block's value.  Groups of more than ``hot`` fingerprints
are dealt again by the blocks of their remaining bits, which is exact for the
same reason.  Within a group the fingerprints, bits rotated so that the shared
block is first, form a trie; pairs of its nodes are walked down together, adding
up differing bits, and a pair is left once the budget is exceeded or once all
below it is in one class already.  A group returns a forest, never all pairs.
Classes of the whole corpus come from contracting the forests' links.

Cases: null and empty texts have fingerprint zero and are linked like any other;
documents with fewer words than a shingle have one shingle, all their words; rows
with the same doc_id each get a row; further columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

SHINGLE = 3
BUDGET = 3
SEED = 42
#: A group of more fingerprints than this is dealt again.
HOT = 200_000
#: Pairs of trie nodes looked at together; more are put aside.
FRONTIER = 1 << 19


def _shingle_hashes(text: bytes, k: int) -> list[int]:
    found = text.lower().split()  # bytes: A-Z only, and splits at \x20 and \x09-\x0D
    if not found:
        return []
    if len(found) <= k:
        return [xxhash.xxh64_intdigest(b" ".join(found), SEED)]
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    starts, at = [0], 0
    for w in found:
        at += len(w) + 1
        starts.append(at)
    return [digest(joined[a:b - 1], SEED) for a, b in zip(starts, starts[k:])]


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    return int(fingerprints([text], k)[0])


def fingerprints(texts: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """Fingerprints of texts, as unsigned 64-bit integers."""
    out = np.zeros(len(texts), np.uint64)
    lists = [_shingle_hashes(t, k) for t in texts]
    sizes = np.array([len(x) for x in lists], np.int64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat = np.fromiter((h for x in lists for h in x), np.uint64, int(sizes.sum()))
    bits = np.unpackbits(flat.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    begin = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    ones = np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
    packed = np.packbits(2 * ones > sizes[full][:, None], axis=1, bitorder="little")
    out[full] = np.ascontiguousarray(packed).view("<u8").ravel()
    return out


def with_fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (the 64 bits as a long)."""
    base.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in base.text_blocks(batches):
            texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base.signed(fingerprints(texts, k)))], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint long")


# --- the trie ----------------------------------------------------------------

class Classes:
    """Classes of positions under links, each named by its smallest position."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.of[a], self.of[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            low = np.minimum(x, y)
            np.minimum.at(self.of, x, low)
            np.minimum.at(self.of, y, low)
            while not np.array_equal(new := self.of[self.of], self.of):
                self.of = new


def trie_links(values: np.ndarray, groups: np.ndarray, start: int, budget: int = BUDGET) -> np.ndarray:
    """For each position the smallest position of its class.

    values: distinct within a group and sorted by (group, value); those of a
    group agree in their first ``start`` bits.  groups: where each group begins.
    """
    n = len(values)
    classes = Classes(n)
    if n < 2:
        return classes.of
    group_of = np.zeros(n, np.int64)
    group_of[groups[1:]] = 1
    group_of = np.cumsum(group_of)
    for step in (1, 2, 3):  # neighbours in the order, which saves most of the walk in dense groups
        near = (np.bitwise_count(values[step:] ^ values[:-step]) <= budget) & (group_of[step:] == group_of[:-step])
        i = np.flatnonzero(near)
        classes.link(i, i + step)
    ends = np.append(groups[1:], n)
    many = ends - groups > 1
    first = (groups[many], ends[many], groups[many], ends[many], np.zeros(int(many.sum()), np.int64))
    todo = [(start, first)]
    while todo:
        depth, (alo, ahi, blo, bhi, off) = todo.pop()
        while len(alo):
            changes = np.concatenate([[0], np.cumsum(classes.of[1:] != classes.of[:-1])])
            one = (changes[ahi - 1] == changes[alo]) & (changes[bhi - 1] == changes[blo]) & (classes.of[alo] == classes.of[blo])
            small = ((ahi - alo) * (bhi - blo) <= 16) | (depth == 64)
            now = small & ~one
            if now.any():
                _compare(values, classes, alo[now], ahi[now], blo[now], bhi[now], budget)
            rest = ~small & ~one
            alo, ahi, blo, bhi, off = (x[rest] for x in (alo, ahi, blo, bhi, off))
            if not len(alo):
                break
            if len(alo) > FRONTIER:
                half = len(alo) // 2
                todo.append((depth, tuple(x[half:] for x in (alo, ahi, blo, bhi, off))))
                alo, ahi, blo, bhi, off = (x[:half] for x in (alo, ahi, blo, bhi, off))
                continue
            ones = np.concatenate([[0], np.cumsum((values >> np.uint64(63 - depth)) & np.uint64(1)).astype(np.int64)])
            amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
            cross = alo != blo
            pairs = [(alo, amid, blo, bmid, off, np.ones(len(alo), bool)), (amid, ahi, bmid, bhi, off, np.ones(len(alo), bool)), (alo, amid, bmid, bhi, off + 1, np.ones(len(alo), bool)), (amid, ahi, blo, bmid, off + 1, cross)]
            alo, ahi, blo, bhi, off, ok = (np.concatenate(x) for x in zip(*pairs))
            ok &= (off <= budget) & (alo < ahi) & (blo < bhi) & ~((alo == blo) & (ahi - alo < 2))
            alo, ahi, blo, bhi, off = (x[ok] for x in (alo, ahi, blo, bhi, off))
            depth += 1
    return classes.of


def _compare(values: np.ndarray, classes: Classes, alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray, budget: int) -> None:
    """Compare all of each small pair of nodes, some pairs at a time."""
    wide, size = bhi - blo, (ahi - alo) * (bhi - blo)
    for lo in range(0, len(size), 1 << 17):
        some = slice(lo, lo + (1 << 17))
        k = np.repeat(np.arange(len(size))[some], size[some])
        at = np.arange(len(k)) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
        a, b = alo[k] + at // wide[k], blo[k] + at % wide[k]
        near = (a < b) & (np.bitwise_count(values[a] ^ values[b]) <= budget)
        classes.link(a[near], b[near])


def _rotated(v: np.ndarray, bits: int) -> np.ndarray:
    """Rotated left, so that the block that begins after ``bits`` bits is first."""
    return v if not bits else (v << np.uint64(bits)) | (v >> np.uint64(64 - bits))


def _blocks(width: int, budget: int) -> list[tuple[int, int]]:
    """(first bit, bits) of budget + 1 blocks that make up so many bits."""
    cuts = [width * i // (budget + 1) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _bits(value: F.Column, first: int, n: int) -> F.Column:
    return F.shiftrightunsigned(value, 64 - first - n).bitwiseAND(F.lit((1 << n) - 1))


def _turned(value: F.Column, by: int) -> F.Column:
    return value if not by else F.shiftleft(value, by).bitwiseOR(F.shiftrightunsigned(value, 64 - by))


LINKS = "fingerprint long, other long"


def links(distinct: DataFrame, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """(fingerprint, other): links that connect what is within the budget."""
    spark = base.prepare(distinct.sparkSession)
    blocks = _blocks(64, budget)
    f = F.col("fingerprint")
    # key: number of the block and its value; turned: the bits with that block first
    dealt = distinct.select(f, F.inline(F.array(*[F.struct(F.lit(i).alias("block"), _bits(f, a, n).alias("value"), _turned(f, a).alias("turned"), F.lit(n).alias("shared")) for i, (a, n) in enumerate(blocks)])))
    sizes = dealt.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n"))
    # stored, so that a hot group's side of the join can be split
    groups = base.stored(sizes.where("n > 1").withColumn("is_hot", F.col("n") > hot).drop("n"), "groups")
    kept = dealt.join(groups, ["block", "value"])
    plain = kept.where(~F.col("is_hot")).select("block", F.col("value").alias("key"), "turned", "shared", "fingerprint")
    again = []
    for i, (_, n) in enumerate(blocks):
        t = F.col("turned")
        # the remaining bits in blocks again; the one that agrees comes right after the first block
        sub = [F.struct(F.lit(len(blocks) * (i + 1) + j).alias("block"), F.xxhash64("value", _bits(t, n + a, m)).alias("key"), t.alias("turned"), F.lit(n).alias("shared")) for j, (a, m) in enumerate(_blocks(64 - n, budget))]
        again.append(kept.where(F.col("is_hot") & (F.col("block") == i)).select("fingerprint", F.inline(F.array(*sub))))
    for more in again:
        plain = plain.unionByName(more)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in base.whole_groups(frames, ["block", "key"], 1 << 20):
            yield _linked(f, budget)

    return plain.repartition(base.parts(spark), "block", "key").sortWithinPartitions("block", "key").mapInPandas(run, LINKS)


def _linked(f: pd.DataFrame, budget: int) -> pd.DataFrame:
    if not len(f):
        return pd.DataFrame({"fingerprint": np.zeros(0, "i8"), "other": np.zeros(0, "i8")})
    block, key = f["block"].to_numpy(), f["key"].to_numpy()
    turned, shared = f["turned"].to_numpy().view(np.uint64), f["shared"].to_numpy()
    order = np.lexsort((turned, key, block))
    block, key, turned, prints = block[order], key[order], turned[order], f["fingerprint"].to_numpy()[order]
    new = np.concatenate([[True], (block[1:] != block[:-1]) | (key[1:] != key[:-1])])
    root = trie_links(turned, np.flatnonzero(new), int(shared.min()), budget)
    i = np.flatnonzero(root != np.arange(len(root)))
    return pd.DataFrame({"fingerprint": prints[i], "other": prints[root[i]]})


# --- classes of the whole corpus ------------------------------------------------

def classes(edges: DataFrame) -> DataFrame:
    """(node, class): connected components by contraction.

    Each round a node joins the first of itself and its neighbours in an order
    that a hash makes anew, and links within a joined group go away.  About half
    of the nodes of even a long chain are first of some neighbourhood, so the
    links shrink geometrically.
    """
    rounds: list[DataFrame] = []
    left = base.stored(edges.toDF("a", "b").where("a <> b").distinct(), "links")
    while not left.isEmpty():
        place = lambda c: F.struct(F.xxhash64(c, F.lit(len(rounds))).alias("h"), F.col(c).alias("node"))  # noqa: E731, B023
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).union(left.select("b", "a"))
        to = base.stored(both.groupBy("node").agg(F.least(place("node"), F.min(place("other")))["node"].alias("class")), "class")
        rounds.append(to)
        a, b = to.toDF("a", "ca"), to.toDF("b", "cb")
        left = base.stored(left.join(a, "a").join(b, "b").where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "links")
    if not rounds:
        return left.toDF("node", "class")
    out = rounds[0]
    for later in rounds[1:]:
        out = out.join(later.toDF("class", "later"), "class", "left").select("node", F.coalesce("later", "class").alias("class"))
    return out


def components(docs: DataFrame, *, shingle: int = SHINGLE, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (long), component_id: the smallest doc_id reachable by links."""
    prints = base.stored(with_fingerprints(docs, shingle), "fingerprints")
    distinct = base.stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "distinct")
    of = classes(links(distinct.select("fingerprint"), budget, hot)).toDF("fingerprint", "class")
    known = distinct.join(of, "fingerprint", "left").withColumn("class", F.coalesce("class", "fingerprint"))
    known = base.stored(known, "known")
    least = base.stored(known.groupBy("class").agg(F.min("first").alias("component_id")), "least")
    return prints.join(known.join(least, "class").select("fingerprint", "component_id"), "fingerprint").select("doc_id", "fingerprint", "component_id")


def first_rows(prints: DataFrame, of: DataFrame) -> DataFrame:
    """(doc_id, text_key) of each class's first row: the smallest doc_id, null last, then the smallest text_key.

    prints: doc_id, text_key, fingerprint; of: fingerprint, class (others are classes of their own).
    """
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))
    first = prints.groupBy("fingerprint").agg(least.alias("first")).join(of, "fingerprint", "left")
    one = first.groupBy(F.coalesce("class", "fingerprint").alias("class")).agg(F.min("first").alias("first"))
    return one.select("first.doc_id", "first.text_key")
