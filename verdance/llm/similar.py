"""Near-duplicates by the Jaccard similarity of five-word shingles, beside SimHash.

Texts with sets of shingles at least ``SIMILARITY`` alike are linked.  Candidates
share a bucket: each text has BANDS keys, each of ROWS least hashes of its
shingles, and two texts at the bound share none with probability
(1 - 0.8**4)**16, about 0.0002.  Only texts of buckets in which classes differ
send their sets; these are compared exactly, and within a bucket only across
classes that nothing links so far, so what comes back is a forest.  Buckets of
more than HOT texts are cut at random; the parts' links make most of their texts
one class, and in those whose classes still differ each block of the smaller
classes meets every block of the bucket, so no link is lost and no task gets
more than about 2 * HOT texts.  Only the texts outside a bucket's largest class
take time by the square of their number.

Words are split and put in lower case as for the fingerprints; a text with fewer
than five words is one shingle; null and empty texts have none and are linked by
nothing here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base, simhash

WORDS = 5
BANDS, ROWS = 16, 4
_FACTORS = base.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
#: Rows of buckets looked at together, in whole buckets.
TOGETHER = 256
#: Texts of one bucket that a task compares with each other; larger buckets are cut.
HOT = 1024


def shingles(buf: np.ndarray, off: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' shingles, and the texts' offsets in them."""
    low = base.lowered(buf)
    start, stop, at = base.words(low, off)
    names = base.RangeHash(base.word_hashes(low, start, stop))
    n = np.diff(at)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    out = np.concatenate([[0], np.cumsum(count)])
    lo = np.arange(out[-1]) + np.repeat(at[:-1] - out[:-1], count)
    return names(lo, np.minimum(lo + k, np.repeat(at[1:], count))), out


def bucket_keys(hashes: np.ndarray, off: np.ndarray) -> list[np.ndarray | None]:
    """BANDS keys of each text; None without shingles."""
    full = np.flatnonzero(np.diff(off))
    out: list[np.ndarray | None] = [None] * (len(off) - 1)
    if len(full):
        keys = np.zeros((len(full), BANDS), np.uint64)
        for i, factor in enumerate(_FACTORS):
            least = np.minimum.reduceat(hashes * factor, off[full])
            keys[:, i // ROWS] = base.mix(keys[:, i // ROWS] + least + np.uint64(i))
        for i, x in zip(full.tolist(), base.signed(keys)):
            out[i] = x
    return out


def _signed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, fingerprint, keys (of buckets)."""
    base.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in base.text_blocks(batches):
            texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            keys = bucket_keys(*shingles(*base.flat(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(base.signed(simhash.fingerprints(texts))), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "text_key", "fingerprint", "keys"])

    return docs.select("doc_id", base.text_key().alias("text_key"), "text").mapInArrow(run, "doc_id long, text_key long, fingerprint long, keys array<long>")


def _sets(texts: DataFrame) -> DataFrame:
    """text_key, hashes: different shingles, eight bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in base.text_blocks(batches):
            hashes, off = shingles(*base.flat(batch.column("text")))
            sets = [np.unique(hashes[a:b]).tobytes() for a, b in zip(off, off[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), pa.array(sets, pa.binary())], names=["text_key", "hashes"])

    return texts.select("text_key", "text").mapInArrow(run, "text_key long, hashes binary")


def alike(sets: list[np.ndarray], classes: np.ndarray) -> list[tuple[int, int]]:
    """A forest of links between classes that have sets with a similarity of 0.8 at least."""
    size = np.array([len(x) for x in sets])
    _, of = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)[np.argsort(of, kind="stable")]
    length = np.bincount(of)
    begin = np.cumsum(length) - length
    off = np.concatenate([[0], np.cumsum(size)])
    root, out = classes.copy(), []
    for i in range(len(sets)):
        if (root == root[0]).all():
            break
        own = of[off[i]:off[i + 1]]
        n = length[own]
        at = np.repeat(begin[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.bincount(owner[at], minlength=len(sets))
        near = 9 * common >= 4 * (size[i] + size)  # common / (a + b - common) >= 0.8, in integers
        for j in np.flatnonzero(near & (root != root[i])).tolist():
            if root[j] != root[i]:
                out.append((int(root[i]), int(root[j])))
                root[root == root[j]] = root[i]
    return out


def _compared(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links between classes of texts with equal (key, part). rows: key, part, text_key, class."""
    by = ["key", "part"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in base.whole_groups(frames, by, TOGETHER):
            found: set[tuple[int, int]] = set()
            for at in f.groupby(by).indices.values():
                found.update(alike([np.frombuffer(f["hashes"].iat[i], np.uint64) for i in at], f["class"].to_numpy()[at]))
            yield pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")

    held = rows.join(sets, "text_key").select(*by, "class", "hashes")
    return held.repartition(base.parts(rows.sparkSession), *by).sortWithinPartitions(*by).mapInPandas(run, "a long, b long")


def _dealt(n: F.Column, hot: int, seed: int) -> F.Column:
    """One of as many numbers as n texts have parts of about ``hot``, by the hash of text_key."""
    return F.pmod(F.xxhash64("text_key", F.lit(seed)), F.ceil(n / hot))


def _still_mixed(members: DataFrame, found: DataFrame) -> DataFrame:
    """key, text_key, class (as the links found make it) of the buckets whose classes still differ."""
    to = simhash.classes(found).toDF("class", "merged")
    now = base.stored(members.join(to, "class", "left").select("key", "text_key", F.coalesce("merged", "class").alias("class")), "members")
    mixed = now.groupBy("key").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a < b").select("key")
    return base.stored(now.join(mixed, "key", "left_semi"), "members")


def _against_rest(members: DataFrame, hot: int) -> DataFrame:
    """key, part, text_key, class: parts in which every two texts of a bucket meet, but for those of its largest class.

    The texts of the other classes, the rest, are few once the parts of a bucket
    have been linked.  Each block of them meets each block of the largest class
    and each block of the rest, so a task gets about 2 * hot texts.
    """
    size = members.groupBy("key", "class").agg(F.count(F.lit(1)).alias("c"))
    all_of = size.groupBy("key").agg(F.max(F.struct("c", "class")).alias("top"), F.sum("c").alias("n"))
    counts = all_of.select("key", F.col("top.class").alias("body"), F.col("top.c").alias("n_body"), (F.col("n") - F.col("top.c")).alias("n_rest"))
    in_body = F.col("class") == F.col("body")
    of = members.join(counts, "key").withColumn("block", F.when(in_body, _dealt(F.col("n_body"), hot, -1)).otherwise(_dealt(F.col("n_rest"), hot, -1)))
    last = lambda n: F.ceil(F.col(n) / hot) - 1
    pair = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    mine = F.col("block")
    with_body = F.transform(F.sequence(F.lit(0).cast("long"), last("n_body")), lambda j: pair(0, mine, j))
    with_rest = F.transform(F.sequence(F.lit(0).cast("long"), last("n_rest")), lambda j: pair(1, F.least(mine, j), F.greatest(mine, j)))
    of_body = F.transform(F.sequence(F.lit(0).cast("long"), last("n_rest")), lambda j: pair(0, j, mine))
    parts = F.when(in_body, of_body).otherwise(F.concat(with_body, with_rest))
    return of.select("key", "text_key", "class", F.explode(parts).alias("p")).select("key", F.xxhash64("p.kind", "p.a", "p.b").alias("part"), "text_key", "class")


def _links(docs: DataFrame, texts: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b): classes to be one. texts: text_key, class, keys of different texts."""
    dealt = texts.select("text_key", "class", F.explode("keys").alias("key"))
    mixed = dealt.groupBy("key").agg(F.min("class").alias("a"), F.max("class").alias("b"), F.count(F.lit(1)).alias("n")).where("a < b").select("key", "n")
    members = base.stored(dealt.join(base.stored(mixed, "buckets"), "key"), "members")
    needed = members.select("text_key").distinct()
    held = docs.select(base.text_key().alias("text_key"), "text").join(needed, "text_key", "left_semi")
    sets = _sets(held).groupBy("text_key").agg(F.min("hashes").alias("hashes"))
    large = members.where(F.col("n") > hot)
    if large.isEmpty():
        return _compared(members.select("key", F.lit(0).cast("long").alias("part"), "text_key", "class"), sets)
    sets = base.stored(sets, "sets")
    found = base.stored(_compared(members.select("key", _dealt(F.col("n"), hot, 0).alias("part"), "text_key", "class"), sets), "similar")
    left = _still_mixed(large.select("key", "text_key", "class"), found)
    if left.isEmpty():
        return found
    return found.union(base.stored(_compared(_against_rest(left, hot), sets), "similar"))


def representatives(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, text_key: one row of each class under links of at most three bits and of similar sets."""
    prints = base.stored(_signed_texts(docs), "fingerprints")
    of = base.stored(simhash.classes(simhash.links(prints.select("fingerprint").distinct())).toDF("fingerprint", "class"), "classes")
    texts = prints.groupBy("text_key").agg(F.min("fingerprint").alias("fingerprint"), F.first("keys").alias("keys"))
    texts = texts.join(of, "fingerprint", "left").select("text_key", F.coalesce("class", "fingerprint").alias("class"), "keys")
    merged = simhash.classes(_links(docs, base.stored(texts, "texts"), hot)).toDF("class", "merged")
    fingerprints = prints.select("fingerprint").distinct().join(of, "fingerprint", "left").withColumn("class", F.coalesce("class", "fingerprint"))
    final = fingerprints.join(merged, "class", "left").select("fingerprint", F.coalesce("merged", "class").alias("class"))
    return simhash.first_rows(prints, final)
