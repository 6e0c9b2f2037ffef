"""Candidates for long exact repeats: what both substring operators start from.

A text is a sequence of tokens (bytes or words) and a window is ``window``
consecutive tokens.  Each window selects one anchor: of the cores (``core``
consecutive tokens) that it holds, the one with the least hash, leftmost on a
tie.  Equal windows select equal cores at the same place, so two equal windows
are found by looking only at anchors whose cores are equal.  An anchor with the
windows that select it is a context: consecutive window starts and the tokens
they reach over.  About two anchors come to ``window - core`` tokens, so the
rows that are shuffled are few against the text.

Anchors whose core is found once in the corpus have no repeated window and go.
Equal contexts are folded into one with its number of copies before any text is
gathered.  Cores that more than ``hot`` different contexts share are dealt again:
their contexts are cut, at places fixed relative to the anchor, and keyed by the
tokens that all windows of a cut share, which are nearly all of a window (of words:
all, a cut is one window).  Equal cuts of different contexts are read in a row and
judged once, so a task holds the different cuts of a key, not all of them.

The verdict on contexts is the operators' own: a function that gets a task's
contexts and says which window starts are repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

#: Contexts of one core that one task may get; cores with more are dealt again.
HOT = 20_000


@dataclass(frozen=True)
class Sampling:
    """Sizes in tokens; by_words: tokens are words, else bytes."""

    window: int
    core: int
    by_words: bool

    @property
    def cut(self) -> int:
        """Window starts of a context of a hot core that stay together."""
        return 1 if self.by_words else max(1, self.window // 16)


def tokens(batch: pa.RecordBatch, by_words: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit values of all tokens and the texts' offsets among them."""
    buf, off = base.flat(batch.column("text"))
    if not by_words:
        return base.BYTE_VALUE[buf], off
    start, stop, off = base.words(buf, off)
    return base.word_hashes(buf, start, stop), off


def anchors(values: np.ndarray, off: np.ndarray, window: int, core: int) -> dict[str, np.ndarray]:
    """doc (index of the text), start and n (window starts, within the text), at (anchor minus start), core and context (hashes)."""
    n, wide = len(values), window - core + 1
    none = np.zeros(0, np.int64)
    if n < window:
        return {k: none for k in ("doc", "start", "n", "at", "core", "context")}
    ranges = base.RangeHash(values)
    least = cores = ranges.rolling(core)
    where = np.arange(len(cores), dtype=np.int32)
    step = 1
    while step < wide:
        by = min(step, wide - step)  # two overlapping stretches of the last length make the next
        later = least[by:] < least[:-by]
        where = np.where(later, where[by:], where[:-by])
        least = np.minimum(least[by:], least[:-by])
        step += by
    inside = np.zeros(n + 1, np.int32)
    fits = off[1:] - off[:-1] >= window
    inside[off[:-1][fits]] += 1
    inside[off[1:][fits] - window + 1] -= 1
    s = np.flatnonzero(np.cumsum(inside)[:len(where)])
    if not len(s):
        return {k: none for k in ("doc", "start", "n", "at", "core", "context")}
    a = where[s].astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)]))
    lo, count, a = s[new], np.diff(np.append(new, len(s))), a[new]
    doc = base.owner(off, lo)
    context = base.mix(ranges(lo, lo + count - 1 + window) + (a - lo).astype(np.uint64))
    return {"doc": doc, "start": lo - off[doc], "n": count, "at": a - lo, "core": cores[a], "context": context}


ANCHORS = "doc_id long, text_key long, core long, context long, start int, n int, at int"


def all_anchors(docs: DataFrame, how: Sampling) -> DataFrame:
    """The anchors of every text: doc_id, text_key, core, context, start, n, at."""
    base.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in base.text_blocks(batches):
            f = anchors(*tokens(batch, how.by_words), how.window, how.core)
            doc = pa.array(f["doc"])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(doc), batch.column("text_key").take(doc),
                pa.array(f["core"].view(np.int64)), pa.array(f["context"].view(np.int64)),
                *[pa.array(f[k].astype(np.int32)) for k in ("start", "n", "at")],
            ], names=["doc_id", "text_key", "core", "context", "start", "n", "at"])

    return keyed(docs).mapInArrow(run, ANCHORS)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", base.text_key().alias("text_key"), "text")


CONTEXTS = "key long, piece long, core long, context long, copies long, first int, n int, data binary"


def contexts(docs: DataFrame, hits: DataFrame, how: Sampling, hot: int = HOT) -> DataFrame:
    """Each different context once: its tokens, number of copies and the key of its task.

    first: which of the context's window starts is the first of this row (0 but
    for cuts of hot cores).  data: 64-bit values of words, or bytes; piece: its hash.
    """
    each = hits.groupBy("core", "context").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "text_key", "start", "n", "at")).alias("one"))
    each = base.stored(each.select("core", "context", "copies", "one.*"), "contexts")
    many = base.stored(each.groupBy("core").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hot).select(F.col("core").alias("many")), "hot")
    each = each.join(many, F.col("core") == F.col("many"), "left").withColumn("is_hot", F.col("many").isNotNull())
    by_doc = each.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("core", "context", "copies", "start", "n", "at", "is_hot")).alias("found"))
    by_doc = by_doc.withColumnsRenamed({"doc_id": "its_id", "text_key": "its_key"}).hint("shuffle_hash")
    texts = keyed(docs).join(by_doc, F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("text_key") == F.col("its_key"))).select("text", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in base.text_blocks(batches):
            if how.by_words:
                buf, off = tokens(batch, True)
            else:
                buf, off = base.flat(batch.column("text"))
            ranges = base.RangeHash(buf if how.by_words else base.BYTE_VALUE[buf])
            lists = batch.column("found")
            f = {k: np.asarray(lists.flatten().field(k)) for k in ("core", "context", "copies", "start", "n", "at")}
            is_hot = lists.flatten().field("is_hot").to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
            lo = off[doc] + f["start"]
            rows = []
            for i in range(len(doc)):
                a, n = int(lo[i]), int(f["n"][i])
                if is_hot[i]:
                    at, cut = int(f["at"][i]), how.cut
                    edges = sorted({0, n, *range(at % cut, n, cut)})
                else:
                    edges = [0, n]
                for x, y in zip(edges, edges[1:]):
                    key = int(f["core"][i])
                    if is_hot[i]:  # what all windows of a whole cut share; every part of that cut has it
                        nth = (x - at) // how.cut
                        shared = ranges(np.array([a + at + (nth + 1) * how.cut - 1]), np.array([a + at + nth * how.cut + how.window]))
                        key = int(base.mix(shared + np.uint64(nth % (1 << 32))).view(np.int64)[0])
                    rows.append((key, i, x, y - x, buf[a + x:a + y - 1 + how.window].tobytes()))
            if rows:
                key, i, first, n, data = zip(*rows)
                i, first, n = list(i), np.array(first, np.int32), np.array(n, np.int32)
                piece = base.mix(ranges(lo[i] + first, lo[i] + first + n - 1 + how.window) + n.astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(base.signed(piece)), *[pa.array(f[k][i]) for k in ("core", "context", "copies")], pa.array(first), pa.array(n), pa.array(data, pa.binary())], names=["key", "piece", "core", "context", "copies", "first", "n", "data"])

    return texts.mapInArrow(run, CONTEXTS)


@dataclass
class Held:
    """Different contexts of whole keys, as one sequence of tokens."""

    frame: pd.DataFrame
    values: np.ndarray  # 64-bit values of words, or bytes
    base: np.ndarray  # where each context's tokens begin

    def starts(self) -> tuple[np.ndarray, np.ndarray]:
        """Position in values of each window start, and its context's number."""
        n = self.frame["n"].to_numpy()
        which = np.repeat(np.arange(len(n)), n)
        return self.base[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n), which


def hold(frame: pd.DataFrame, by_words: bool) -> Held:
    data = b"".join(frame["data"])
    values = np.frombuffer(data, np.uint64 if by_words else np.uint8)
    sizes = np.array([len(x) for x in frame["data"]], np.int64) // (8 if by_words else 1)
    return Held(frame, values, np.cumsum(sizes) - sizes)


Judge = Callable[[Held], np.ndarray]
RUNS = "core long, context long, runs array<struct<lo:int,hi:int>>"


def folded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames sorted by key and piece: again is true, and data left out, where the row before has the same ones."""
    last = None
    for f in frames:
        key, piece = f["key"].to_numpy(), f["piece"].to_numpy()
        again = np.zeros(len(f), bool)
        again[1:] = (key[1:] == key[:-1]) & (piece[1:] == piece[:-1])
        if len(f):
            again[0] = (key[0], piece[0]) == last
            last = key[-1], piece[-1]
        yield f.assign(again=again, data=f["data"].where(~again, b""))


def judged(f: pd.DataFrame, judge: Judge, by_words: bool) -> pd.DataFrame:
    """The verdicts on whole keys of folded frames: equal pieces are judged as one with all their copies."""
    f = f.drop_duplicates(["key", "core", "context", "first"], ignore_index=True)
    lead = np.flatnonzero(~f["again"])
    copies = np.add.reduceat(f["copies"].to_numpy(), lead)
    h = hold(f.iloc[lead].assign(copies=copies), by_words)
    marked = judge(h)
    _, which = h.starts()
    n = h.frame["n"].to_numpy()
    begin = np.cumsum(n) - n
    edge = np.flatnonzero(marked & np.concatenate([[True], ~marked[:-1] | (which[1:] != which[:-1])]))
    end = np.flatnonzero(marked & np.concatenate([~marked[1:] | (which[1:] != which[:-1]), [True]])) + 1
    of = which[edge]  # the piece of each run, ascending
    lo, hi = edge - begin[of], end - begin[of]
    piece = np.cumsum(~f["again"].to_numpy()) - 1
    from_, to = np.searchsorted(of, piece, "left"), np.searchsorted(of, piece, "right")
    one, first = np.flatnonzero(to > from_), f["first"].to_numpy()
    runs = [[{"lo": int(lo[k] + first[i]), "hi": int(hi[k] + first[i])} for k in range(from_[i], to[i])] for i in one]
    return pd.DataFrame({"core": f["core"].to_numpy()[one], "context": f["context"].to_numpy()[one], "runs": pd.Series(runs, dtype=object)})  # an empty list is float64 to pandas, which Arrow makes no lists of


def verdicts(found: DataFrame, judge: Judge, by_words: bool, most: int) -> DataFrame:
    """core, context, runs: the stretches [lo, hi) of a context's window starts that are repeated.

    A task reads its contexts in the order of keys and pieces and judges whole
    keys, about ``most`` contexts at a time; of one key it holds the different pieces.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in base.whole_groups(folded(frames), ["key"], most):
            yield judged(f, judge, by_words)

    return found.repartition(base.parts(found.sparkSession), "key").sortWithinPartitions("key", "piece").mapInPandas(run, RUNS)


def spans(docs: DataFrame, how: Sampling, judge: Judge, *, most: int, hot: int = HOT) -> DataFrame:
    """doc_id, text_key, removed: the merged stretches [lo, hi) of tokens under repeated windows."""
    found = base.stored(all_anchors(docs, how), "anchors")
    # stored, so that the join below has two plain shuffles and a hot core's side of it can be split
    twice = base.stored(found.groupBy("core").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("core"), "cores")
    hits = base.stored(found.join(twice, "core", "left_semi"), "hits")
    judged = base.stored(verdicts(contexts(docs, hits, how, hot), judge, how.by_words, most), "verdicts")
    each = hits.join(judged, ["core", "context"]).select("doc_id", "text_key", F.transform("runs", lambda r: F.struct((F.col("start") + r["lo"]).alias("lo"), (F.col("start") + r["hi"] - 1 + how.window).alias("hi"))).alias("spans"))
    by_doc = each.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("spans")
            doc, lo, hi = merged(np.asarray(lists.value_lengths()), *[np.asarray(lists.flatten().field(k)) for k in ("lo", "hi")])
            off = np.searchsorted(doc, np.arange(len(lists) + 1)).astype(np.int32)
            removed = pa.ListArray.from_arrays(pa.array(off), pa.StructArray.from_arrays([pa.array(lo), pa.array(hi)], names=["lo", "hi"]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), removed], names=["doc_id", "text_key", "removed"])

    return by_doc.mapInArrow(merge, "doc_id long, text_key long, removed array<struct<lo:int,hi:int>>")


def merged(size: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, lo, hi of the merged stretches, in order; size: how many stretches each document gives."""
    doc = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((lo, doc))
    lo, hi, up = lo[order], hi[order], doc << 32
    reach = np.maximum.accumulate(hi + up)
    cut = np.flatnonzero(np.concatenate([np.ones(min(1, len(doc)), bool), (lo + up)[1:] > reach[:-1]]))
    return doc[cut], lo[cut], (reach[np.append(cut[1:], len(doc)) - 1] - up[cut]).astype(np.int32) if len(cut) else hi


def with_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), removed (empty where nothing is)."""
    found = found.withColumnsRenamed({"doc_id": "its_id", "text_key": "its_key"}).hint("shuffle_hash")
    texts = keyed(docs).join(found, F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("text_key") == F.col("its_key")), "left")
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    return texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("removed", none).alias("removed"))


def kept_ranges(removed: F.Column, size: F.Column) -> F.Column:
    """The stretches between the removed ones, as array<struct<lo, n>>."""
    ends = F.concat(F.array(F.lit(0)), F.transform(removed, lambda x: x["hi"]))
    begins = F.concat(F.transform(removed, lambda x: x["lo"]), F.array(size))
    return F.transform(F.arrays_zip(ends.alias("a"), begins.alias("b")), lambda x: F.struct(x["a"].alias("lo"), (x["b"] - x["a"]).alias("n")))


def count_removed(removed: str = "removed") -> F.Column:
    return F.aggregate(removed, F.lit(0).cast("long"), lambda a, x: a + x["hi"] - x["lo"])
