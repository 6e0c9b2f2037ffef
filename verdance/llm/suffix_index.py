"""Substring dedup by a logarithmic family of suffix arrays.

Long strings that start at more than one place of the corpus are found and the
bytes under them removed.  ``repeats`` deals contexts to tasks such that equal
windows meet; a task indexes their suffixes, batch after batch:

* the new batch gets its suffix array, over an alphabet of blocks: a suffix is
  the sequence of the names (64-bit hashes) of its consecutive blocks, and blocks
  that make up a window decide, so common prefixes are counted in blocks;
* the batch is merge-scanned against the suffix arrays of all levels for common
  prefixes as long as a window, and both sides of a match are marked;
* suffixes that a level holds already are dropped, the rest becomes a run, and
  runs of equal size class are merged, so level sizes grow geometrically and a
  suffix is moved a logarithmic number of times.

Cases: a null text is empty; rows with equal doc_ids are told apart by a hash of
their text, repeated rows are copies of each other; texts shorter than a window
stay whole; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base, repeats

LENGTH = 400
CORE = 100
#: Blocks of a window.
BLOCKS = 4
#: Suffixes of a batch, and contexts (of whole keys) that a task judges together.
BATCH = 1 << 17
TOGETHER = 1 << 11
#: Contexts of one core before it is dealt again: each has up to 301 window starts.
HOT = 5_000


@dataclass
class Run:
    """A suffix array: different suffixes in the order of their block names."""

    names: list[np.ndarray]  # one array for each block of a window
    suffix: np.ndarray  # number of the first suffix of each

    def __len__(self) -> int:
        return len(self.suffix)

    def take(self, i: np.ndarray) -> Run:
        return Run([x[i] for x in self.names], self.suffix[i])


def _starts(names: list[np.ndarray]) -> np.ndarray:
    """Where a sorted sequence begins a different suffix: a common prefix shorter than a window."""
    new = np.ones(len(names[0]), bool)
    new[1:] = False
    for x in names:
        new[1:] |= x[1:] != x[:-1]
    return new


def _find(run: Run, names: list[np.ndarray]) -> np.ndarray:
    """Place in the run of the suffix that shares a whole window with each of the given, or -1."""
    lo = np.searchsorted(run.names[0], names[0], "left")
    hi = np.searchsorted(run.names[0], names[0], "right")
    end = hi.copy()
    while True:  # binary search among those whose first block is equal
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            break
        mid = (lo[open_] + hi[open_]) // 2
        less, same = np.zeros(len(open_), bool), np.ones(len(open_), bool)
        for x, q in zip(run.names[1:], names[1:]):
            v, w = x[mid], q[open_]
            less |= same & (v < w)
            same &= v == w
        lo[open_[less]] = mid[less] + 1
        hi[open_[~less]] = mid[~less]
    there = np.flatnonzero(lo < end)
    same = np.ones(len(there), bool)
    for x, q in zip(run.names, names):
        same &= x[lo[there]] == q[there]
    out = np.full(len(lo), -1)
    out[there[same]] = lo[there[same]]
    return out


class Family:
    """The levels; marks tells which of the added suffixes share a window with another."""

    def __init__(self, size: int):
        self.levels: list[Run] = []  # from large to small
        self.marks = np.zeros(size, bool)

    def add(self, names: list[np.ndarray], suffix: np.ndarray, copies: np.ndarray) -> None:
        order = np.lexsort(names[::-1])
        names, suffix = [x[order] for x in names], suffix[order]
        begin = np.flatnonzero(_starts(names))
        size = np.diff(np.append(begin, len(suffix)))
        total = np.add.reduceat(copies[order], begin)
        self.marks[suffix[np.repeat(total > 1, size)]] = True
        new = Run([x[begin] for x in names], suffix[begin])
        old = np.zeros(len(new), bool)
        for level in self.levels:
            at = _find(level, new.names)
            old |= at >= 0
            self.marks[level.suffix[at[at >= 0]]] = True
        self.marks[suffix[np.repeat(old, size)]] = True
        run = new.take(np.flatnonzero(~old))
        while self.levels and len(self.levels[-1]) < 2 * len(run):
            run = _merged(self.levels.pop(), run)
        if len(run):
            self.levels.append(run)


def _merged(a: Run, b: Run) -> Run:
    names = [np.concatenate(x) for x in zip(a.names, b.names)]
    return Run(names, np.concatenate([a.suffix, b.suffix])).take(np.lexsort(names[::-1]))


def judge(window: int, batch: int = BATCH) -> repeats.Judge:
    """Marks window starts whose window is found twice, by a family of suffix arrays."""
    cuts = [window * i // BLOCKS for i in range(BLOCKS + 1)]

    def run(held: repeats.Held) -> np.ndarray:
        n, copies = held.frame["n"].to_numpy(), held.frame["copies"].to_numpy()
        end = np.cumsum(n)
        family = Family(int(end[-1]))
        i = 0
        while i < len(n):  # contexts of about a batch of suffixes or a block of bytes; only their bytes get 64-bit values
            lo = int(end[i] - n[i])
            first = held.base[i]
            j = max(i + 1, min(int(np.searchsorted(end, lo + batch, "right")), int(np.searchsorted(held.base, first + base.BLOCK_BYTES))))
            ranges = base.RangeHash(base.BYTE_VALUE[held.values[first:held.base[j - 1] + n[j - 1] - 1 + window]])
            which = np.repeat(np.arange(i, j), n[i:j])
            suffix = np.arange(lo, int(end[j - 1]))
            s = held.base[which] - first + suffix - (end - n)[which]
            family.add([ranges(s + a, s + b) for a, b in zip(cuts, cuts[1:])], suffix, copies[which])
            i = j
        return family.marks

    return run


def deduplicated(docs: DataFrame, *, length: int = LENGTH, core: int = CORE, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, removed (stretches [lo, hi) of bytes), kept (binary: what remains).

    Removes each byte covered by a string of ``length`` bytes that also starts
    anywhere else in the corpus, the same text included.
    """
    how = repeats.Sampling(length, core, by_words=False)
    found = repeats.with_spans(docs, base.stored(repeats.spans(docs, how, judge(length), most=TOGETHER, hot=hot), "spans"))
    data = found.select("doc_id", "removed", F.col("text").cast("binary").alias("data")).withColumn("n_bytes", F.octet_length("data"))
    ranges = repeats.kept_ranges(F.col("removed"), F.col("n_bytes"))
    rest = F.aggregate(ranges, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, F.substring("data", x["lo"] + 1, x["n"])))
    kept = F.when(F.size("removed") == 0, F.col("data")).otherwise(rest)
    return data.select("doc_id", F.col("n_bytes").cast("long").alias("n_bytes"), "removed", kept.alias("kept"))
