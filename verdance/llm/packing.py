"""Packing of token sequences into windows of fixed length, by exact complements.

Lengths are integers up to the capacity, so the whole problem is a histogram of
at most ``capacity`` counts, whatever the size of the corpus.  On the driver,
``plan`` fills windows: the longest remaining length leaves a gap; a single
length, a pair or a triple whose sum equals the gap exactly completes the window,
as often as the counts allow at once.  Pairs and triples are indexed by their sum;
counts only fall, so entries used up leave the index for good.  Lengths without an
exact complement are then placed by best fit, decreasing, again by counts.  The
plan is a list of patterns with multiplicities; each use takes a length's last
piece or a pattern's last window, so it stays within a few patterns a length.

Pieces learn their window by their rank among the pieces of equal length.  Ranks
come from windows over (length, salt) with the counts of earlier salts added; a
length has a salt for each ten-thousandth of all pieces, so one that a third of them
have is spread over many tasks, and there are few salts besides.

Cases: a null text is empty and gives one piece, the end id; repeated rows are
packed each on their own; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import base
from .tokenizing import encoder

CAPACITY = 2048
END_ID = 0
#: Salts besides one for each length, if they have LEAST pieces each.
SALTS, LEAST = 10_000, 1_000

PIECES = "doc_id long, text_key long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, *, keeps_space: bool = False, capacity: int = CAPACITY) -> DataFrame:
    """Encode each document with its end id and cut what is longer than a window."""
    base.prepare(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, keeps_space).encode
        for batch in base.text_blocks(batches, budget=4 << 20):
            cols: list[list] = [[] for _ in range(6)]
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for doc_id, key, ids in zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), encode(texts), strict=True):
                ids += b"\0\0\0\0"
                for i in range(0, len(ids), 4 * capacity):
                    part = ids[i:i + 4 * capacity]
                    for c, x in zip(cols, (doc_id, key, i // (4 * capacity), i // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "text_key", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", base.text_key().alias("text_key"), "text").mapInArrow(cut, PIECES)


class _Counts:
    """How many pieces of each length are left, with pairs and triples indexed by their sum."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = [0] * (capacity + 1)
        for length, n in counts.items():
            self.left[length] = n
        self.held: list[int] = []  # a piece each that is set aside while a combination is looked for
        self.pairs: dict[int, list[int]] = {}  # sum: the longer lengths, ascending
        self.triples: dict[int, list[int]] = {}  # sum: the first lengths, ascending

    def times(self, combination: tuple[int, ...]) -> int:
        """How often the counts allow the combination."""
        return min(self.left[x] // combination.count(x) for x in combination)

    def use(self, combination: tuple[int, ...], n: int) -> None:
        for x in combination:
            self.left[x] -= n

    def gone(self, length: int) -> bool:
        return not self.left[length] and length not in self.held

    @contextmanager
    def holding(self, length: int) -> Iterator[None]:
        self.left[length] -= 1
        self.held.append(length)
        yield
        self.held.pop()
        self.left[length] += 1

    def pair(self, total: int) -> tuple[int, int] | None:
        """Two available lengths of this sum, the most unequal first."""
        if total not in self.pairs:
            self.pairs[total] = [a for a in range((total + 1) // 2, total) if not (self.gone(a) or self.gone(total - a))] if total > 1 else []
        found = self.pairs[total]
        while found and (self.gone(found[-1]) or self.gone(total - found[-1])):
            found.pop()
        for a in reversed(found):
            if self.left[a] > (2 * a == total) and self.left[total - a]:
                return a, total - a
        return None

    def triple(self, total: int) -> tuple[int, int, int] | None:
        """Three available lengths of this sum, the longest first as far as there are pairs for it."""
        if total not in self.triples:
            self.triples[total] = [a for a in range(1, total - 1) if not self.gone(a)]
        found = self.triples[total]
        while found and self.gone(found[-1]):
            found.pop()
        for a in reversed(found):
            if self.left[a]:
                with self.holding(a):
                    two = self.pair(total - a)
                if two:
                    return a, *two
        return None

    def complement(self, length: int) -> tuple[int, ...] | None:
        """A combination of the length and one to three more that fills a window."""
        gap = len(self.left) - 1 - length
        with self.holding(length):
            if self.left[gap]:
                return (length, gap)
            found = self.pair(gap) or self.triple(gap)
        return (length, *found) if found else None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one window) with the number of windows that use each."""
    have, out = _Counts(counts, capacity), []
    if have.left[capacity]:
        out.append(((capacity,), have.left[capacity]))
        have.left[capacity] = 0
    stuck: dict[int, int] = {}
    for length in range(capacity - 1, 0, -1):
        while have.left[length]:
            got = have.complement(length)
            if got is None:
                stuck[length] = have.left[length]
                have.left[length] = 0
                break
            n = have.times(got)
            have.use(got, n)
            out.append((got, n))
    return out + best_fit(stuck, capacity)


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing on counts: each length goes where it leaves least room."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    free: list[int] = []  # distinct rooms, ascending

    def put(space: int, pattern: tuple[int, ...], n: int) -> None:
        if space not in room:
            room[space] = []
            free.insert(int(np.searchsorted(free, space)), space)
        room[space].append((pattern, n))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            i = int(np.searchsorted(free, length))
            if i == len(free):
                k = capacity // length  # of the same length there may be several to a window
                if full := n // k:
                    put(capacity - k * length, (length,) * k, full)
                if n % k:
                    put(capacity - n % k * length, (length,) * (n % k), 1)
                break
            space = free[i]
            pattern, there = room[space].pop()
            if not room[space]:
                del room[space], free[i]
            used = min(n, there)
            put(space - length, (*pattern, length), used)
            if there > used:
                put(space, pattern, there - used)
            n -= used
    return [x for space in sorted(room) for x in room[space]]


def slots(patterns: list[tuple[tuple[int, ...], int]], counts: dict[int, int]) -> dict[str, np.ndarray]:
    """Ranges of pieces, numbered by length and rank, with the windows and places they get."""
    begin, at = {}, 0
    for length in sorted(counts):
        begin[length] = at
        at += counts[length]
    rows, window = [], 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            rows.append((begin[length], window, offset))
            begin[length] += n
            offset += length
        window += n
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 3)
    return {"begin": a[:, 0], "window": a[:, 1], "offset": a[:, 2]}


def pack(found: DataFrame, capacity: int = CAPACITY, per_salt: int | None = None) -> DataFrame:
    """Give each piece (doc_id, text_key, piece, length, ...) its sequence_id and offset."""
    spark = base.prepare(found.sparkSession)
    totals = {int(length): n for length, n in found.groupBy("length").count().collect()}  # at most a row for each length
    per_salt = per_salt or max(LEAST, -(-sum(totals.values()) // SALTS))
    salts = {length: -(-n // per_salt) for length, n in totals.items()}
    of_length = F.broadcast(spark.createDataFrame(sorted(salts.items()), "length long, salts long"))  # the same
    salt = F.pmod(F.xxhash64("doc_id", "text_key", "piece"), "salts").cast("int")
    salted = found.join(of_length, "length").withColumn("salt", salt).select(*found.columns, "salt")
    base_of = np.zeros((capacity + 1, max(salts.values(), default=1)), np.int64)
    for length, salt, n in salted.groupBy("length", "salt").count().collect():  # at most SALTS besides
        base_of[length, salt] = n
    counts = totals
    where = slots(plan(counts, capacity), counts)
    before = np.concatenate([[0], np.cumsum(base_of.ravel())[:-1]]).reshape(base_of.shape)
    known = spark.sparkContext.broadcast((before, where))
    kind = found.schema.fieldNames()

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, where = known.value
        for f in frames:
            number = before[f["length"].to_numpy(), f["salt"].to_numpy()] + f["rank"].to_numpy() - 1
            i = np.searchsorted(where["begin"], number, side="right") - 1
            out = f[kind].copy()
            out["sequence_id"] = where["window"][i] + number - where["begin"][i]
            out["offset"] = where["offset"][i]
            yield out

    order = Window.partitionBy("length", "salt").orderBy("doc_id", "text_key", "piece")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema) + ", sequence_id long, offset long"
    return salted.withColumn("rank", F.row_number().over(order)).mapInPandas(place, schema)


def lower_bound(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """No packing needs fewer windows than this."""
    return max(-(-sum(k * n for k, n in counts.items()) // capacity), sum(n for k, n in counts.items() if 2 * k > capacity))


def packed(docs: DataFrame, vocabulary: str, *, keeps_space: bool = False, capacity: int = CAPACITY) -> DataFrame:
    """pieces() and pack() of documents; the encoded pieces are stored between them."""
    return pack(base.stored(pieces(docs, vocabulary, keeps_space=keeps_space, capacity=capacity), "pieces"), capacity)
