"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

A byte is eight binary decisions.  The node of a decision is the bits of the byte
so far and, at depth d, the d bytes before it; a node keeps Krichevsky-Trofimov
counts of zeros and ones.  Weighting sets a node's probability of all training
bits to the mean of its own estimate and the product of its children's, which
gives each node a weight against what lies deeper; a prediction mixes the
estimates of all depths along the path of contexts with these weights.  A path
ends at its deepest node that training has seen.  log2 of the predictions summed
over a text's bits is its code length.

The model is never gathered in one place.  The corpus is stored in blocks.  Each
block names the different (context, byte) strings that it has, sorted from the
most recent byte back and packed by the last two bytes of context, with their
training counts.  These packs meet by pair of bytes (those of a very frequent pair
in parts first), each string's prediction is worked out once in the tree below its
pair, and the answers go back to the blocks that asked.  A task then scores its
block with answers for just what the block holds.  Pairs with more than ``most``
different strings are divided by the third byte.  Over the driver go sums for the
256 contexts of one byte and for the divided pairs, of which there are at most as
many as ``most`` goes into the number of strings.  Answers have 32 bits of mantissa.

The base score is a unigram model of words with an end token, add-one smoothed.

Cases: a null text is empty: its only token is the end and its score is 0; a null
doc_id counts as the text ''; rows with equal doc_ids are scored each; further
columns are ignored; with no training text all tokens are unknown and bytes are
uniform; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base, store

DEPTH = 4
#: The most bytes of context whose strings, with the byte itself, are one 64-bit key.
DEEPEST = 7
#: The depth of the query.
QUERY_DEPTH = 6
#: The key of the end token among words' hashes.
END = int(base.mix(np.array([0xE0D], np.uint64))[0])
_LOG10_2 = float(np.log10(2.0))


# --- the corpus in blocks ------------------------------------------------------

def blocks(docs: DataFrame, modulus: int = 7, held_out: int = 2) -> DataFrame:
    """The texts with the block they are stored in and whether they are held out."""
    spark = base.prepare(docs.sparkSession)
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == held_out
    path = base.scratch(spark, "blocks")
    docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), out.alias("held_out"), F.spark_partition_id().alias("block")).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


class _Counter:
    """Different keys with counts, by sorting."""

    def __init__(self, most: int = 1 << 22):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.most, self.size = most, 0

    def add(self, keys: np.ndarray, weight: int) -> None:
        """Count each of these keys so many times."""
        keys = np.sort(keys)
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        self.put(keys[begin], weight * np.diff(np.append(begin, len(keys))))

    def put(self, keys: np.ndarray, n: np.ndarray) -> None:
        """Different keys with their counts."""
        self.parts.append((keys, n))
        self.size += len(keys)
        if self.size > self.most:
            self.result()
            self.most = max(self.most, 2 * self.size)

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        """All keys, sorted, with their counts."""
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(self.parts) > 1:
            keys, n = (np.concatenate(x) for x in zip(*self.parts))
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
            self.parts = [(keys[begin], np.add.reduceat(n, begin) if len(keys) else n)]
            self.size = len(begin)
        return self.parts[0]


def grams(batch: pa.RecordBatch, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the lower-cased texts itself and the bytes before it, as one integer (see turned()); the texts' offsets."""
    buf, off = base.flat(batch.column("text"))
    wide = np.zeros(len(buf) + depth * (len(off) - 1), np.uint8)  # zeros stand before a text
    where = np.arange(len(buf)) + depth * (np.repeat(np.arange(len(off) - 1), np.diff(off)) + 1)
    wide[where] = base.lowered(buf)
    out = np.zeros((len(wide), 8), np.uint8)
    out[:, 0] = wide
    for d in range(1, depth + 1):
        out[d:, depth + 1 - d] = wide[:len(wide) - d]
    return out.view("<u8").ravel()[where], off


def turned(keys: np.ndarray, depth: int) -> np.ndarray:
    """Strings with their context in the other order.

    The byte itself is the lowest of the integer.  Above it stands the context, in
    one order the most recent byte lowest, in the other highest: sorted by that,
    strings whose contexts end alike are neighbours.
    """
    b = np.ascontiguousarray(keys).astype("<u8").view(np.uint8).reshape(-1, 8)
    out = np.zeros_like(b)
    out[:, 0] = b[:, 0]
    out[:, 1:depth + 1] = b[:, depth:0:-1]
    return out.view("<u8").ravel()


def _pack(columns: np.ndarray) -> bytes:
    """Bytes of a (rows, bytes) array, column by column, compressed."""
    return pa.compress(np.ascontiguousarray(columns.T).tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, rows: int, width: int) -> np.ndarray:
    flat = pa.decompress(data, decompressed_size=rows * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(width, rows).T)


def pack_keys(keys: np.ndarray, depth: int) -> bytes:
    """Sorted strings of one pair of last bytes (the two highest bytes), without these."""
    return _pack(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :depth - 1])


def unpack_keys(data: bytes, rows: int, pair: int, depth: int) -> np.ndarray:
    out = np.zeros((rows, 8), np.uint8)
    out[:, :depth - 1] = _unpack(data, rows, depth - 1)
    return out.view("<u8").ravel() | np.uint64(pair << 8 * (depth - 1))


def pack_counts(n: np.ndarray) -> bytes:
    return _pack(n.astype("<i8").view(np.uint8).reshape(-1, 8))


def unpack_counts(data: bytes, rows: int) -> np.ndarray:
    return _unpack(data, rows, 8).view("<i8").ravel()


def pack_values(x: np.ndarray) -> bytes:
    """Doubles, rounded to 32 bits of mantissa."""
    bits = (x.astype("<f8").view("<i8") + (1 << 19)) & ~((1 << 20) - 1)
    return _pack(bits.view(np.uint8).reshape(-1, 8))


def unpack_values(data: bytes, rows: int) -> np.ndarray:
    return _unpack(data, rows, 8).view("<f8").ravel()


def word_keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    buf, off = base.flat(batch.column("text"))
    buf = base.lowered(buf)
    start, stop, off = base.words(buf, off)
    return base.word_hashes(buf, start, stop), off


def _counters(batches: Iterator[pa.RecordBatch], words: bool, depth: int) -> dict[int, _Counter]:
    """The different words or strings of each block, with their numbers in its training texts."""
    found: dict[int, _Counter] = {}
    for batch in base.text_blocks(batches):
        of_block = np.asarray(batch.column("block"))
        for b in np.unique(of_block):
            mine = batch.filter(pa.array(of_block == b))
            keys, off = word_keys(mine) if words else grams(mine, depth)
            train = ~mine.column("held_out").to_numpy(zero_copy_only=False)
            learnt = np.repeat(train, np.diff(off))
            counter = found.setdefault(int(b), _Counter())
            for weight, some, texts in ((1, learnt, train.sum()), (0, ~learnt, (~train).sum())):
                counter.add(np.append(keys[some], np.full(texts, END, np.uint64)) if words else keys[some], weight)
    return found


KEYED = "block int, key long, n long"


def _gathered_words(stored: DataFrame) -> DataFrame:
    """block, key, n: each block's different words, n times in its training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, counter in _counters(batches, True, 0).items():
            keys, n = counter.result()
            for lo in range(0, len(keys), 1 << 16):
                k = keys[lo:lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), b, np.int32)), pa.array(k.view(np.int64)), pa.array(n[lo:lo + len(k)])], names=["block", "key", "n"])

    return stored.select("text", "held_out", "block").mapInArrow(run, KEYED)


def _by_pair(keys: np.ndarray, depth: int) -> Iterator[tuple[int, int, int]]:
    """(pair, lo, hi) of sorted strings."""
    if len(keys):
        pair = (keys >> np.uint64(8 * (depth - 1))).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        yield from zip(pair[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(keys)])


PACKS = "block int, pair int, n long, keys binary, counts binary"


def _gathered_strings(stored: DataFrame, depth: int) -> DataFrame:
    """Packs of each block's different strings, by their last two bytes of context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, counter in _counters(batches, False, depth).items():
            keys, n = counter.result()
            rows = [(b, pair, hi - lo, pack_keys(keys[lo:hi], depth), pack_counts(n[lo:hi])) for pair, lo, hi in _by_pair(keys, depth)]
            yield pa.RecordBatch.from_pylist([dict(zip(("block", "pair", "n", "keys", "counts"), r)) for r in rows], schema=pa.schema([("block", pa.int32()), ("pair", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]))

    return stored.select("text", "held_out", "block").mapInArrow(run, PACKS)


def _answered(rows: DataFrame, name: str) -> str:
    """Write answers so that each block's are together; returns the path."""
    spark = rows.sparkSession
    path = base.scratch(spark, name)
    rows.repartition(base.parts(spark), "block").write.partitionBy("block").parquet(path)
    return path


def _read(path: str, block: int, columns: list[str]) -> list[pa.Table]:
    import pyarrow.parquet as pq

    return [pq.read_table(f, columns=columns) for f in store.files(f"{path}/block={block}", ".parquet")]


def _answers(path: str, block: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's words, sorted, with their training counts."""
    parts = _read(path, block, ["key", "value"])
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0)
    t = pa.concat_tables(parts)
    keys = t.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], t.column("value").to_numpy()[order]


def _string_answers(path: str, block: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's strings, sorted, with the log10 probabilities of their last bytes."""
    parts = _read(path, block, ["pair", "n", "keys", "answers"])
    rows = [tuple(r.values()) for t in parts for r in t.to_pylist()]
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0)
    keys = np.concatenate([unpack_keys(k, n, pair, depth) for pair, n, k, _ in rows])
    values = np.concatenate([unpack_values(v, n) for _, n, _, v in rows])
    order = np.argsort(keys, kind="stable")
    return keys[order], values[order]


def _found(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key among the known ones; sorted keys are looked up in one sweep of the memory."""
    order = np.argsort(keys)
    out = np.empty(len(keys), np.int64)
    out[order] = np.searchsorted(known, keys[order])
    return out


# --- context-tree weighting ------------------------------------------------------

def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function of positive numbers."""
    x = np.asarray(x, float)
    shift = np.ones_like(x)
    for i in range(8):
        shift *= x + i
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(shift)


def _log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


_SMALL = 256
_TABLE = _log_estimate(*np.indices((_SMALL, _SMALL)))


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of so many zeros and ones, in any order."""
    shape, zeros, ones = np.shape(zeros), np.ravel(zeros), np.ravel(ones)
    out = _TABLE[np.minimum(zeros, _SMALL - 1).astype(np.intp), np.minimum(ones, _SMALL - 1).astype(np.intp)]
    big = np.maximum(zeros, ones) >= _SMALL
    if big.any():
        out[big] = _log_estimate(zeros[big], ones[big])
    return out.reshape(shape)


def _half_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b) - np.log(2)


class Tree:
    """Nodes of the decisions with so many bits made, at the depths from ``top`` to ``depth``.

    keys: (context, byte) strings, the most recent byte lowest; n: how often
    training has them.  Sorted by the bits made and then from the most recent byte
    back, the strings of a node are neighbours at every depth.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray, bit: int, top: int, depth: int):
        self.set(turned(keys, depth), np.asarray(n), bit, top, depth)

    @classmethod
    def of_turned(cls, keys: np.ndarray, n: np.ndarray, bit: int, top: int, depth: int) -> Tree:
        """The same of strings in the other order."""
        out = cls.__new__(cls)
        out.set(keys, n, bit, top, depth)
        return out

    def set(self, keys: np.ndarray, n: np.ndarray, bit: int, top: int, depth: int) -> None:
        byte = (keys & np.uint64(255)).astype(np.uint8)
        made = byte >> (8 - bit) if bit else np.zeros_like(byte)
        if len(keys) and (keys[1:] < keys[:-1]).any():
            order = np.argsort(keys, kind="stable")
            order = order[np.argsort(made[order], kind="stable")]
        else:
            order = np.argsort(made, kind="stable")
        self.order, keys, made, n = order, keys[order], made[order], n[order]
        value = ((byte[order] >> (7 - bit)) & 1).astype(bool)
        self.value = np.empty(len(value), bool)
        self.value[order] = value
        self.count, self.node_bits = len(keys), 1 << bit
        begin: list[np.ndarray] = []  # where each node's strings begin, from the top
        for d in range(top, depth + 1):
            new = np.ones(len(keys), bool)
            new[1:] = made[1:] != made[:-1]
            if d:
                context = keys >> np.uint64(8 * (depth - d) + 8)
                new[1:] |= context[1:] != context[:-1]
            begin.append(np.flatnonzero(new))
        total, ones = (np.add.reduceat(x, begin[-1]) if len(keys) else x for x in (n, np.where(value, n, 0)))
        self.begin, self.keys, self.made = begin, keys, made
        levels = len(begin)
        self.inner: list[np.ndarray] = [np.zeros(0, int)] * levels  # of each node, its first child
        self.ones, self.zeros, self.own, self.weighted, self.stay = ([np.zeros(0)] * levels for _ in range(5))
        for i in range(levels - 1, -1, -1):
            if i < levels - 1:
                self.inner[i] = np.searchsorted(begin[i + 1], begin[i])
                total, ones = (np.add.reduceat(x, self.inner[i]) if len(keys) else x for x in (total, ones))
            self.ones[i], self.zeros[i] = ones, total - ones
            own = self.own[i] = log_estimate(self.zeros[i], ones)
            if i == levels - 1:
                self.weighted[i], self.stay[i] = own, np.ones(len(own))
            else:
                w = self.weighted[i] = _half_sum(own, np.add.reduceat(self.weighted[i + 1], self.inner[i]) if len(keys) else own)
                self.stay[i] = np.exp(own - np.log(2) - w)

    def mixed(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each deepest node, the probability of a one mixed from the top depth down, and whether the top node was seen."""
        total = self.ones[-1] + self.zeros[-1]
        out, seen = (self.ones[-1] + 0.5) / (total + 1), total > 0
        for i in range(len(self.begin) - 2, -1, -1):
            size = np.diff(np.append(np.searchsorted(self.begin[-1], self.begin[i]), len(self.begin[-1])))
            total = self.ones[i] + self.zeros[i]
            p, stay = np.repeat((self.ones[i] + 0.5) / (total + 1), size), np.repeat(self.stay[i], size)
            out = np.where(seen, stay * p + (1 - stay) * out, p)
            seen = np.repeat(total > 0, size)
        return out, seen

    def of_strings(self, per_node: np.ndarray) -> np.ndarray:
        """What deepest nodes have, for each string in the order given."""
        out = np.empty(self.count, per_node.dtype)
        out[self.order] = np.repeat(per_node, np.diff(np.append(self.begin[-1], self.count)))
        return out

    def predicted(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each key, the mixture from the top depth down for its bit, and whether the top node was seen."""
        one, seen = self.mixed()
        one = self.of_strings(one)
        return np.where(self.value, one, 1 - one), self.of_strings(seen)


#: Bytes of context that packs are of; strings of one with more than MOST are divided by the next byte.
SPLIT = 2
MOST = 1 << 21
#: Strings that a task works on together, in whole packs.
TOGETHER = 1 << 19
#: Strings of a pair that one task merges, or looks up, when blocks ask for more.
ASKED = 1 << 23

KNOWN = "pair int, third int, n long, keys binary, counts binary"


def _merged(packs: DataFrame, by: list[str], depth: int, most: int, final: bool) -> DataFrame:
    """One pack of each pair (and part): its different strings with their counts; final: divided where there are more than ``most``."""

    def emit(counter: _Counter) -> pd.DataFrame:
        keys, n = counter.result()
        rows = []
        for pair, lo, hi in _by_pair(keys, depth):
            cuts, thirds = [lo, hi], [-1]
            if final and hi - lo > most:
                third = ((keys[lo:hi] >> np.uint64(8 * (depth - 2))) & np.uint64(255)).astype(int)
                new = np.flatnonzero(np.diff(third)) + 1
                cuts, thirds = [lo, *(lo + new).tolist(), hi], third[[0, *new]].tolist()
            for third, a, b in zip(thirds, cuts, cuts[1:]):
                rows.append((pair, third, b - a, pack_keys(keys[a:b], depth), pack_counts(n[a:b])))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in KNOWN.split(", ")])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter, last = _Counter(), None
        for f in frames:
            for this, pair, n, keys, counts in zip(zip(*[f[c] for c in by]), f["pair"], f["n"], f["keys"], f["counts"], strict=True):
                if this != last and counter.size > TOGETHER:
                    yield emit(counter)
                    counter = _Counter()
                if this != last and last is not None and this[0] == last[0]:  # another part of the same pair: not to be mixed
                    yield emit(counter)
                    counter = _Counter()
                last = this
                counter.put(unpack_keys(keys, n, pair, depth), unpack_counts(counts, n))
        yield emit(counter)

    return packs.repartition(base.parts(packs.sparkSession), *by).sortWithinPartitions(*by).mapInPandas(run, KNOWN)


def _known(asked: DataFrame, salts: DataFrame, depth: int, most: int) -> DataFrame:
    """All different strings with their counts, packed by pair; those of very frequent pairs are merged in parts first."""
    asked = asked.join(salts, "pair", "left").withColumn("salt", F.pmod("block", F.coalesce("salts", F.lit(1))))
    plain = asked.where("salts is null").select("pair", "n", "keys", "counts")
    parts = _merged(asked.where("salts is not null"), ["pair", "salt"], depth, most, False).select("pair", "n", "keys", "counts")
    return _merged(plain.unionByName(parts) if not salts.isEmpty() else plain, ["pair"], depth, most, True)


SUMS = "pair int, divided boolean, node int, zeros double, ones double, weighted double"


def _batches(frames: Iterator[pd.DataFrame], depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(top depth, strings, counts) of whole packs together."""
    held: dict[int, list] = {SPLIT: [], SPLIT + 1: []}
    size = {SPLIT: 0, SPLIT + 1: 0}

    def flush(top: int) -> tuple[int, np.ndarray, np.ndarray]:
        keys, n = (np.concatenate(x) for x in zip(*held[top]))
        held[top], size[top] = [], 0
        return top, keys, n

    for f in frames:
        for pair, third, n, keys, counts in zip(f["pair"], f["third"], f["n"], f["keys"], f["counts"], strict=True):
            top = SPLIT + int(third >= 0)
            held[top].append((unpack_keys(keys, n, pair, depth), unpack_counts(counts, n)))
            size[top] += n
            if size[top] >= TOGETHER:
                yield flush(top)
    for top in held:
        if held[top]:
            yield flush(top)


def _sums(known: DataFrame, depth: int) -> pd.DataFrame:
    """Counts and weighted logarithms of the packs' top nodes, summed by the node above them.

    pair: the last byte alone, or both of a divided pair; node: the bits made after a one.
    At most 256 x 255 rows besides those of divided pairs.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = pd.DataFrame()
        for top, keys, n in _batches(frames, depth):
            keys, n = keys[n > 0], n[n > 0]
            for bit in range(8) if len(keys) else ():
                t = Tree.of_turned(keys, n, bit, top, depth)
                first = t.begin[0]
                above = (t.keys[first] >> np.uint64(8 * (depth - top + 2))).astype(np.int32)
                one = pd.DataFrame({"pair": above, "divided": top > SPLIT, "node": (1 << bit) + t.made[first].astype(np.int32), "zeros": t.zeros[0].astype(float), "ones": t.ones[0].astype(float), "weighted": t.weighted[0]})
                sums = pd.concat([sums, one.groupby(["pair", "divided", "node"], as_index=False).sum()])
            if len(sums) > 1 << 20:
                sums = sums.groupby(["pair", "divided", "node"], as_index=False).sum()
        if len(sums):
            yield sums.groupby(["pair", "divided", "node"], as_index=False).sum()

    found = known.mapInPandas(run, SUMS)
    return found.groupBy("pair", "divided", "node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "weighted")]).toPandas()


class Top:
    """The nodes above the packs: of no context, of one byte, and of divided pairs."""

    def __init__(self, sums: pd.DataFrame):
        pairs = sums[sums["divided"]]
        self.pairs = np.unique(pairs["pair"].to_numpy(int))
        ones, zeros, below = np.zeros((3, 256, 256))
        levels = []
        if len(self.pairs):
            z, o, w = np.zeros((3, len(self.pairs), 256))
            at = (np.searchsorted(self.pairs, pairs["pair"]), pairs["node"].to_numpy(int))
            z[at], o[at], w[at] = (pairs[c].to_numpy() for c in ("zeros", "ones", "weighted"))
            levels.append(self._level(z, o, w))
            for x, y in ((zeros, z), (ones, o), (below, np.where(z + o > 0, levels[0][3], 0.0))):
                np.add.at(x, self.pairs >> 8, y)
        rest = sums[~sums["divided"].astype(bool)]
        at = (rest["pair"].to_numpy(int), rest["node"].to_numpy(int))
        for x, c in ((zeros, "zeros"), (ones, "ones"), (below, "weighted")):
            np.add.at(x, at, rest[c].to_numpy(float))
        one = self._level(zeros, ones, below)
        none = self._level(zeros.sum(0), ones.sum(0), one[3].sum(0))
        self.levels = [x[:3] for x in [*levels, one, none]]

    @staticmethod
    def _level(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, ...]:
        """Weight of the own estimate, probability of a one, number of bits, weighted logarithm."""
        own = log_estimate(zeros, ones)
        w = _half_sum(own, below)
        return np.exp(own - np.log(2) - w), (ones + 0.5) / (zeros + ones + 1), zeros + ones, w

    def mixed(self, one: np.ndarray, seen: np.ndarray, pair: np.ndarray, node: np.ndarray, divided: bool) -> np.ndarray:
        """The probability of a one, mixed further up to no context."""
        where = [(pair >> 8, node), (node,)]
        if divided:
            where.insert(0, (np.searchsorted(self.pairs, pair), node))
        for (stay, p, n), at in zip(self.levels[-len(where):], where):
            one = np.where(seen, stay[at] * p[at] + (1 - stay[at]) * one, p[at])
            seen = n[at] > 0
        return one


def predictions(keys: np.ndarray, n: np.ndarray, top: Top, first: int, depth: int) -> np.ndarray:
    """log10 of the probability of each string's byte in its context; the strings are turned and sorted."""
    total = np.zeros(len(keys))
    for bit in range(8):
        t = Tree.of_turned(keys, n, bit, first, depth)
        at = t.begin[-1]
        one, seen = t.mixed()
        pair = (t.keys[at] >> np.uint64(8 * (depth - 1))).astype(int)
        one = t.of_strings(top.mixed(one, seen, pair, (1 << bit) + t.made[at].astype(int), first > SPLIT))
        total += np.log10(np.where(t.value, one, 1 - one))
    return total


ANSWERS = "block int, pair int, n long, keys binary, answers binary"


def _scored_strings(stored: DataFrame, depth: int, most: int) -> str:
    """Path of the blocks' answers: packs of strings and log10 probabilities."""
    spark = stored.sparkSession
    asked = base.stored(_gathered_strings(stored, depth), "strings")
    sizes = asked.groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") > ASKED)
    salts = base.stored(sizes.select("pair", F.ceil(F.col("n") / ASKED).cast("int").alias("salts")), "salts")
    known = base.stored(_known(asked, salts, depth, most), "known")
    top = spark.sparkContext.broadcast(Top(_sums(known, depth)))
    divided = frozenset(top.value.pairs.tolist())

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Questions about divided pairs, by the third byte."""
        for f in frames:
            rows = []
            for block, pair, salt, n, data in zip(f["block"], f["pair"], f["salt"], f["n"], f["keys"], strict=True):
                if pair not in divided:
                    rows.append((pair, -1, salt, 1, block, n, data, None))
                    continue
                keys = unpack_keys(data, n, pair, depth)
                third = ((keys >> np.uint64(8 * (depth - 2))) & np.uint64(255)).astype(int)
                cuts = [0, *(np.flatnonzero(np.diff(third)) + 1).tolist(), n]
                rows += [(pair, int(third[a]), salt, 1, block, b - a, pack_keys(keys[a:b], depth), None) for a, b in zip(cuts, cuts[1:])]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in both.split(", ")])

    both = "pair int, third int, salt int, asks int, block int, n long, keys binary, counts binary"
    salt = F.pmod("block", F.coalesce("salts", F.lit(1)))
    asks = asked.select("block", "pair", "n", "keys").join(salts, "pair", "left").select("block", "pair", salt.alias("salt"), "n", "keys").mapInPandas(split, both)
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt")
    told = known.join(salts, "pair", "left").select("pair", "third", copies, F.lit(0).alias("asks"), F.lit(None).cast("int").alias("block"), "n", "keys", "counts")

    def answer(held: list[tuple], first: int) -> Iterator[pd.DataFrame]:
        """held: of packs in a row, strings and counts, then who asks."""
        keys, n = (np.concatenate(x) for x in zip(*[x[:2] for x in held]))
        value = predictions(keys, n, top.value, first, depth)
        lo = 0
        for own, _, asking in held:
            mine = value[lo:lo + len(own)]
            lo += len(own)
            out = [(block, pair, k, data, pack_values(mine[np.searchsorted(own, unpack_keys(data, k, pair, depth))])) for block, pair, k, data in asking]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in ANSWERS.split(", ")])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {SPLIT: [], SPLIT + 1: []}
        size, last = {SPLIT: 0, SPLIT + 1: 0}, None
        for f in frames:
            for pair, third, asks, block, n, keys, counts in zip(f["pair"], f["third"], f["asks"], f["block"], f["n"], f["keys"], f["counts"], strict=True):
                first = SPLIT + int(third >= 0)
                if asks:
                    held[first][-1][2].append((int(block), pair, n, keys))
                    size[first] += n >> 3
                    continue
                if held[first] and (size[first] >= TOGETHER or (pair, third) == last):  # the same again: for other blocks
                    yield from answer(held[first], first)
                    held[first], size[first] = [], 0
                last = (pair, third)
                held[first].append((unpack_keys(keys, n, pair, depth), unpack_counts(counts, n), []))
                size[first] += n
        for first in held:
            if held[first]:
                yield from answer(held[first], first)

    keys = ("pair", "third", "salt")
    met = told.unionByName(asks).repartition(base.parts(spark), *keys).sortWithinPartitions(*keys, "asks")
    return _answered(met.mapInPandas(run, ANSWERS), "string_answers")


def _scored_words(stored: DataFrame) -> tuple[str, int, int]:
    """Path of the blocks' answers (key, value: training count), number of training tokens, and of different ones."""
    from pyspark.sql import Window

    by_key = Window.partitionBy("key")
    rows = _gathered_words(stored).withColumns({"value": F.sum("n").over(by_key), "first": F.row_number().over(by_key.orderBy("block")) == 1})
    path = _answered(rows.select("block", "key", "value", "first"), "word_answers")
    found = stored.sparkSession.read.schema("key long, value long, first boolean, block int").parquet(path)
    total, different = found.where("first").agg(F.coalesce(F.sum("value"), F.lit(0)), F.count_if(F.col("value") > 0)).first()
    return path, total, different


SCORES = "doc_id long, held_out boolean, n_bytes long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(docs: DataFrame, *, depth: int = DEPTH, modulus: int = 7, held_out: int = 2, most: int = MOST) -> DataFrame:
    """doc_id, held_out, n_bytes, n_tokens, n_known, train_tokens, base_score, score (log10), bits_per_byte.

    Learns from the texts whose crc32(doc_id) modulo ``modulus`` is not ``held_out``.
    """
    if not SPLIT < depth <= DEEPEST:
        raise ValueError("depth must be from 3 to 7 bytes")
    stored = blocks(docs, modulus, held_out)
    strings = _scored_strings(stored, depth, most)
    words, total, different = _scored_words(stored)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in base.text_blocks(batches):
            of_block = np.asarray(batch.column("block"))
            for b in np.unique(of_block):
                if held is None or held[0] != b:
                    held = (b, *_string_answers(strings, int(b), depth), *_answers(words, int(b)))
                mine = batch.filter(pa.array(of_block == b))
                yield _scores(mine, held[1:], total, different, depth)

    out = stored.mapInArrow(run, SCORES)
    bits = F.when(F.col("n_bytes") > 0, -F.col("score") / (F.lit(_LOG10_2) * F.col("n_bytes")))
    return out.withColumn("bits_per_byte", bits)


def _scores(batch: pa.RecordBatch, answers: tuple, total: int, different: int, depth: int) -> pa.RecordBatch:
    string_keys, string_values, known_words, counts = answers
    keys, off = grams(batch, depth)
    value = np.concatenate([[0.0], np.cumsum(string_values[_found(string_keys, keys)] if len(keys) else [])])
    score = value[off[1:]] - value[off[:-1]]
    words, at = word_keys(batch)
    c = counts[np.searchsorted(known_words, words)].astype(np.int64) if len(words) else np.zeros(0, np.int64)
    end = int(counts[np.searchsorted(known_words, np.uint64(END))])
    n = np.diff(at) + 1
    logs = np.concatenate([[0.0], np.cumsum(np.log10(c + 1.0))])
    seen = np.concatenate([[0], np.cumsum(c > 0)])
    base_score = logs[at[1:]] - logs[at[:-1]] + np.log10(end + 1.0) - n * np.log10(total + different + 1.0)
    known = seen[at[1:]] - seen[at[:-1]] + int(end > 0)
    return pa.RecordBatch.from_arrays([
        batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(off).astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)),
        pa.array(np.full(len(n), total, np.int64)), pa.array(base_score), pa.array(score),
    ], names=[x.split()[0] for x in SCORES.split(", ")])
