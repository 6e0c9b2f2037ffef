"""What the corpus operators share: scratch tables, code shipping, byte tools.

Scratch tables go to the folder named by ``spark.checkpoint.dir``, which every
executor of a cluster sees, so that a lost executor costs a recomputation of
its tasks only.  A folder of our own is made only where that setting is unset.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; a batch is cut further by bytes in text_blocks().
ARROW_ROWS = 2000
#: Text bytes that the array code looks at together.
BLOCK_BYTES = 1 << 19

_shipped: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Ship this package to the Python workers (once per application)."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp()) / "verdance_workers.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the cluster, or a folder of our own in local tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="verdance-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


_scopes: list[str] = []


def _folder(spark: SparkSession) -> str:
    return "/".join([shared_root(spark), "verdance", spark.sparkContext.applicationId, *_scopes])


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def delete(spark: SparkSession, uri: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Scratch tables that are made within go at its end; what is to stay is written to a path made outside."""
    _scopes.append(uuid.uuid4().hex[:12])
    try:
        yield
    finally:
        mine = _folder(spark)
        _scopes.pop()
        delete(spark, mine)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Delete the application's scratch tables, once nothing that reads them is used any more."""
    delete(spark, f"{shared_root(spark)}/verdance/{spark.sparkContext.applicationId}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_key() -> F.Column:
    """Hash that, with doc_id, names a row; rows equal in both are the same text."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def whole_row(df: DataFrame) -> F.Column:
    """All columns as one struct, so that no name of theirs meets one of ours; columns_of() undoes it."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row")


def columns_of(df: DataFrame) -> list[tuple[str, F.Column]]:
    """The columns that whole_row() of this table has put away, by name."""
    return [(c, F.col("__row").getField(c).alias(c)) for c in df.columns]


# --- bytes -------------------------------------------------------------------

def text_blocks(batches: Iterable[pa.RecordBatch], column: str = "text", budget: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most budget text bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        end, lo = np.cumsum(size), 0
        while lo < len(size):
            base = end[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(end, base + budget, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One uint8 array of all texts (null: empty) and where each begins and ends."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse."""
    if len(_powers[0]) <= n:
        for i, b in enumerate((_BASE, _INVERSE)):
            a = np.full(max(n + 1, 1 << 16), b, np.uint64)
            a[0] = 1
            _powers[i] = np.cumprod(a, dtype=np.uint64)
    return _powers[0][:n + 1], _powers[1][:n + 1]


class RangeHash:
    """Hashes of any ranges of a sequence of 64-bit values, in constant time each."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        up, self.down = _power(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.down[lo])

    def rolling(self, k: int) -> np.ndarray:
        """Hash of values[i:i+k] for every i at which it fits."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes stay."""
    return _LOWER[buf]


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word [^\\x20\\x09-\\x0D]+ begins and ends, and offsets of texts in words."""
    solid = ~_SPACE[buf]
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    first = off[:-1][off[:-1] < off[1:]]
    begin[first] = solid[first]
    last = off[1:][off[:-1] < off[1:]] - 1
    end[last] = solid[last]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(end) + 1, np.searchsorted(start, off)


def word_hashes(buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit name for each word's bytes."""
    h = RangeHash(BYTE_VALUE[buf])(start, stop)
    return mix(h + (stop - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def owner(off: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Index of the text that holds each position."""
    return np.searchsorted(off, position, side="right") - 1


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def whole_groups(frames: Iterable, by: list[str], most: int) -> Iterator:
    """pandas frames of whole groups, about ``most`` rows each, from frames that are sorted by group."""
    import pandas as pd

    held: list = []
    size = 0
    for frame in frames:
        if not len(frame):
            continue
        held.append(frame)
        size += len(frame)
        if size >= most and (held[0][by].iloc[0] != frame[by].iloc[-1]).any():  # else all one group: not put together anew for each frame
            f = pd.concat(held, ignore_index=True)
            last = (f[by] == f[by].iloc[-1]).all(axis=1)
            yield f[~last].reset_index(drop=True)
            held = [f[last]]
            size = len(held[0])
    if size:
        yield pd.concat(held, ignore_index=True)
