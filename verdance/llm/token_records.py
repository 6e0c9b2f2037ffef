"""Length-delimited binary records of token ids, with an index for shuffled reads.

A shard file is a 16-byte head (magic, width of an id) and then one frame for
each document:

    u64 length | u32 masked crc of the length | payload | u32 masked crc of the payload

All integers are little-endian; the payload is a flag byte (1: the document has
an id), the document's id as i64 and its token ids in 2 bytes each where the
vocabulary allows, else 4.  The checksum is CRC-32, masked by a rotation and an
added constant so that checksums of data that holds checksums stay useful.
Beside each shard lies an index of (u64 offset, u32 ids) for each record: a
reader can seek to any record without scanning.

Writers use names of their own attempt; a shard counts once its name is in the
manifest, so a lost executor or a second attempt leaves no half-written shard.

Cases: a null text is empty and has the end id alone; null doc_ids sort first;
rows with equal doc_ids are ordered by their text; columns other than doc_id and
text are ignored; an empty table gives no shards and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base, store
from .tokenizing import encoder

MAGIC = b"VTREC001"
END = bytes(4)  # the end id, 0
SHARD_BYTES = 256 << 20
_HEAD = struct.Struct("<8sII")
_LENGTH = struct.Struct("<Q")
_SUM = struct.Struct("<I")
_KEY = struct.Struct("<?q")
_ENTRY = np.dtype([("offset", "<u8"), ("ids", "<u4")])


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    n = _LENGTH.pack(len(payload))
    return b"".join((n, _SUM.pack(masked(n)), payload, _SUM.pack(masked(payload))))


@dataclass(frozen=True)
class Record:
    doc_id: int | None
    ids: np.ndarray  # little-endian unsigned 32-bit


class ShardWriter:
    """Writes one shard and its index."""

    def __init__(self, uri: str, width: int):
        self.uri, self.width, self.at, self.ids = uri, width, _HEAD.size, 0
        self.out = store.create(uri)
        self.out.write(_HEAD.pack(MAGIC, width, 0))
        self.entries: list[tuple[int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian, in the shard's width."""
        data = frame(_KEY.pack(doc_id is not None, doc_id or 0) + ids)
        self.out.write(data)
        n = len(ids) // self.width
        self.entries.append((self.at, n))
        self.at += len(data)
        self.ids += n

    def close(self) -> None:
        self.out.close()
        store.put(self.uri + ".index", np.array(self.entries, dtype=_ENTRY).tobytes())


def _need(data: bytes, n: int, uri: str) -> bytes:
    if len(data) != n:
        raise ValueError(f"{uri}: cut off")
    return data


def _record(f, width: int, uri: str) -> Record | None:
    head = f.read(_LENGTH.size)
    if not head:
        return None
    n = _LENGTH.unpack(_need(head, _LENGTH.size, uri))[0]
    if _SUM.unpack(_need(f.read(_SUM.size), _SUM.size, uri))[0] != masked(head):
        raise ValueError(f"{uri}: the checksum of a length is wrong")
    payload = _need(f.read(n), n, uri)
    if _SUM.unpack(_need(f.read(_SUM.size), _SUM.size, uri))[0] != masked(payload):
        raise ValueError(f"{uri}: the checksum of a record is wrong")
    there, doc_id = _KEY.unpack_from(payload)
    return Record(doc_id if there else None, np.frombuffer(payload, f"<u{width}", offset=_KEY.size).astype("<u4"))


def read_shard(uri: str) -> Iterator[Record]:
    """All records in order; every checksum is verified."""
    with store.open_read(uri) as f:
        magic, width, _ = _HEAD.unpack(_need(f.read(_HEAD.size), _HEAD.size, uri))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        while (r := _record(f, width, uri)) is not None:
            yield r


def read_index(uri: str) -> np.ndarray:
    return np.frombuffer(store.get(uri + ".index"), dtype=_ENTRY)


def read_records(uri: str, positions: np.ndarray) -> Iterator[Record]:
    """The records at these positions of the shard, in the given order, by its index."""
    index = read_index(uri)
    with store.open_random(uri) as f:
        width = _HEAD.unpack(f.read(_HEAD.size))[1]
        for p in positions:
            f.seek(int(index["offset"][p]))
            yield _record(f, width, uri)


MANIFEST = "part int, roll int, uri string, records long, ids long"


def write(docs: DataFrame, vocabulary: str, uri: str, *, keeps_space: bool = True, vocabulary_size: int = 50_257, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode documents in ascending doc_id order into shards under uri.

    Returns the manifest in shard order: part, roll, uri, records, ids and
    start, the number of ids before the shard.
    """
    spark = base.prepare(docs.sparkSession)
    store.make_dir(uri)
    width = 2 if vocabulary_size <= 1 << 16 else 4
    narrow = f"<u{width}"

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        encode, writer, rows = encoder(vocabulary, keeps_space).encode, None, []

        def close() -> None:
            writer.close()
            rows.append((part, len(rows), writer.uri, len(writer.entries), writer.ids))

        for batch in base.text_blocks(batches, budget=4 << 20):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(texts), strict=True):
                if writer is not None and writer.at >= shard_bytes:
                    close()
                    writer = None
                if writer is None:
                    writer = ShardWriter(f"{uri}/shard-{part:06d}-{len(rows):04d}-{attempt}.bin", width)
                writer.add(doc_id, np.frombuffer(ids + END, "<u4").astype(narrow).tobytes())
        if writer is not None:
            close()
        yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["part", "roll", "uri", "records", "ids"]), schema=pa.schema([("part", pa.int32()), ("roll", pa.int32()), ("uri", pa.string()), ("records", pa.int64()), ("ids", pa.int64())]), preserve_index=False)

    # the first characters too, so that many rows of one id, or of none, are not one task's
    ordered = docs.select("doc_id", "text").repartitionByRange(base.parts(spark), "doc_id", F.substring("text", 1, 40)).sortWithinPartitions("doc_id", "text")
    found = sorted(map(tuple, ordered.mapInArrow(shards, MANIFEST).collect()))  # a row for each shard file
    start, rows = 0, []
    for row in found:
        rows.append((*row, start))
        start += row[4]
    manifest = spark.createDataFrame(rows, MANIFEST + ", start long")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{uri}/manifest")
    return manifest


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read(manifest: DataFrame) -> DataFrame:
    """Per record of the shards: doc_id, start (ids before it), n_tokens, ids_crc32."""
    base.prepare(manifest.sparkSession)
    n = max(1, manifest.count())

    def records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for shards in frames:
            for uri, start in zip(shards["uri"], shards["start"], strict=True):
                rows, at = [], int(start)
                for r in read_shard(uri):
                    rows.append((r.doc_id, at, len(r.ids), zlib.crc32(r.ids.tobytes())))
                    at += len(r.ids)
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)

    return manifest.select("uri", "start").repartitionByRange(n, "start").mapInPandas(records, READ)


def _rows(rows: list[tuple]) -> pd.DataFrame:
    d, s, n, c = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pd.DataFrame({"doc_id": pd.array(d, dtype="Int64"), "start": np.array(s, "i8"), "n_tokens": np.array(n, "i8"), "ids_crc32": np.array(c, "i8")})


def shuffled(manifest: DataFrame, seed: int) -> DataFrame:
    """(uri, position) of every record in a random order that the seed fixes: an epoch's reading plan."""
    each = manifest.select("uri", F.explode(F.sequence(F.lit(0), F.col("records").cast("int") - 1)).alias("position"))
    return each.orderBy(F.xxhash64("uri", "position", F.lit(seed)), "uri", "position")
