"""Deterministic sharded WARC archives of pages, with revisit records.

Records are range-sorted by page_id and digest.  Shards are stretches of that
order, cut where the running sum of payload bytes passes multiples of a size that
the total alone fixes, so they do not depend on how Spark has dealt the rows.
Each record is a gzip member of its own; within a shard a file rolls when its
compressed size passes the limit.  Headers and digests are made anew from the
payload and the page alone: the same pages give the same files, byte for byte.  A
task writes under temporary names that hold its attempt; the job's rows name the
files of the attempts that count, those are renamed, and the manifest is written
last.

Of pages with equal payloads of at least ``least`` bytes the one with the
smallest page_id is the response and the others revisit it; a revisit record
keeps the HTTP head, with the payload's length, and its digest.

Cases: a null html is an empty payload; a null url becomes urn:page:<id>; a null
page_id sorts first, is spread over shards by digest and is never the page referred
to unless all of its group are null, which then are responses; repeated rows with the smallest page_id are
all responses; control characters in a url are percent-encoded; further columns
are ignored; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import base, store

LEAST = 100
ROLL_BYTES = 256 << 20
#: Payload bytes of a shard: a 64th of the total within these bounds.
SHARD_LEAST, SHARD_MOST, SHARDS = 4 << 20, 1 << 30, 64
#: What a record counts besides its payload.
RECORD_BYTES = 512
DATE = "2020-01-01T00:00:00Z"
LEVEL = 4
_SPACE = uuid.UUID("6f0c8a52-3c1d-4b0e-9a57-0d9a6f0f7c11")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digested(pages: DataFrame) -> DataFrame:
    """page_id, url, html (binary), digest."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page_id", "url", payload.alias("html")).withColumn("digest", F.sha2("html", 256))


def keys_of(known: DataFrame) -> DataFrame:
    """page_id, digest, n (payload bytes) of every page."""
    return known.select("page_id", "digest", F.octet_length("html").cast("long").alias("n"))


def shard_starts(keys: DataFrame, shard_bytes: int | None = None) -> list[tuple[bool, int, str]]:
    """The first (has an id, page_id, digest) of each shard, in order; a row for each shard reaches the driver."""
    spark = keys.sparkSession
    each = keys.groupBy("page_id", "digest").agg(F.sum(F.col("n") + RECORD_BYTES).alias("n"))
    # stored with the partition that each row lies in: the running sum over all is that of the partition and those before it
    ranged = each.repartitionByRange(base.parts(spark), "page_id", "digest").withColumn("part", F.spark_partition_id())
    ranged = base.stored(ranged, "sizes")
    before, total = [], 0
    for part, n in sorted(map(tuple, ranged.groupBy("part").agg(F.sum("n")).collect())):  # a row for each partition
        before.append((part, total))
        total += n
    size = shard_bytes or min(max(total // SHARDS, SHARD_LEAST), SHARD_MOST)
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("page_id", "digest"))
    placed = ranged.withColumn("upto", upto).join(spark.createDataFrame(before, "part int, before long"), "part")
    shard = F.floor((F.col("before") + F.col("upto") - F.col("n")) / size)
    first = F.min(F.struct(F.col("page_id").isNotNull().alias("there"), F.coalesce("page_id", F.lit(0)).alias("page_id"), "digest"))
    return sorted((r[0], r[1], r[2]) for r in placed.groupBy(shard.alias("shard")).agg(first.alias("first")).select("first.*").collect())


def revisits(keys: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, digest, refers_to of the pages that repeat another's payload."""
    keys = keys.where(F.col("n") >= least)
    firsts = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "refers_to")
    firsts = base.stored(firsts, "firsts")  # so that a payload of many pages can be split in the join
    return keys.join(firsts, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()


def _clean(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id} {digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One uncompressed WARC record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url) if url else f'urn:page:{page_id}'}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        head.append(f"X-Page: {page_id}")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


MANIFEST = "shard int, roll int, temporary string, uri string, records long, bytes long, sha256 string"


class _File:
    def __init__(self, uri: str, shard: int, roll: int, attempt: str):
        self.key, self.closed = (shard, roll), False
        self.uri = f"{uri}/pages-{shard:06d}-{roll:04d}.warc.gz"
        self.temporary = f"{self.uri}.{attempt}.tmp"
        self.out, self.sum, self.records, self.bytes = store.create(self.temporary), hashlib.sha256(), 0, 0
        info = f"software: verdance\r\nformat: WARC File Format 1.1\r\nshard: {shard}\r\nroll: {roll}\r\n".encode()
        name = f"<urn:uuid:{uuid.uuid5(_SPACE, f'info {shard} {roll}')}>"
        self.add(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {name}\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n", 0)

    def add(self, data: bytes, counts: int = 1) -> None:
        z = _member(data)
        self.out.write(z)
        self.sum.update(z)
        self.records += counts
        self.bytes += len(z)

    def close(self) -> tuple:
        self.out.close()
        self.closed = True
        return (*self.key, self.temporary, self.uri, self.records, self.bytes, self.sum.hexdigest())


def write(pages: DataFrame, uri: str, *, least: int = LEAST, roll_bytes: int = ROLL_BYTES, shard_bytes: int | None = None) -> DataFrame:
    """Write the archive under uri and return its manifest.  shard_bytes: payload of a shard, if not by the total."""
    spark = base.prepare(pages.sparkSession)
    store.make_dir(uri)

    def archive(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        attempt, file, rows = uuid.uuid4().hex[:12], None, []
        marked, number = (None, None, None), lambda x: None if pd.isna(x) else int(x)
        for f in frames:
            for shard, page_id, url, html, digest, refers_to in zip(f["shard"], f["page_id"], f["url"], f["html"], f["digest"], f["refers_to"], strict=True):
                if html is None:  # a marker: what follows with this id and digest is a revisit
                    marked = (page_id, digest, refers_to)
                    continue
                refers_to = marked[2] if marked[:2] == (page_id, digest) else None
                if file is not None and (file.key[0] != shard or file.bytes >= roll_bytes):
                    rows.append(file.close())
                if file is None or file.closed:
                    file = _File(uri, shard, file.key[1] + 1 if file is not None and file.key[0] == shard else 0, attempt)
                file.add(record(number(page_id), url, bytes(html), digest, number(refers_to)))
        if file is not None:
            rows.append(file.close())
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in MANIFEST.split(", ")])

    known = digested(pages)
    keys = base.stored(keys_of(known), "keys")
    starts = spark.sparkContext.broadcast(shard_starts(keys, shard_bytes))  # a row for each shard, at most a 64th or a gigabyte of the payload

    @F.pandas_udf("int")
    def shard_of(there: pd.Series, page_id: pd.Series, digest: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(starts.value, x) - 1 for x in zip(there, page_id, digest)], dtype="int32")

    # markers travel with the pages through one shuffle and sort right before them: payloads are moved once
    markers = revisits(keys, least).select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("html"), "digest", "refers_to")
    both = known.withColumn("refers_to", F.lit(None).cast("long")).unionByName(markers)
    both = both.withColumn("shard", shard_of(F.col("page_id").isNotNull(), F.coalesce("page_id", F.lit(0)), "digest"))
    n_shards = max(1, len(starts.value))
    n = min(n_shards, base.parts(spark))
    dealt = both.repartitionById(n, F.floor(F.col("shard") * n / n_shards).cast("int"))  # shards in a row, evenly
    ready = dealt.sortWithinPartitions("shard", "page_id", "digest", F.col("html").isNotNull(), "url")
    # ids beyond 2**53 would lose digits as floats, which nulls turn integers into
    ready = ready.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    files = sorted(map(tuple, ready.mapInPandas(archive, MANIFEST).collect()))  # a row for each file
    manifest = spark.createDataFrame(files, MANIFEST)
    if files:
        def commit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for old, new in zip(f["temporary"], f["uri"], strict=True):
                    store.rename(old, new)
                yield f

        renamed = manifest.repartitionByRange(min(len(files), base.parts(spark)), "shard", "roll").mapInPandas(commit, MANIFEST)
        renamed.drop("temporary").write.mode("overwrite").parquet(f"{uri}/manifest")
    else:
        manifest.drop("temporary").write.mode("overwrite").parquet(f"{uri}/manifest")
    return manifests(spark, uri)


def manifests(spark: SparkSession, uri: str) -> DataFrame:
    return spark.read.parquet(f"{uri}/manifest")


@dataclass
class Entry:
    """A record as read: its header fields and its block."""

    fields: dict[str, str] = field(default_factory=dict)
    block: bytes = b""

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]

    @property
    def http(self) -> dict[str, str]:
        lines = self.block.partition(b"\r\n\r\n")[0].decode("latin-1").split("\r\n")[1:]
        return dict(x.split(": ", 1) for x in lines)


def _members(uri: str, chunk: int = 1 << 20) -> Iterator[bytes]:
    with store.open_read(uri) as f:
        rest = b""
        while rest or (rest := f.read(chunk)):
            z, out = zlib.decompressobj(31), []
            while not z.eof:
                if not rest and not (rest := f.read(chunk)):
                    raise ValueError(f"{uri}: cut off")
                out.append(z.decompress(rest))
                rest = z.unused_data
            yield b"".join(out)


def read_file(uri: str) -> Iterator[Entry]:
    """The records of one file; lengths, block digests and payload digests are verified."""
    for data in _members(uri):
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode("utf-8").split("\r\n")
        e = Entry(dict(x.split(": ", 1) for x in lines[1:]))
        n = int(e.fields["Content-Length"])
        e.block = rest[:n]
        if lines[0] != "WARC/1.1" or rest[n:] != b"\r\n\r\n":
            raise ValueError(f"{uri}: a record is malformed")
        if (d := e.fields.get("WARC-Block-Digest")) and d != f"sha1:{base64.b32encode(hashlib.sha1(e.block).digest()).decode()}":
            raise ValueError(f"{uri}: a block digest is wrong")
        if e.fields["WARC-Type"] == "response" and e.fields["WARC-Payload-Digest"] != f"sha256:{hashlib.sha256(e.payload).hexdigest()}":
            raise ValueError(f"{uri}: a payload digest is wrong")
        yield e


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, uri string"


def read(manifest: DataFrame) -> DataFrame:
    """One row for each response or revisit record of the archive."""
    base.prepare(manifest.sparkSession)
    n = max(1, manifest.count())

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for uri in f["uri"]:
                rows = []
                for e in read_file(uri):
                    if e.fields["WARC-Type"] == "warcinfo":
                        continue
                    h = e.fields
                    rows.append((h.get("X-Page"), int(e.http["Content-Length"]), h["WARC-Payload-Digest"].removeprefix("sha256:"), h["WARC-Type"], h.get("X-Refers-To-Page"), h["WARC-Target-URI"], uri))
                out = pd.DataFrame(rows, columns=[x.split()[0] for x in READ.split(", ")])
                for c in ("page_id", "refers_to"):
                    out[c] = pd.array([None if x is None else int(x) for x in out[c]], dtype="Int64")
                yield out

    return manifest.select("shard", "roll", "uri").repartitionByRange(n, "shard", "roll").mapInPandas(parse, READ)
