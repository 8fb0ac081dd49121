"""WARC archives: a deterministic sharded writer, and a reader.

Records are range-sorted by (page_id, digest) into shards of about ``SHARD`` bytes.
The borders follow the data: ids, digests and sizes alone are sorted, running sums
of their bytes give the keys at which a shard is full, and only those keys (at most
``SHARDS``) reach the driver. They depend on the records, not on how the input is
partitioned, so an outlying id, a repeated one or many null ids fill no shard of
their own beyond equal records. Each shard is sorted and streamed into gzip files
(one member per record, fixed headers, no clock), rolled at ``ROLL`` compressed
bytes. A task writes each file under a temporary name and renames it when
complete; names and contents are the same in every attempt. The manifest, a table
of all files with their digests, is written last, and readers take the files it
names, one task a file.

Payloads of ``REVISIT`` bytes or more are kept once: the record of the smallest
page_id is the response, others are revisits of it (with the HTTP header alone).

Edge cases: null html is an empty payload; null url gives no target; records
without page_id come first and are written with the id ``null``; of repeated rows
of the smallest page_id all are responses; an empty table gives a manifest
without files; extra columns are ignored.

The target folder must be one that ``pyarrow.fs`` opens on the executors (a
mounted folder, or hdfs, s3, gcs where configured).
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

#: Bytes per rolled file (compressed) and per shard (records, at least); most shards; bytes from which payloads are kept once; most tasks that read.
ROLL, SHARD, SHARDS, REVISIT, READERS = 32 << 20, 32 << 20, 10_000, 100, 20_000
#: Bytes of a record besides its payload, about.
OVERHEAD = 500
#: Fixed values of the format.
VERSION, DATE = "WARC/1.1", "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_FILES = "file string, shard int, records long, bytes long, sha256 string"
_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _digested(pages: DataFrame) -> DataFrame:
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    return own.withColumns({"digest": F.sha2(F.encode("html", "UTF-8"), 256), "size": F.octet_length("html").cast("long")})


def classified(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Who revisits whom, decided and written without the payloads.

    The records (page_id, digest, cost, first) and the distinct revisits (page_id, digest, first) among them; first is
    the response's page_id, null for responses.
    """
    narrow = shared.saved(_digested(pages).select("page_id", "digest", "size"), "digests")
    first = narrow.where(F.col("size") >= REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    first = shared.saved(first, "firsts")  # so that both sides of the join are plain exchanges and a hot payload's rows can be split
    other = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    known = narrow.join(first, "digest", "left").select("page_id", "digest", "size", other.alias("first"))
    known = shared.saved(known.select("page_id", "digest", (F.when(F.col("first").isNull(), F.col("size")).otherwise(0) + OVERHEAD).alias("cost"), "first"), "records")
    return known, shared.saved(known.where("first IS NOT NULL").select("page_id", "digest", "first").distinct(), "revisits")


def borders(known: DataFrame, shard: int = SHARD) -> list[tuple[bool, int, str]]:
    """The keys (page_id is not null, page_id, digest) from which on, in order, each further shard begins."""
    cost = known.agg(F.sum("cost")).first()[0] or 0
    shard = max(shard, -(-cost // SHARDS))
    key = [F.col("page_id").isNotNull().alias("k0"), F.coalesce("page_id", F.lit(0)).alias("k1"), F.col("digest").alias("k2")]
    grouped = known.groupBy(*key).agg(F.sum("cost").alias("cost"))
    parts = shared.saved(grouped.orderBy("k0", "k1", "k2").withColumn("part", F.spark_partition_id()), "sorted")
    sums = dict(parts.groupBy("part").agg(F.sum("cost")).collect())  # one row a partition
    before, at = [], 0
    for part in sorted(sums):
        before.append((part, at))
        at += sums[part]
    before = known.sparkSession.createDataFrame(before, "part int, before long")
    up_to = F.col("before") + F.sum("cost").over(Window.partitionBy("part").orderBy("k0", "k1", "k2"))
    summed = parts.join(F.broadcast(before), "part").withColumn("up_to", up_to)
    full = summed.where(f"up_to - cost > 0 AND (up_to - 1) div {shard} > (up_to - cost - 1) div {shard}")
    return sorted((r[0], r[1], r[2]) for r in full.select("k0", "k1", "k2").collect())  # SHARDS rows at most


def sharded(records: DataFrame, starts: list[tuple[bool, int, str]]) -> DataFrame:
    """``records`` with their shard, sorted within it."""

    @F.pandas_udf("int")
    def shard_of(known: pd.Series, page_id: pd.Series, digest: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(starts, k) for k in zip(known.tolist(), page_id.tolist(), digest.tolist())], dtype="int32")

    dealt = records.withColumn("shard", shard_of(F.col("page_id").isNotNull(), F.coalesce("page_id", F.lit(0)), "digest"))
    return dealt.repartitionById(len(starts) + 1, F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", "url")


def record(page_id, url, payload: bytes, digest: str, size: int, first) -> bytes:
    """One record, uncompressed."""
    block = HTTP.format(size).encode() + (payload if first is None else b"")
    head = [VERSION, f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:warc-page:{'null' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if first is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:warc-page:{first}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _File:
    """A file under a temporary name until it is complete."""

    def __init__(self, folder: str, name: str):
        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.name, self.temporary = name, f"{self.root}/_temporary/{name}.{uuid.uuid4().hex}"
        self.store.create_dir(f"{self.root}/_temporary", recursive=True)
        self.out, self.bytes, self.records, self.sha = self.store.open_output_stream(self.temporary), 0, 0, hashlib.sha256()
        info = f"software: meander\r\nformat: WARC File Format 1.1\r\nfile: {name}\r\n".encode()
        head = f"{VERSION}\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:warc-file:{name}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode()
        self._put(head + info + b"\r\n\r\n")

    def _put(self, data: bytes) -> None:
        packed = gzip.compress(data, 6, mtime=0)
        self.out.write(packed)
        self.sha.update(packed)
        self.bytes += len(packed)

    def add(self, data: bytes) -> None:
        self._put(data)
        self.records += 1

    def close(self) -> tuple[str, int, int, str]:
        self.out.close()
        self.store.move(self.temporary, f"{self.root}/{self.name}")
        return self.name, self.records, self.bytes, self.sha.hexdigest()


def write_warc(pages: DataFrame, folder: str, roll: int = ROLL, shard: int = SHARD) -> DataFrame:
    """Write the archives of ``pages`` (page_id, url, html) to a new folder; returns the manifest."""

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def manifest(shard: int, done: tuple[str, int, int, str]) -> pa.RecordBatch:
            name, records, size, sha = done
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([shard], pa.int32()), pa.array([records]), pa.array([size]), pa.array([sha])], ["file", "shard", "records", "bytes", "sha256"])

        now, part, file = None, 0, None
        for batch in batches:
            for i in range(batch.num_rows):
                shard, page_id, url, html, digest, size, first = (c[i].as_py() for c in batch.columns)
                if file and (shard != now or file.bytes >= roll):
                    yield manifest(now, file.close())
                    file, part = None, part + 1
                if shard != now:
                    now, part = shard, 0
                file = file or _File(folder, f"shard-{shard:06d}-{part:05d}.warc.gz")
                file.add(record(page_id, url, html.encode(), digest, size, first))
        if file:
            yield manifest(now, file.close())

    known, again = classified(pages)
    found = again.select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), "first")
    own = _digested(pages).join(found, F.expr("digest = _d AND page_id <=> _p"), "left").drop("_p", "_d")
    ready = sharded(own, borders(known, shard)).select("shard", "page_id", "url", F.when(F.col("first").isNull(), F.col("html")).otherwise("").alias("html"), "digest", "size", "first")
    ready.mapInArrow(files, _FILES).write.parquet(f"{folder}/_manifest")
    return pages.sparkSession.read.schema(_FILES).parquet(f"{folder}/_manifest")


def _members(stream) -> Iterator[bytes]:
    """The uncompressed gzip members of a stream, one at a time."""
    engine, out, data = zlib.decompressobj(31), [], b""
    while data or (data := stream.read(1 << 18)):
        out.append(engine.decompress(data))
        data = engine.unused_data
        if engine.eof:
            yield b"".join(out)
            engine, out = zlib.decompressobj(31), []
    if any(out):
        raise ValueError("the archive ends within a record")


def parse(member: bytes) -> tuple | None:
    """(page_id, url, payload bytes, digest, type, refers to) of a record; None for a warcinfo. Checks the digests."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    if lines[0] != VERSION:
        raise ValueError(f"not a WARC record: {lines[0][:40]}")
    if fields["WARC-Type"] == "warcinfo":
        return None
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: ")).split(": ")[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    if fields["WARC-Type"] == "response" and (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, size):
        raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
    number = lambda x: None if x is None or (n := x[len("<urn:warc-page:") : -1]) == "null" else int(n)
    url = fields.get("WARC-Target-URI")
    url = url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return number(fields["WARC-Record-ID"]), url, size, digest, fields["WARC-Type"], number(fields.get("WARC-Refers-To"))


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the archives that the folder's manifest names."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _READ.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found: list[tuple] = []
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for member in _members(stream):
                        if r := parse(member):
                            found.append(r)
                            count -= 1
                        if len(found) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate(kinds)], names)
                            found = []
                if count:
                    raise ValueError(f"{name} lacks {count} records of its manifest")
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate(kinds)], names)

    manifest = spark.read.schema(_FILES).parquet(f"{folder}/_manifest").select("file", "records")
    # dealt in turn, not by size: a row here is a file to read
    return manifest.repartition(max(1, min(manifest.count(), READERS))).mapInArrow(rows, _READ)


def query(spark, sf_dir: str) -> DataFrame:
    folder = shared.new_path(spark, "warc")
    write_warc(shared.table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder).drop("url")


ORACLE_SQL = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {REVISIT} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {REVISIT} AND page_id <> first THEN first END AS refers_to
FROM f"""
