"""WARC archives as a chunked record table.

An archive is a Parquet table of rows (archive, record_no, record_id, chunk_no, last, data, payload_sha1): the data of a record's
rows, in order, is its gzip member, and the members of an archive in order are a .warc.gz file. A record is compressed
and hashed piece by piece, and a row leaves for each piece: compression is flushed there, so that the rows up to one
decode to exactly the payload whose digest that row carries. A reader checks every row as it comes and stops at the
first that is damaged. Neither side joins a record's chunks together.

The table goes through Spark's writer, so the archives lie wherever the shared folder lies. Rows of a record are
written one after the other, but a reader may split a file anywhere: records of several chunks are dealt anew and their
chunks sorted. A record of one chunk is whole wherever it is read, and stays there.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove, scratch, stage

#: Bytes of the payload that a chunk row holds
CHUNK_BYTES = 64 << 10
#: Payloads of fewer bytes are stored again for every record
REVISIT_FROM = 1000
RECORDS = "archive string, record_no bigint, record_id string, chunk_no int, last boolean, data binary, payload_sha1 string"
READ = "record_id string, page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_uri(page_id: int | None) -> str:
    return f"urn:uuid:{uuid.uuid5(_NAMESPACE, f'page {page_id}')}"


def header(page_id: int | None, url: str | None, kind: str, refers_to: int | None, digest: str, payload: int, length: int) -> bytes:
    """A WARC/1.1 header. Digests are bare lower-case hex after the name of the hash."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_uri(page_id)}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {payload}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {length}",
    ]
    if url is not None:
        # a line break in a URL would end the header line
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{record_uri(refers_to)}>",
            f"X-Refers-To-Page: {refers_to}",
        ]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def chunks(head: bytes, payload: bytes | memoryview, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[bytes, bool, str]]:
    """(data, last, digest so far) for one record: its gzip member in rows of chunk_bytes of payload."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    digest = hashlib.sha1()
    held = packer.compress(head)
    view = memoryview(payload)
    for k in range(0, max(len(view), 1), chunk_bytes):
        part = view[k : k + chunk_bytes]
        digest.update(part)
        held += packer.compress(part)
        last = k + chunk_bytes >= len(view)
        held += packer.compress(b"\r\n\r\n") + packer.flush() if last else packer.flush(zlib.Z_SYNC_FLUSH)
        yield held, last, digest.hexdigest()
        held = b""


def plan(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, record_type, refers_to) for pages (page_id, url, html).

    Of records with equal payloads of REVISIT_FROM bytes or more, the one with the largest page_id is the response.
    Only digests are grouped, combined before the shuffle; payloads are joined to them, which Spark can split where one
    payload has a large share of all pages.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= REVISIT_FROM
    best = rows.where(large).groupBy("digest").agg(F.max("page_id").alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    out = rows.join(best, "digest", "left")
    revisit = F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best"))
    return out.select(
        "page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("best")).alias("refers_to")
    )


def write(records: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write planned records as chunk rows; one archive for each partition."""
    records = records.select(F.spark_partition_id().alias("archive"), "page_id", "url", "payload", "digest", "record_type", "refers_to")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, record_no = 0, 0
        for batch in batches:
            archive, page_id, url, payload, digest, kind, refers_to = batch.columns
            for k in range(batch.num_rows):
                body = memoryview(payload[k].as_buffer())
                page, what = page_id[k].as_py(), kind[k].as_py()
                stored = b"" if what == "revisit" else body
                head = header(page, url[k].as_py(), what, refers_to[k].as_py(), digest[k].as_py(), len(body), len(stored))
                for number, (data, last, sofar) in enumerate(chunks(head, stored, chunk_bytes)):
                    rows.append((f"{archive[k].as_py():06d}", record_no, record_uri(page), number, last, data, sofar))
                    size += len(data)
                    if size >= 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                record_no += 1
        if rows:
            yield _batch(rows)

    records.mapInArrow(run, RECORDS).write.option("compression", "uncompressed").parquet(path)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.string())
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["archive", "record_no", "record_id", "chunk_no", "last", "data", "payload_sha1"])


class Reader:
    """Takes a record's chunks one by one; holds the header and the digest, never the payload."""

    def __init__(self) -> None:
        self.inflate = zlib.decompressobj(31)
        self.digest = hashlib.sha1()
        self.head: dict[str, str] | None = None
        self.buffer = b""
        self.left = 0
        self.size = 0
        self.next = 0

    def feed(self, number: int, data: bytes, last: bool, sofar: str) -> dict | None:
        """The record once its last chunk has come. ValueError for a gap, a broken member or a digest that differs."""
        if number != self.next:
            raise ValueError(f"chunk {number} follows chunk {self.next - 1}")
        self.next += 1
        pending = data
        while True:
            out = self.inflate.decompress(pending, CHUNK_BYTES)
            pending = self.inflate.unconsumed_tail
            self._take(out)
            if not pending and len(out) < CHUNK_BYTES:
                break
        if self.digest.hexdigest() != sofar:
            raise ValueError(f"the payload up to chunk {number} differs from its digest")
        if last:
            self._take(self.inflate.flush())
            if self.head is None or self.left or self.buffer != b"\r\n\r\n" or not self.inflate.eof:
                raise ValueError("the record is cut short")
            return self._record()
        return None

    def _take(self, out: bytes) -> None:
        if self.head is None:
            self.buffer += out
            at = self.buffer.find(b"\r\n\r\n")
            if at < 0:
                return
            lines = self.buffer[:at].decode().split("\r\n")
            self.head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
            self.left = int(self.head["Content-Length"])
            out, self.buffer = self.buffer[at + 4 :], b""
        body = out[: self.left]
        self.digest.update(body)
        self.left -= len(body)
        self.size += len(body)
        self.buffer += out[len(body) :]

    def _record(self) -> dict:
        head = self.head or {}
        kind = head["WARC-Type"]
        claimed = head["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response" and (claimed != self.digest.hexdigest() or int(head["X-Payload-Length"]) != self.size):
            raise ValueError("the payload differs from the header")
        url = head.get("WARC-Target-URI")
        return {
            "page_id": int(head["X-Page-ID"]) if "X-Page-ID" in head else None,
            "url": None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
            "payload_bytes": int(head["X-Payload-Length"]),
            "payload_digest": claimed,
            "record_type": kind,
            "refers_to": int(head["X-Refers-To-Page"]) if kind == "revisit" else None,
        }


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of an archive table, each chunk checked as it comes."""
    rows = spark.read.schema(RECORDS).parquet(path)
    # null marks are damage, which the reader of several chunks finds
    single = F.coalesce((F.col("chunk_no") == 0) & F.col("last"), F.lit(False))
    dealt = rows.where(~single).repartition("archive", "record_no").sortWithinPartitions("archive", "record_no", "chunk_no")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reader = None, None
        for batch in batches:
            out = []
            archive, record_no, record_id, chunk_no, last, data, sofar = batch.columns
            for k in range(batch.num_rows):
                at = (archive[k].as_py(), record_no[k].as_py())
                if at != key:
                    if reader is not None:
                        raise ValueError(f"record {key} is cut short")
                    key, reader = at, Reader()
                elif reader is None:
                    raise ValueError(f"record {key} goes on after its end")
                got = reader.feed(chunk_no[k].as_py(), data[k].as_py(), last[k].as_py(), sofar[k].as_py())
                if got is not None:
                    out.append({"record_id": record_id[k].as_py(), **got})
                    reader = None
            yield pa.RecordBatch.from_pylist(out, schema=_READ_SCHEMA)
        if reader is not None:
            raise ValueError(f"record {key} is cut short")

    return rows.where(single).mapInArrow(run, READ).union(dealt.mapInArrow(run, READ))


_READ_SCHEMA = pa.schema(
    [("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
)


def dangling(records: DataFrame) -> DataFrame:
    """(payload_digest) of revisits that no response read from the archives bears out: its page, its length, its digest.

    What a revisit says of its payload is only in its header. Digests are grouped, combined before the shuffle.
    """
    revisit = F.col("record_type") == "revisit"
    said = F.struct("refers_to", "payload_bytes")
    read_ = F.when(~revisit, F.struct(F.col("page_id").alias("refers_to"), "payload_bytes"))
    seen = records.groupBy("payload_digest").agg(F.min(F.when(revisit, said)).alias("low"), F.max(F.when(revisit, said)).alias("high"), F.max(read_).alias("response"))
    return seen.where("low is not null and (response is null or low <> high or low <> response)").select("payload_digest")


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive pages (page_id, url, html) in the shared folder and read the records back.

    ValueError if a record is damaged or a revisit refers to no response of its digest and length.

    A null html is an empty payload, a null url or page_id has no header line. Rows that repeat a page_id are records of
    their own with one record id; with the largest page_id of a payload, they are all responses. A null page_id never
    becomes a response while others have the payload. An empty table gives no rows; other columns are not read.
    """
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write(plan(pages), path)
    records = stage(read(spark, path), "warc-records")
    remove(spark, path)
    lost = dangling(records).limit(3).collect()
    if lost:
        raise ValueError(f"revisits without their response: {', '.join(r['payload_digest'] for r in lost)}")
    return records
