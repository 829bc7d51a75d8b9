"""What the operators share: the shared folder, written tables, packed buckets of documents."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import remove, scratch, shared_dir

#: ASCII white space as the contracts have it: [\x20\x09-\x0D]
SPACE = r"[\x20\x09-\x0D]"


#: Paths that stage() has written in this process, in order
_staged: list[str] = []


def staged() -> int:
    """How many tables have been staged; for drop_since()."""
    return len(_staged)


def drop_since(spark: SparkSession, n: int) -> None:
    """Delete all tables that were staged after the first n, once what was made from them is written elsewhere."""
    while len(_staged) > n:
        remove(spark, _staged.pop())


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: the lineage ends in replicated files."""
    path = scratch(df.sparkSession, name)
    _staged.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a table that stage() wrote and nothing reads any more."""
    files = df.inputFiles()
    if files:
        remove(df.sparkSession, files[0].rsplit("/", 1)[0])


def local_table(spark: SparkSession, columns: Mapping[str, Iterable], kinds: Mapping[str, str]) -> DataFrame:
    """A small table of the driver's values, sent as Arrow. kinds: the columns' types, of string, bigint and double.

    createDataFrame() of a list or of pandas makes a Python RDD, for which each executor starts a second daemon with
    workers of its own beside those of SQL; they stay, and count against the executor's memory.
    """
    arrow = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}
    table = pa.table({c: pa.array(list(columns[c]), arrow[kind]) for c, kind in kinds.items()})
    return spark.createDataFrame(table, ", ".join(f"`{c}` {kind}" for c, kind in kinds.items()))


@functools.cache
def _libc():
    """The C library, if it is glibc; arrays of over 1 MB are then mapped, so that freeing them frees them."""
    libc = ctypes.CDLL(None)
    if not hasattr(libc, "mallopt") or not hasattr(libc, "malloc_trim"):
        return None
    libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD; unset, it grows up to 32 MB with what is freed
    return libc


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow; its worker hands what it has freed back to the system, as it lives on for other tasks."""

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        libc = _libc()
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if libc is not None:
            libc.malloc_trim(0)

    return lean_run


def each(column: pa.Array | pa.ChunkedArray) -> Iterator:
    """The column's values one by one: only one of them is a Python object at a time."""
    return (x.as_py() for x in column)


def ascii_lower(col: Column) -> Column:
    """A-Z only, as the contracts ask; lower() would fold other alphabets too."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a column over all rows."""
    return int(docs.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0)


def bucket_count(spark: SparkSession, total: int, target: int) -> int:
    """Buckets of about target bytes, never fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // target), 1)


def compress(data: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_batch(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return compress(sink.getvalue().to_pybytes())


def unpack_table(blobs: Iterable[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(expand(b)).read_all() for b in blobs])


def chunked(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """Whole rows, gathered until a chunk holds about limit bytes of the column."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        start = 0
        sizes = np.zeros(batch.num_rows, np.int64)
        offsets = pc.binary_length(batch.column(batch.schema.get_field_index(column)))
        sizes += np.nan_to_num(offsets.to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
        for i in range(batch.num_rows):
            size += int(sizes[i]) + 16
            if size >= limit:
                held.append(batch.slice(start, i + 1 - start))
                yield pa.Table.from_batches(held)
                held, size, start = [], 0, i + 1
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def packed_buckets(docs: DataFrame, key: str, columns: list[str], n_buckets: int, chunk: int = 8 << 20) -> DataFrame:
    """Rows (bucket, blob): the given columns of all rows, compressed by bucket of key before they are shuffled.

    Bucketing by a hash of the key keeps the buckets even whatever a source or a group of copies holds;
    rows of one key always share a bucket. columns[0] should be the text; chunk bounds what a task holds.
    """
    bucketed = docs.select(F.pmod(F.xxhash64(F.col(key)), F.lit(n_buckets)).cast("int").alias("bucket"), *columns)
    text = columns[0]

    def run(batches):
        for table in chunked(batches, text, chunk):
            table = table.sort_by("bucket").combine_chunks()
            buckets = table.column("bucket").to_numpy()
            rest = table.select(columns)
            starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
            ends = np.r_[starts[1:], len(buckets)]
            out = [pack_batch(rest.slice(s, e - s).combine_chunks().to_batches()[0]) for s, e in zip(starts, ends)]
            yield pa.record_batch([pa.array(buckets[starts], pa.int32()), pa.array(out, pa.binary())], names=["bucket", "blob"])

    return bucketed.mapInArrow(run, "bucket int, blob binary")
