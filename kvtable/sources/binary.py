"""Readers for stored runs, logs, filters and manifests in the binary layouts of earlier stores.

Files are read with Spark's ``binaryFile`` source, so any file system will
do; each file is one row and is parsed by one task, in batches.  All numbers
are big-endian.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the layouts.
RUN_MAGIC = 0x4C534D31
FILTER_MAGIC = 0x424C4F4D
FOOTER = struct.Struct(">iqi")  # magic, index offset, index entries
RECORD = struct.Struct(">iiq")  # key length, value length (-1: tombstone), seq
LOG_RECORD = struct.Struct(">bqii")  # type, seq, key length, value length (-1: delete)
PUT, DELETE = 1, 2
MAX_KEY, MAX_VALUE, MAX_INDEX, MAX_FILTER = 128 << 20, 1 << 30, 10_000_000, 512 << 20

BATCH_ROWS = 10_000
_OPS = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("key", pa.binary()), ("value", pa.binary()), ("tombstone", pa.bool_()), ("seq", pa.int64())])
_OPS_DDL = "path string, offset bigint, key binary, value binary, tombstone boolean, seq bigint"


class CorruptRun(ValueError):
    """A record that fails its length or checksum test."""


def index_of(data: bytes) -> tuple[int, list[tuple[bytes, int]]]:
    """Where the records end, and the sparse index; a file without a valid footer has records only."""
    if len(data) < FOOTER.size:
        return len(data), []
    magic, at, count = FOOTER.unpack_from(data, len(data) - FOOTER.size)
    if magic != RUN_MAGIC or not 0 <= at <= len(data) or not 0 <= count <= MAX_INDEX:
        return len(data), []
    end, entries = at, []
    for _ in range(count):
        (size,) = struct.unpack_from(">i", data, at)
        if not 0 <= size <= MAX_KEY:
            break
        entries.append((data[at + 4 : at + 4 + size], struct.unpack_from(">q", data, at + 4 + size)[0]))
        at += 12 + size
    return end, entries


def run_records(data: bytes, permissive: bool = False) -> Iterator[tuple[int, bytes, bytes | None, int]]:
    """``offset, key, value, seq`` of each record.  A bad one raises, or ends the run if permissive."""
    end, _ = index_of(data)
    at = 0
    while at < end:
        fault = "truncated"
        if at + RECORD.size <= end:
            n_key, n_value, seq = RECORD.unpack_from(data, at)
            if not 0 <= n_key <= MAX_KEY or not -1 <= n_value <= MAX_VALUE:
                fault = "bad length"
            else:
                body = at + RECORD.size + n_key + max(0, n_value)
                if body + 4 <= end:
                    fault = "" if zlib.crc32(data[at:body]) == int.from_bytes(data[body : body + 4], "big") else "checksum mismatch"
        if fault:
            if permissive:
                return
            raise CorruptRun(f"{fault} in the record at offset {at}")
        key = data[at + RECORD.size : at + RECORD.size + n_key]
        yield at, key, None if n_value < 0 else data[at + RECORD.size + n_key : body], seq
        at = body + 4


def log_records(data: bytes) -> Iterator[tuple[int, bytes, bytes | None, int]]:
    """``offset, key, value, seq`` up to the first record that is cut short or not valid."""
    at = 0
    while at + LOG_RECORD.size <= len(data):
        kind, seq, n_key, n_value = LOG_RECORD.unpack_from(data, at)
        if not 0 <= n_key <= MAX_KEY or not -1 <= n_value <= MAX_VALUE or kind not in (PUT, DELETE) or (kind == PUT and n_value < 0):
            return
        body = at + LOG_RECORD.size
        end = body + n_key + (n_value if kind == PUT else 0)
        if end > len(data):
            return
        yield at, data[body : body + n_key], data[body + n_key : end] if kind == PUT else None, seq
        at = end


def filter_bits(data: bytes) -> tuple[int, int, list[int]]:
    """Size in bits, number of hashes and the set bits of a stored filter."""
    if len(data) < 16:
        raise ValueError("invalid filter header")
    magic, bits, hashes, size = struct.unpack_from(">iiii", data)
    if magic != FILTER_MAGIC or not 0 <= size <= MAX_FILTER or len(data) < 16 + size:
        raise ValueError("invalid filter header")
    words = data[16 : 16 + size]
    return bits, hashes, [8 * i + b for i, byte in enumerate(words) if byte for b in range(8) if byte >> b & 1]


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _parsed(files: DataFrame, parse) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held: list[tuple] = []
                for offset, key, value, seq in parse(content):
                    held.append((path, offset, key, value, value is None, seq))
                    if len(held) == BATCH_ROWS:
                        yield _batch(held)
                        held = []
                if held:
                    yield _batch(held)

    return files.mapInArrow(rows, _OPS_DDL)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OPS, strict=True)], schema=_OPS)


def read_stored_runs(spark: SparkSession, path: str, permissive: bool = False) -> DataFrame:
    """``path, offset, key, value, tombstone, seq`` of every record of the run files under ``path``."""
    return _parsed(_files(spark, path), lambda data: run_records(data, permissive))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """The valid prefix of each log file under ``path``."""
    return _parsed(_files(spark, path), log_records)


def read_indexes(spark: SparkSession, path: str) -> DataFrame:
    """``path, key, offset`` of the sparse index of each run file."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if entries := index_of(content)[1]:
                    yield pa.RecordBatch.from_pydict(
                        {"path": [path] * len(entries), "key": [k for k, _ in entries], "offset": [o for _, o in entries]}
                    )

    return _files(spark, path).mapInArrow(rows, "path string, key binary, offset bigint")


def read_filters(spark: SparkSession, path: str) -> DataFrame:
    """``path, bits, hashes, position``: the set bits of each stored filter."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bits, hashes, found = filter_bits(content)
                if found:
                    columns = ([path] * len(found), [bits] * len(found), [hashes] * len(found), found)
                    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "bits", "hashes", "position"]
                    )

    return _files(spark, path).mapInArrow(rows, "path string, bits int, hashes int, position int")


def read_stored_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``run_order, file, bloom, min_key, max_key`` of a stored manifest, newest run first; an empty one has no rows."""
    entry = "array<struct<file:string,bloom:string,minKey:string,maxKey:string>>"
    rows = spark.read.schema(f"sstables {entry}").option("multiLine", "true").json(path)
    listed = rows.select(F.posexplode("sstables").alias("run_order", "e")).where("e.file IS NOT NULL")
    return listed.select(
        "run_order",
        "e.file",
        "e.bloom",
        F.unhex(F.coalesce("e.minKey", F.lit(""))).alias("min_key"),
        F.unhex(F.coalesce("e.maxKey", F.lit(""))).alias("max_key"),
    )


def discover_runs(spark: SparkSession, *folders: str) -> DataFrame:
    """``path, run_order`` of run files in all the folders by name, newest name first; for tables without a manifest."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.sst").load(list(folders)).select("path")
    names = found.select("path", F.element_at(F.split("path", "/"), -1).alias("_name"))
    from pyspark.sql import Window

    order = Window.orderBy(F.col("_name").desc(), F.col("path").desc())  # one row per file
    return names.select("path", (F.row_number().over(order) - 1).alias("run_order"))
