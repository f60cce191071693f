"""Registered queries that go through real tables and stored files: they write, open again and read.

Each call has a folder of its own below ``spark.checkpoint.dir``, removed when the driver ends.
"""

from __future__ import annotations

import json
import os
import struct
import tempfile
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvtable.functions import codec
from kvtable.functions.murmur import SEED_1, SEED_2, murmur3, positions
from kvtable.plans.event_log import event_ops, event_requests
from kvtable.schema import Options
from kvtable.sources import binary
from kvtable.sources.storage import Storage
from kvtable.table import LogTable, Table

#: Batches that the event log is written in.
BATCHES = 3


def folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.conf.get("spark.master", "") != "local" and not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    path = f"{base}/{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def _hexed(rows: DataFrame, *more) -> DataFrame:
    return rows.select(F.hex("key").alias("key_hex"), F.hex("value").alias("value_hex"), *more)


def batch_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log with a column ``batch``: equal parts by seq."""
    ops = event_ops(spark, sf_dir)
    n = ops.agg(F.count(F.lit(1)).alias("n")).scalar()
    return ops.withColumn("batch", F.floor((F.col("seq") - 1) * BATCHES / n))


def event_table(spark: SparkSession, sf_dir: str, options: Options | None = None) -> str:
    """A table of the event log, a batch at a time: upserts of what was put, with deletes among them."""
    path = folder(spark)
    rows = batch_of(spark, sf_dir)
    for number in range(BATCHES):
        with Table.open(spark, path, options) as table:
            table.upsert(rows.where(F.col("batch") == number), order="seq", batch=("events", number))
    return path


def table_upsert_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upserted in batches, each through a handle of its own; scanned by another."""
    return _hexed(Table.open(spark, event_table(spark, sf_dir)).scan())


def table_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as of its first version, after all batches."""
    return _hexed(Table.open(spark, event_table(spark, sf_dir), version=1).scan())


def table_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stored manifest says of each run."""
    runs = Table.open(spark, event_table(spark, sf_dir)).runs()
    return runs.select("run_id", "tier", F.hex("min_key").alias("min_key"), F.hex("max_key").alias("max_key"), "n_rows", "n_tombstones", "min_seq", "max_seq")


def table_redelivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first batch delivered again changes nothing."""
    path = event_table(spark, sf_dir)
    with Table.open(spark, path) as table:
        table.upsert(batch_of(spark, sf_dir).where("batch = 0"), order="seq", batch=("events", 0))
    return _hexed(Table.open(spark, path).scan())


def table_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The physical rows after all runs are merged, and old ones removed."""
    path = event_table(spark, sf_dir)
    with Table.open(spark, path) as table:
        table.compact(max_runs=1)
        table.vacuum()
    return _hexed(Table.open(spark, path).ops(), "tombstone")


def table_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by 8-byte key; those of status F deleted in a batch."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        codec.from_u64(F.col("o_orderkey")).alias("key"), codec.from_text(F.col("o_orderpriority")).alias("value"), "o_orderstatus"
    )
    path = folder(spark)
    with Table.open(spark, path) as table:
        table.upsert(orders.select("key", "value"))
        table.remove(orders.where("o_orderstatus = 'F'").select("key"))
    return _hexed(Table.open(spark, path).scan())


def table_single_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations put one by one, half of them in a first run; those of region 0 deleted; the buffer is read before a flush."""
    nations = sorted(tuple(r) for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").collect())
    table = Table.open(spark, folder(spark))
    for key, name, _ in nations[: len(nations) // 2]:
        table.put(b"n%03d" % key, b"old " + name.encode())
    table.flush()
    for key, name, region in nations:
        table.put(b"n%03d" % key, name.encode())
        if region == 0:
            table.delete(b"n%03d" % key)
    return _hexed(table.scan())


def table_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user and as many unknown keys, looked up in runs by way of the manifest."""
    found = Table.open(spark, event_table(spark, sf_dir)).lookup(event_requests(spark, sf_dir))
    return _hexed(found, "status")


def table_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All but the newest run moved to the remote folder; the rows are read from both."""
    path = event_table(spark, sf_dir, Options(keep_local=1))
    with Table.open(spark, path, Options(keep_local=1)) as table:
        table.tier()
        table.vacuum()
    table = Table.open(spark, path)
    return table.runs().select("run_id", "tier", "n_rows", F.col("path").contains("/remote-runs/").alias("in_remote_folder"))


def log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log appended to a log store and replayed after it is opened again."""
    path = folder(spark)
    with LogTable.open(spark, path) as table:
        for number in range(BATCHES):
            table.append(batch_of(spark, sf_dir).where(F.col("batch") == number), order="seq")
    return _hexed(LogTable.open(spark, path).replay(), "tombstone", "seq")


# --- files in the binary layouts ------------------------------------------------------


def _suppliers(spark: SparkSession, sf_dir: str) -> list[tuple[bytes, bytes | None, int]]:
    """Records by key: name of each supplier, or a tombstone where the balance is negative.  Small: one file."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name", "s_acctbal").collect()
    return sorted((b"s%06d" % r[0], None if r[2] < 0 else r[1].encode(), r[0]) for r in rows)


def _record(key: bytes, value: bytes | None, seq: int) -> bytes:
    body = binary.RECORD.pack(len(key), -1 if value is None else len(value), seq) + key + (value or b"")
    return body + struct.pack(">I", zlib.crc32(body))


def stored_run(records: list[tuple[bytes, bytes | None, int]], every: int = Options.index_every) -> bytes:
    """A run file: records, sparse index, footer."""
    data, entries = b"", []
    for n, (key, value, seq) in enumerate(records):
        if n % every == 0:
            entries.append(struct.pack(">i", len(key)) + key + struct.pack(">q", len(data)))
        data += _record(key, value, seq)
    return data + b"".join(entries) + binary.FOOTER.pack(binary.RUN_MAGIC, len(data), len(entries))


def stored_log(records: list[tuple[bytes, bytes | None, int]]) -> bytes:
    return b"".join(
        binary.LOG_RECORD.pack(binary.DELETE if value is None else binary.PUT, seq, len(key), -1 if value is None else len(value)) + key + (value or b"")
        for key, value, seq in records
    )


def _files(spark: SparkSession, **contents: bytes) -> str:
    """A folder with files of these names (``_`` stands for a dot)."""
    path = folder(spark)
    storage = Storage(spark, path)
    for name, data in contents.items():
        storage.write_bytes(name.replace("_", "."), data)
    return path


def stored_run_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written run file, every record read back with its place and checked."""
    path = _files(spark, run_sst=stored_run(_suppliers(spark, sf_dir)))
    return _hexed(binary.read_stored_runs(spark, path), "tombstone", "seq", "offset")


def stored_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _files(spark, run_sst=stored_run(_suppliers(spark, sf_dir)))
    return binary.read_indexes(spark, path).select(F.hex("key").alias("key_hex"), "offset")


def stored_log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written log that lost its last five bytes: all records but the last."""
    path = _files(spark, wal_log=stored_log(_suppliers(spark, sf_dir))[:-5])
    return _hexed(binary.read_logs(spark, path), "tombstone", "seq")


def stored_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set bits of a written filter of 4,096 bits and 5 hashes over the suppliers' keys."""
    bits, hashes = 4096, 5
    keys = spark.createDataFrame([(bytearray(k),) for k, _, _ in _suppliers(spark, sf_dir)], "key binary")
    hashed = keys.select(positions(murmur3(F.col("key"), SEED_1), murmur3(F.col("key"), SEED_2), bits, hashes).alias("p"))
    words = bytearray(bits // 8)
    for row in hashed.collect():
        for p in row["p"]:
            words[p // 8] |= 1 << p % 8
    path = _files(spark, run_bloom=struct.pack(">iiii", binary.FILTER_MAGIC, bits, hashes, len(words)) + bytes(words))
    return binary.read_filters(spark, path).select("bits", "hashes", "position")


def stored_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written manifest with an entry per region, and the run files that a search of the folder finds."""
    regions = sorted(tuple(r) for r in spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", "r_name").collect())
    listed = [{"file": f"{key:03d}.sst", "bloom": f"{key:03d}.bloom", "minKey": name.encode().hex(), "maxKey": ""} for key, name in regions]
    path = _files(spark, manifest_json=json.dumps({"sstables": listed}).encode(), **{f"{key:03d}_sst": stored_run([]) for key, _ in regions})
    found = binary.discover_runs(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("run_order").alias("found_order"))
    return binary.read_stored_manifest(spark, f"{path}/manifest.json").join(found, "file").select(
        "file", "bloom", F.hex("min_key").alias("min_key"), F.hex("max_key").alias("max_key"), F.col("run_order").cast("bigint").alias("run_order"),
        F.col("found_order").cast("bigint").alias("found_order"),
    )
