"""Sorted runs as Parquet: range-partitioned and sorted by key, with min/max and Bloom filters to prune by."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvtable.operators.merge import latest
from kvtable.schema import OP_COLUMNS, OPS, Options
from kvtable.sources.manifest import RunInfo

ROWS_PER_ENTRY = 32


def _writer(rows: DataFrame, options: Options):
    """Row groups, pages and Bloom filters by the options.

    A filter of b bits and k hashes is right for ``b * ln 2 / k`` keys with a false-positive rate of ``2^-k``; Parquet makes
    one of about that size per column chunk.  A page of ``ROWS_PER_ENTRY`` times ``index_every`` rows is an entry of the page index.
    """
    keys = max(1, int(options.bloom_bits * math.log(2) / options.bloom_hashes))
    return (
        rows.write.option("parquet.bloom.filter.enabled#key", "true")
        .option("parquet.bloom.filter.expected.ndv#key", keys)
        .option("parquet.bloom.filter.fpp#key", repr(0.5**options.bloom_hashes))
        .option("parquet.bloom.filter.max.bytes", max(32, options.bloom_bits // 4))
        .option("parquet.page.row.count.limit", ROWS_PER_ENTRY * options.index_every)
        .option("parquet.block.size", options.row_group_bytes)
    )


def write_run(ops: DataFrame, path: str, options: Options) -> None:
    """The newest row of each key, in key order, as one run; the files are written before any manifest names them."""
    rows = latest(ops).select(*OP_COLUMNS)
    _writer(rows.repartitionByRange("key").sortWithinPartitions("key"), options).parquet(path)


def write_log(ops: DataFrame, path: str, options: Options) -> None:
    """All rows as they are."""
    _writer(ops.select(*OP_COLUMNS), options).parquet(path)


def copy_run(spark: SparkSession, source: str, target: str, options: Options) -> None:
    """The run at another place, by a job.  Each task copies a stretch of a sorted file, so rows stay in order within files."""
    _writer(spark.read.schema(OPS).parquet(source), options).parquet(target)


def describe(spark: SparkSession, run_id: int, path: str, tier: str) -> RunInfo:
    """A run's statistics, read from the files that were written."""
    s = (
        spark.read.schema(OPS)
        .parquet(path)
        .agg(
            F.lower(F.hex(F.min("key"))),
            F.lower(F.hex(F.max("key"))),
            F.count(F.lit(1)),
            F.coalesce(F.sum(F.col("tombstone").cast("bigint")), F.lit(0)),
            F.min("seq"),
            F.max("seq"),
        )
        .first()
    )
    return RunInfo(run_id, path, tier, *s)


def read_runs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All physical rows of the runs; predicates on ``key`` reach the Parquet readers."""
    frames = [spark.read.schema(OPS).parquet(p) for p in paths]
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], OPS)
