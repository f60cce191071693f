"""Operators over the op log: positions, replay of a valid prefix, buffer accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvtable.functions import codec
from kvtable.operators.merge import latest
from kvtable.operators.prefix import running_sum


def log_positions(ops: DataFrame, out: str = "lsn") -> DataFrame:
    """The ops and the byte position at which each one's log record ends."""
    return running_sum(ops, "seq", codec.log_size(F.col("key"), F.col("value")), out)


def valid_prefix(ops: DataFrame, valid: Column, order: str = "seq") -> DataFrame:
    """The ops before the first one that is not valid (NULL counts as not valid)."""
    bad = ops.where(~F.coalesce(valid, F.lit(False))).agg(F.min(order).alias("_first"))
    first = bad.scalar()
    return ops.where(first.isNull() | (F.col(order) < first))


def torn_at(ops: DataFrame, n_bytes: int) -> DataFrame:
    """What a replay sees of a log cut to its first ``n_bytes``: the records that are whole."""
    placed = log_positions(ops, "_lsn")
    return placed.where(F.col("_lsn") <= n_bytes).drop("_lsn")


def torn_share(ops: DataFrame, tenths: int) -> DataFrame:
    """What a replay sees of a log of which the first ``tenths`` of ten parts of its bytes are left."""
    placed = log_positions(ops, "_lsn")
    size = ops.agg(F.sum(codec.log_size(F.col("key"), F.col("value"))).alias("_size")).scalar()
    return placed.where(F.col("_lsn") <= F.floor(size * tenths / 10)).drop("_lsn")


def replayed(ops: DataFrame) -> DataFrame:
    """State after applying a log in order: of each key the last record."""
    return latest(ops)


def max_seq(ops: DataFrame) -> DataFrame:
    return ops.agg(F.coalesce(F.max("seq"), F.lit(0).cast("bigint")).alias("max_seq"))


def buffer_bytes(ops: DataFrame, out: str = "buffer_bytes") -> DataFrame:
    """The ops and the buffer's size after each, within one buffer generation.

    A write adds its key and value and takes away the value it replaces; a
    write that would shrink the buffer adds nothing.
    """
    before = Window.partitionBy("key").orderBy("seq")
    new = codec.value_size(F.col("value"))
    old = F.coalesce(F.lag(new).over(before), F.lit(0))
    grown = ops.withColumn("_delta", F.greatest(F.octet_length("key") + new - old, F.lit(0)))
    return running_sum(grown, "seq", F.col("_delta"), out).drop("_delta")
