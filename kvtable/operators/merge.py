"""Version merge: the latest row of each key, and what a reader may see of it.

All functions take and return DataFrames of the op-log schema
``key BINARY, value BINARY, tombstone BOOLEAN, seq BIGINT`` (see
:mod:`kvtable.schema`).  ``seq`` is unique, so the merge is deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(ops: DataFrame) -> DataFrame:
    """One row per key: the one with the highest ``seq``, tombstones included.

    A single ``max_by`` over a struct, so that NULL values of tombstones stay
    with their row; the partial aggregate runs map-side, which is what keeps
    a hot key from travelling.
    """
    newest = F.max_by(F.struct("value", "tombstone", "seq"), F.col("seq"))
    return ops.groupBy("key").agg(newest.alias("_v")).select("key", "_v.value", "_v.tombstone", "_v.seq")


def live(ops: DataFrame) -> DataFrame:
    """The visible state.  Tombstones are dropped after the merge, never before it."""
    return latest(ops).where(~F.col("tombstone"))


def in_range(start: bytes | None, end: bytes | None) -> Column:
    """Inclusive bounds on ``key``; None leaves a side open.  start > end matches nothing."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col("key") >= F.lit(bytearray(start)))
    if end is not None:
        cond = cond & (F.col("key") <= F.lit(bytearray(end)))
    return cond


def scan(ops: DataFrame, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
    """``key, value`` of the live rows within the bounds.

    The predicate is on the grouping column, so Catalyst moves it below the
    aggregate and into the Parquet scan.  Order by ``key`` where order matters.
    """
    return live(ops.where(in_range(start, end))).select("key", "value")


def status(requests: DataFrame, ops: DataFrame) -> DataFrame:
    """``key, status, value`` for each requested key: Found, Deleted or NotFound."""
    state = latest(ops.join(requests.select("key").distinct(), "key", "left_semi"))
    found = (
        F.when(F.col("seq").isNull(), "NotFound").when(F.col("tombstone"), "Deleted").otherwise("Found")
    )
    return requests.select("key").join(state, "key", "left").select("key", found.alias("status"), "value")


def multi_get(requests: DataFrame, ops: DataFrame) -> DataFrame:
    """``key, value`` of the requested keys that are live; an empty value counts as found."""
    return status(requests, ops).where(F.col("status") == "Found").select("key", "value")


def merge_runs(*runs: DataFrame, drop_tombstones: bool = False) -> DataFrame:
    """Merge whole runs into one.  ``drop_tombstones`` is right only if the oldest run takes part."""
    if not runs:
        raise ValueError("no runs to merge")
    ops = runs[0]
    for run in runs[1:]:
        ops = ops.unionByName(run)
    return live(ops) if drop_tombstones else latest(ops)
