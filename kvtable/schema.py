"""Schemas, options and the checks that rows pass on their way in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPS = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("value", T.BinaryType(), True),
        T.StructField("tombstone", T.BooleanType(), False),
        T.StructField("seq", T.LongType(), False),
    ]
)
OP_COLUMNS = OPS.fieldNames()

MANIFEST = T.StructType(
    [
        T.StructField("run_id", T.LongType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("tier", T.StringType(), False),
        T.StructField("min_key", T.BinaryType(), True),
        T.StructField("max_key", T.BinaryType(), True),
        T.StructField("n_rows", T.LongType(), False),
        T.StructField("n_tombstones", T.LongType(), False),
        T.StructField("min_seq", T.LongType(), True),
        T.StructField("max_seq", T.LongType(), True),
    ]
)


@dataclass(frozen=True)
class Options:
    """Defaults as documented for the store; out-of-range values are clamped or rejected.

    ``write_buffer_bytes`` bounds what single puts and deletes hold on the
    driver before a flush; bulk upserts are not buffered.  ``compaction`` is
    ``tiered`` (the neighbouring runs with the fewest rows are merged) or
    ``oldest`` (always the oldest ones, which rewrites the base each time).
    """

    write_buffer_bytes: int = 4 << 20
    bloom_bits: int = 1 << 20
    bloom_hashes: int = 7
    index_every: int = 32
    max_runs: int = 4
    keep_local: int = 4
    row_group_bytes: int = 16 << 20
    compaction: str = "tiered"

    def __post_init__(self) -> None:
        if self.write_buffer_bytes <= 0:
            raise ValueError("write_buffer_bytes must be positive")
        if self.bloom_bits <= 0 or self.bloom_hashes <= 0:
            raise ValueError("bloom_bits and bloom_hashes must be positive")
        if self.max_runs < 1:
            raise ValueError("max_runs must be at least 1")
        if self.compaction not in ("tiered", "oldest"):
            raise ValueError("compaction must be tiered or oldest")
        object.__setattr__(self, "index_every", max(1, self.index_every))
        object.__setattr__(self, "keep_local", max(0, self.keep_local))


def checked(ops: DataFrame) -> DataFrame:
    """The ops with bad rows turned into errors: a NULL key, a put without a value, a delete with one."""
    fault = (
        F.when(F.col("key").isNull(), F.lit("key must not be NULL"))
        .when(F.col("tombstone").isNull(), F.lit("tombstone must not be NULL"))
        .when(~F.col("tombstone") & F.col("value").isNull(), F.lit("a put needs a value"))
    )
    key = F.when(fault.isNotNull(), F.raise_error(fault).cast("binary")).otherwise(F.col("key"))
    return ops.select(
        key.alias("key"), F.when(~F.col("tombstone"), F.col("value")).alias("value"), "tombstone", F.col("seq").cast("bigint").alias("seq")
    )
