"""The op logs that the registered queries run over, built from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvtable.functions import codec
from kvtable.operators.runs import per_run

N_RUNS = 8


def event_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as an op log: a user is a key, an ``error`` event deletes it, others put ``props``."""
    gone = F.col("event_type") == "error"
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        codec.from_text(F.format_string("u%06d", F.col("user_id"))).alias("key"),
        F.when(~gone, codec.from_text(F.col("props"))).alias("value"),
        gone.alias("tombstone"),
        (F.col("event_id") + 1).alias("seq"),
    )


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The op log cut into eight runs of equal length by seq, each with one row per key."""
    ops = event_ops(spark, sf_dir)
    n = ops.agg(F.count(F.lit(1)).alias("n")).scalar()
    return per_run(ops.select("*", F.floor((F.col("seq") - 1) * N_RUNS / n).cast("bigint").alias("run")))


def order_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` by 8-byte order key: a first put of the priority, a second of the status, then deletes of status F."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    versions = F.array(
        F.struct(F.col("o_orderpriority").alias("value"), F.lit(0).alias("n")),
        F.struct(F.col("o_orderstatus").alias("value"), F.lit(1).alias("n")),
        F.struct(F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("value"), F.lit(2).alias("n")),
    )
    rows = orders.select("o_orderkey", F.explode(versions).alias("v"))
    return rows.select(
        codec.from_u64(F.col("o_orderkey")).alias("key"),
        codec.from_text(F.col("v.value")).alias("value"),
        F.col("v.value").isNull().alias("tombstone"),
        (F.col("o_orderkey") * 3 + F.col("v.n")).alias("seq"),
    )


def event_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key for each event user, and as many keys of another form that no user has."""
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    both = users.select(F.explode(F.array(*[F.format_string(form, F.col("user_id")) for form in ("u%06d", "x%06d")])).alias("key"))
    return both.select(codec.from_text(F.col("key")).alias("key"))
