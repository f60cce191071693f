"""Operators over sorted runs: statistics, pruning, sparse index, compaction, tiering.

Ops with a ``run`` column (0 is the oldest) stand for a table's runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvtable.functions import codec
from kvtable.functions.murmur import SEED_1, SEED_2, murmur3, positions
from kvtable.operators import ranges
from kvtable.operators.merge import latest
from kvtable.schema import OP_COLUMNS, Options

#: Most runs of a table, as far as per-run metadata is broadcast or named in a plan.
MAX_RUNS = 10_000


def per_run(ops: DataFrame) -> DataFrame:
    """The physical rows: of each run and key the newest."""
    newest = F.max_by(F.struct("value", "tombstone", "seq"), F.col("seq")).alias("_v")
    return ops.groupBy("run", "key").agg(newest).select("run", "key", "_v.value", "_v.tombstone", "_v.seq")


def run_statistics(rows: DataFrame) -> DataFrame:
    """``run, min_key, max_key, n_rows, n_tombstones, min_seq, max_seq``."""
    return rows.groupBy("run").agg(
        F.min("key").alias("min_key"),
        F.max("key").alias("max_key"),
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col("tombstone").cast("bigint")).alias("n_tombstones"),
        F.min("seq").alias("min_seq"),
        F.max("seq").alias("max_seq"),
    )


def _metadata(frame: DataFrame) -> DataFrame:
    """For a broadcast: one row per run, of which there are at most ``MAX_RUNS``; more are an error."""
    if frame.limit(MAX_RUNS + 1).count() > MAX_RUNS:
        raise ValueError("too many runs: compact the table")
    return F.broadcast(frame)


def read_candidates(requests: DataFrame, statistics: DataFrame) -> DataFrame:
    """``key, run``: runs whose key range holds the key; an unknown (NULL or empty) bound keeps the run.

    The statistics are metadata, one row per run, and are broadcast after a count.
    """
    low, high = F.col("min_key"), F.col("max_key")
    unknown = lambda c: c.isNull() | (F.octet_length(c) == 0)
    inside = (unknown(low) | (F.col("key") >= low)) & (unknown(high) | (F.col("key") <= high))
    return requests.select("key").join(_metadata(statistics.select("run", "min_key", "max_key")), inside).select("key", "run")


def sparse_index(rows: DataFrame, every: int = Options.index_every, per_range: int = ranges.ROWS) -> DataFrame:
    """``run, ordinal, key, offset`` of every n-th record of each run, offsets in record bytes.

    Numbered by key ranges, so a run that holds the whole table is many tasks' work.
    """
    size = codec.record_size(F.col("key"), F.col("value"))
    placed = ranges.numbered(rows.select("run", "key", size.alias("_size")), ["run"], "key", ranges.splitters(rows, "key", per_range), {"offset": F.col("_size")})
    kept = placed.where(F.col("_nth") % max(1, every) == 0)
    return kept.select("run", F.col("_nth").alias("ordinal"), "key", "offset")


def index_seek(requests: DataFrame, index: DataFrame, per_range: int = ranges.ROWS) -> DataFrame:
    """``key, run, offset``: where a lookup starts, at the greatest indexed key up to the requested one, else 0.

    Requests meet the index in the order of keys, within a key range of a run;
    a request before the range's first entry takes the last one of the ranges before.
    """
    found = [r[0] for r in index.select("run").distinct().limit(MAX_RUNS + 1).collect()]
    if len(found) > MAX_RUNS:
        raise ValueError("too many runs: compact the table")
    cuts = ranges.splitters(index, "key", per_range)
    every_run = F.array(*[F.lit(r).cast("bigint") for r in sorted(found)]).cast("array<bigint>")
    asked = requests.select("key").distinct().select(F.explode(every_run).alias("run"), "key", F.lit(None).cast("bigint").alias("offset"), F.lit(1).alias("_ask"))
    merged = index.select("run", "key", "offset", F.lit(0).alias("_ask")).unionByName(asked)
    merged = merged.select("*", ranges.range_of(F.col("key"), cuts).alias("_range"))
    ends = index.select("run", "key", "offset", ranges.range_of(F.col("key"), cuts).alias("_range")).groupBy("run", "_range").agg(F.max("offset").alias("_last"))
    own_ranges = merged.select("run", "_range").distinct().join(ends, ["run", "_range"], "left")
    earlier = Window.partitionBy("run").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = own_ranges.select("run", "_range", F.max("_last").over(earlier).alias("_before"))
    upto = Window.partitionBy("run", "_range").orderBy("key", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    sought = merged.select("run", "key", "_ask", "_range", F.last("offset", ignorenulls=True).over(upto).alias("_at"))
    answers = sought.where("_ask = 1").join(starts, ["run", "_range"])
    return answers.select("key", "run", F.coalesce("_at", "_before", F.lit(0)).cast("bigint").alias("offset"))


def bloom_positions(rows: DataFrame, bits: int = Options.bloom_bits, hashes: int = Options.bloom_hashes) -> DataFrame:
    """``run, key, positions`` of each key in its run's filter."""
    hashed = rows.select("run", "key", murmur3(F.col("key"), SEED_1).alias("_1"), murmur3(F.col("key"), SEED_2).alias("_2"))
    return hashed.select("run", "key", positions(F.col("_1"), F.col("_2"), bits, hashes).alias("positions"))


def bloom_filters(rows: DataFrame, bits: int = Options.bloom_bits, hashes: int = Options.bloom_hashes) -> DataFrame:
    """``run, position``: the set bits of each run's filter."""
    return bloom_positions(rows, bits, hashes).select("run", F.explode("positions").alias("position")).distinct()


def bloom_candidates(
    requests: DataFrame, filters: DataFrame, bits: int = Options.bloom_bits, hashes: int = Options.bloom_hashes
) -> DataFrame:
    """``key, run``: runs whose filter may hold the key, i.e. has all of its positions set."""
    asked = bloom_positions(requests.select(F.lit(0).alias("run"), "key").distinct(), bits, hashes)
    bits_of = asked.select("key", F.explode(F.array_distinct("positions")).alias("position"), F.size(F.array_distinct("positions")).alias("_need"))
    hits = bits_of.join(filters, "position").groupBy("key", "run").agg(F.count(F.lit(1)).alias("_hit"), F.first("_need").alias("_need"))
    return hits.where("_hit = _need").select("key", "run")


def compacted(rows: DataFrame, n_runs: int, max_runs: int, drop_tombstones: bool = True) -> DataFrame:
    """Runs after merging the two oldest until ``max_runs`` remain: the oldest ones become run 0.

    Merging pairwise from the oldest equals one merge of the oldest
    ``n_runs - max_runs + 1``.  It takes part the oldest run, so tombstones
    hide nothing below and may go.
    """
    if max_runs < 1:
        raise ValueError("max_runs must be at least 1")
    last = max(0, n_runs - max_runs)
    moved = rows.withColumn("run", F.when(F.col("run") <= last, F.lit(0)).otherwise(F.col("run") - last).cast("bigint"))
    merged = per_run(moved)
    return merged.where((F.col("run") > 0) | ~F.col("tombstone")) if drop_tombstones and n_runs > max_runs else merged


def tiers(statistics: DataFrame, keep_local: int) -> DataFrame:
    """``run, tier``: all but the newest ``keep_local`` runs are remote."""
    rank = F.row_number().over(Window.orderBy(F.col("run").desc()))  # metadata, one row per run
    return statistics.select("run", F.when(rank > max(0, keep_local), "remote").otherwise("local").alias("tier"))


def amplification(rows: DataFrame) -> DataFrame:
    """One row: ``physical_rows, live_rows, space_amplification`` (0 live rows: NULL)."""
    live = latest(rows.select(*OP_COLUMNS)).agg(F.count(F.when(~F.col("tombstone"), 1)).alias("live_rows"))
    physical = rows.agg(F.count(F.lit(1)).alias("physical_rows"))
    ratio = F.col("physical_rows") / F.nullif(F.col("live_rows"), F.lit(0))
    return physical.select("physical_rows", live.scalar().alias("live_rows")).select("*", ratio.alias("space_amplification"))
