"""Connected components by alternating large-star and small-star rounds.

Links are rewired until every node points at the smallest node it can reach.
A round is two aggregations and two joins; minima are pre-aggregated
map-side, and the joins are plain equi-joins that skew handling may split, so
a node with very many links is no single task's work.  The number of rounds
grows with the logarithm of the component sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvtable.llm.shared import removed, written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    rewired = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rewired.union(least.select("a", F.col("m").alias("b")))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for each linked node that is not its component's smallest; input ``a, b`` BIGINT.

    Links in either direction, repeated links and links of a node to itself
    are accepted.  Nodes without an entry are their own component.
    """
    clean = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, path = written(clean.distinct())
    state = _state(now)
    while True:
        after, after_path = written(_small_star(_large_star(now).distinct()).distinct())
        after_state = _state(after)
        removed(now.sparkSession, path)
        now, path = after, after_path
        if after_state == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = after_state
