"""Key ranges of about equal size, for numbering and as-of lookups in key order without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range, and the most ranges; beyond that the ranges grow with the table.
ROWS, MOST = 1 << 17, 4096
#: Sampled keys for each range.
SAMPLED = 32


def splitters(rows: DataFrame, key: str = "key", per_range: int = ROWS) -> list[bytes]:
    """Keys that cut the rows into about ``rows / per_range`` ranges, ascending; from a sample by hash of bounded size."""
    n = rows.count()
    n_ranges = min(MOST, -(-n // per_range))
    if n_ranges < 2:
        return []
    one_of = max(1, n // (n_ranges * SAMPLED))
    found = rows.where(F.pmod(F.xxhash64(key, F.lit(3)), F.lit(one_of)) == 0).groupBy(key).count().collect()
    total, upto, out = sum(r["count"] for r in found), 0, []
    for key_value, count in sorted((bytes(r[0]), r["count"]) for r in found):
        if upto * n_ranges // total != (upto + count) * n_ranges // total:
            out.append(key_value)
        upto += count
    return out


def range_of(key: Column, cuts: list[bytes]) -> Column:
    """The number of cuts up to the key, by binary search in a literal."""
    if not cuts:
        return F.lit(0)
    table = F.array(*[F.lit(bytearray(c)) for c in cuts])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])

    def step(at: Column, size: Column) -> Column:
        ahead = at + size
        return F.when((ahead <= len(cuts)) & (F.get(table, ahead - 1) <= key), ahead).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def numbered(rows: DataFrame, group: list[str], key: str, cuts: list[bytes], sums: dict[str, Column] | None = None) -> DataFrame:
    """All columns and ``_nth``, the place from 0 in the order of ``key`` (unique within a group), and per name in
    ``sums`` the sum of its values over the rows before.

    A window sees one range of a group; the ranges' starts come from their sums.
    """
    values = {"_nth": F.lit(1).cast("bigint"), **(sums or {})}
    placed = rows.select("*", range_of(F.col(key), cuts).alias("_range"), *[v.cast("bigint").alias(f"_v{name}") for name, v in values.items()])
    totals = placed.groupBy(*group, "_range").agg(*[F.sum(f"_v{name}").alias(f"_t{name}") for name in values])
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*group, "_range", *[F.coalesce(F.sum(f"_t{name}").over(before), F.lit(0)).alias(f"_s{name}") for name in values])
    inside = Window.partitionBy(*group, "_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    inner = placed.select("*", *[F.coalesce(F.sum(f"_v{name}").over(inside), F.lit(0)).alias(f"_i{name}") for name in values])
    joined = inner.join(starts, [*group, "_range"])
    return joined.select(*rows.columns, *[(F.col(f"_i{name}") + F.col(f"_s{name}")).cast("bigint").alias(name) for name in values])
