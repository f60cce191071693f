"""Numbering and seeks by key ranges, held against plain Python."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from kvtable.operators import ranges, runs


def some_rows(seed, n=600):
    rng = random.Random(seed)
    keys = {(run, bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(0, 7)))) for run in range(3) for _ in range(n // 3)}
    return sorted((run, bytearray(k), None if rng.random() < 0.2 else bytearray(b"v" * rng.randint(0, 5))) for run, k in keys)


def test_ranges_are_even_and_in_order(spark):
    rows = spark.range(20_000).select(F.encode(F.format_string("user:%09d", "id"), "UTF-8").alias("key"))
    cuts = ranges.splitters(rows, per_range=500)
    assert 20 <= len(cuts) <= 40 and cuts == sorted(set(cuts))
    sizes = rows.groupBy(ranges.range_of(F.col("key"), cuts)).count().collect()
    assert max(r["count"] for r in sizes) < 2_500
    for r in rows.limit(300).select("key", ranges.range_of(F.col("key"), cuts).alias("n")).collect():
        assert r["n"] == bisect.bisect_right(cuts, bytes(r["key"]))
    assert ranges.splitters(rows.limit(0)) == [] and ranges.splitters(rows) == []


@pytest.mark.parametrize("per_range", [5, 100, 1 << 17])
def test_index_and_seek_over_many_ranges(spark, per_range):
    rows = some_rows(1)
    frame = spark.createDataFrame([(run, k, v, v is None, 1) for run, k, v in rows], "run bigint, key binary, value binary, tombstone boolean, seq bigint")
    want, at = [], {}
    for run, k, v in rows:
        n, offset = at.get(run, (0, 0))
        if n % 4 == 0:
            want.append((run, n, bytes(k), offset))
        at[run] = (n + 1, offset + 20 + len(k) + len(v or b""))
    index = runs.sparse_index(frame, every=4, per_range=per_range)
    assert sorted((r["run"], r["ordinal"], bytes(r["key"]), r["offset"]) for r in index.collect()) == sorted(want)
    rng = random.Random(2)
    asked = sorted({bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(0, 8))) for _ in range(200)})
    found = runs.index_seek(spark.createDataFrame([(bytearray(k),) for k in asked], "key binary"), index, per_range=per_range).collect()
    expected = [(k, run, max((o for r, _, x, o in want if r == run and x <= k), default=0)) for k in asked for run in range(3)]
    assert sorted((bytes(r["key"]), r["run"], r["offset"]) for r in found) == sorted(expected)


def test_too_many_runs_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(runs, "MAX_RUNS", 1)
    frame = spark.createDataFrame([(0, b"a", b"a"), (1, b"a", b"a")], "run bigint, min_key binary, max_key binary")
    with pytest.raises(ValueError, match="too many runs"):
        runs.read_candidates(frame.select(F.col("min_key").alias("key")), frame)
