import random

import pytest
from pyspark.sql import functions as F

from kvtable.operators import merge
from kvtable.schema import OPS, Options
from kvtable.sources import manifest as manifests
from kvtable.table import MemoryTable, Table


@pytest.fixture
def path(tmp_path):
    return "file://" + str(tmp_path / "table")


def rows(df):
    return [(bytes(r["key"]), bytes(r["value"])) for r in df.collect()]


def test_round_trip_overwrite_delete_missing(spark, path):
    with Table.open(spark, path) as t:
        t.put(b"k1", b"v1")
        assert t.get(b"k1") == b"v1"
        t.put(b"k1", b"v2")
        assert t.get(b"k1") == b"v2"
        t.delete(b"k1")
        assert t.get(b"k1") is None
        assert t.get(b"nothing") is None
        t.delete(b"never there")


def test_calls_after_close_raise(spark, path):
    t = Table.open(spark, path)
    t.close()
    t.close()
    for call in (lambda: t.put(b"a", b"b"), lambda: t.get(b"a"), lambda: t.delete(b"a"), t.scan, t.flush):
        with pytest.raises(OSError, match="closed"):
            call()


def test_close_and_reopen_keep_data(spark, path):
    with Table.open(spark, path) as t:
        t.put(b"k1", b"v1")
        t.put(b"k2", b"v2")
        t.delete(b"k2")
    with Table.open(spark, path) as t:
        assert t.get(b"k1") == b"v1" and t.get(b"k2") is None


def test_flush_and_scan_across_runs(spark, path):
    with Table.open(spark, path) as t:
        t.flush()
        assert t.manifest.version == 0  # nothing to flush
        for k in (b"a", b"c"):
            t.put(k, k)
        t.flush()
        for k in (b"b", b"d"):
            t.put(k, k)
        assert [k for k, _ in rows(t.scan())] == [b"a", b"b", b"c", b"d"]
        assert [k for k, _ in rows(t.scan(b"b", b"c"))] == [b"b", b"c"]
        assert [k for k, _ in rows(t.scan(b"b"))] == [b"b", b"c", b"d"]
        assert [k for k, _ in rows(t.scan(None, b"b"))] == [b"a", b"b"]
        assert rows(t.scan(b"z", b"a")) == []
        t.delete(b"b")
        t.put(b"a", b"new")
        assert rows(t.scan()) == [(b"a", b"new"), (b"c", b"c"), (b"d", b"d")]


def test_overwrite_after_reopen_is_seen_by_get_and_scan(spark, path):
    with Table.open(spark, path) as t:
        for i in range(5):
            t.put(b"k", b"old%d" % i)
        t.flush()
    with Table.open(spark, path) as t:
        t.put(b"k", b"new")
        assert t.get(b"k") == b"new" and rows(t.scan()) == [(b"k", b"new")]
        t.flush()
        assert t.get(b"k") == b"new" and rows(t.scan()) == [(b"k", b"new")]


def test_byte_order_and_empty_values(spark, path):
    keys = [b"", b"foo", b"foobar", b"\x7f", b"\x80", b"\xff"]
    with Table.open(spark, path) as t:
        for k in reversed(keys):
            t.put(k, b"")
        t.flush()
        assert rows(t.scan()) == [(k, b"") for k in keys]
        assert t.get(b"\x80") == b""
        status = {bytes(r["key"]): r["status"] for r in t.lookup(spark.createDataFrame([(bytearray(b"\x80"),), (bytearray(b"q"),)], "key binary")).collect()}
        assert status == {b"\x80": "Found", b"q": "NotFound"}


def test_bad_writes_are_rejected_and_take_no_seq(spark, path):
    with Table.open(spark, path) as t:
        for call in (lambda: t.put(None, b"v"), lambda: t.put(b"k", None), lambda: t.delete(None)):
            with pytest.raises(ValueError):
                call()
        assert t._seq == 0
        with pytest.raises(Exception, match="key must not be NULL"):
            t.upsert(spark.createDataFrame([(None, bytearray(b"v"))], "key binary, value binary"))
        assert t.manifest.version == 0


def test_compaction_keeps_the_view_and_drops_tombstones(spark, path):
    with Table.open(spark, path, Options(max_runs=2)) as t:
        t.put(b"k1", b"v1")
        t.flush()
        t.delete(b"k1")
        t.flush()
        assert t.ops().count() == 2 and not t.compact()
        for i in range(4):
            t.put(b"k2", b"v%d" % i)
            t.flush()
        before = rows(t.scan())
        assert t.compact()
        assert len(t.manifest.runs) == 2 and rows(t.scan()) == before == [(b"k2", b"v3")]
        assert t.compact(max_runs=1)
        assert rows(t.scan()) == before and t.ops().count() == 1
        t.put(b"k1", b"again")
        assert t.get(b"k1") == b"again"


def test_merge_without_the_oldest_run_keeps_tombstones(spark):
    old = spark.createDataFrame([(b"k", b"1", False, 1)], OPS)
    mid = spark.createDataFrame([(b"k", None, True, 2)], OPS)
    new = spark.createDataFrame([(b"j", b"3", False, 3)], OPS)
    newer = merge.merge_runs(mid, new)
    assert newer.count() == 2
    assert merge.live(newer.unionByName(old)).select("key").collect()[0]["key"] == b"j"
    assert merge.merge_runs(old, mid, drop_tombstones=True).count() == 0


def test_versions_are_snapshots(spark, path):
    t = Table.open(spark, path)
    t.put(b"k", b"1")
    t.flush()
    seen = t.scan()
    t.put(b"k", b"2")
    t.flush()
    assert rows(seen) == [(b"k", b"1")]
    old = Table.open(spark, path, version=1)
    assert old.get(b"k") == b"1"
    with pytest.raises(OSError, match="read-only"):
        old.put(b"k", b"3")
    t.compact(max_runs=1)
    assert t.vacuum() == 2 and rows(t.scan()) == [(b"k", b"2")]


def test_second_writer_loses(spark, path):
    a, b = Table.open(spark, path), Table.open(spark, path)
    a.put(b"k", b"a")
    b.put(b"k", b"b")
    a.flush()
    with pytest.raises(FileExistsError):
        b.flush()
    assert Table.open(spark, path).get(b"k") == b"a"


def test_tiering(spark, path):
    with Table.open(spark, path, Options(keep_local=4, max_runs=100)) as t:
        for i in range(8):
            t.put(b"k", b"v%d" % i)
            t.flush()
        t.tier()
        tiers = [r["tier"] for r in t.runs().collect()]
        assert tiers == ["local"] * 4 + ["remote"] * 4
        assert t.vacuum() == 4
    with Table.open(spark, path) as t:
        assert t.get(b"k") == b"v7" and t.ops().count() == 8


def test_upsert_order_and_bulk_delete(spark, path):
    with Table.open(spark, path) as t:
        batch = spark.range(1000).select(
            F.encode((F.col("id") % 10).cast("string"), "UTF-8").alias("key"), F.encode(F.col("id").cast("string"), "UTF-8").alias("value"), "id"
        )
        t.upsert(batch, order="id")
        assert rows(t.scan()) == [(b"%d" % i, b"%d" % (990 + i)) for i in range(10)]
        t.remove(spark.createDataFrame([(bytearray(b"3"),)], "key binary"))
        assert t.get(b"3") is None and t.scan().count() == 9
        with pytest.raises(ValueError, match="not above"):
            t.append_ops(spark.createDataFrame([(b"k", b"1", False, 1)], OPS))
        assert len(manifests.versions(t.storage)) == t.manifest.version


def test_random_operations_equal_a_dict(spark, path):
    rng, model = random.Random(12345), {}
    t = Table.open(spark, path, Options(max_runs=3))
    for step in range(1500):
        key, kind = b"k%d" % rng.randrange(200), rng.random()
        if kind < 0.7:
            model[key] = b"v%d" % rng.randrange(10_000)
            t.put(key, model[key])
        else:
            model.pop(key, None)
            t.delete(key)
        if step % 300 == 299:
            t.flush()
            t.compact()
    t.close()
    with Table.open(spark, path) as t:
        assert rows(t.scan()) == sorted(model.items())
        keys = spark.createDataFrame([(bytearray(b"k%d" % i),) for i in range(200)], "key binary")
        assert {bytes(r["key"]): bytes(r["value"]) for r in t.multi_get(keys).collect()} == model


def test_memory_table(spark):
    t = MemoryTable(spark)
    t.put(b"b", b"2")
    t.put(b"a", b"1")
    t.delete(b"c")
    t.flush()
    assert t.get(b"a") == b"1" and t.get(b"c") is None and rows(t.scan(b"b")) == [(b"b", b"2")]
    t.close()
    with pytest.raises(OSError):
        t.get(b"a")


def test_absent_key_is_pruned_by_range(spark, path):
    with Table.open(spark, path) as t:
        t.put(b"m", b"1")
        t.flush()
        assert not t.manifest.runs[0].overlaps(b"n", None) and t.manifest.runs[0].overlaps(b"a", b"m")
        assert t.ops(b"n", b"z").count() == 0


def test_streaming_ingest_applies_a_batch_once(spark, path, tmp_path):
    from kvtable.streaming.ingest import ingest

    source = str(tmp_path / "source")
    batch = spark.range(50).select(
        F.encode((F.col("id") % 5).cast("string"), "UTF-8").alias("key"),
        F.encode(F.col("id").cast("string"), "UTF-8").alias("value"),
        (F.col("id") == 49).alias("tombstone"),
        F.col("id").alias("n"),
    )
    batch.withColumn("value", F.when(~F.col("tombstone"), F.col("value"))).write.parquet(source)
    stream = spark.readStream.schema("key binary, value binary, tombstone boolean, n bigint").parquet(source)
    t = Table.open(spark, path)
    for _ in range(2):
        query = ingest(stream, t, "events", str(tmp_path / "checkpoint"), order="n", availableNow=True)
        query.awaitTermination()
    assert rows(t.scan()) == [(b"%d" % i, b"%d" % (45 + i)) for i in range(4)]
    version = t.manifest.version
    t.upsert(batch, order="n", batch=("events", 0))  # delivered again
    assert t.manifest.version == version


# --- two writers --------------------------------------------------------------------


def test_vacuum_of_a_stale_handle_keeps_what_others_committed(spark, path):
    a, b = Table.open(spark, path), Table.open(spark, path)
    a.put(b"k", b"a")
    a.flush()
    assert b.vacuum() == 0 and Table.open(spark, path).get(b"k") == b"a"
    a.put(b"k", b"newer")
    a.flush()
    a.compact(max_runs=1)
    assert b.vacuum() == 2 and Table.open(spark, path).get(b"k") == b"newer"


def test_vacuum_keeps_runs_that_are_being_written(spark, path):
    """Another handle vacuums after a run, or a copy for the remote tier, is written and before it is committed."""
    a, b = Table.open(spark, path, Options(keep_local=0)), Table.open(spark, path)
    commit, seen = a._commit, []

    def late(manifest):
        seen.append(b.vacuum())
        commit(manifest)

    a._commit = late
    a.put(b"k", b"1")
    a.flush()
    a.tier()
    a.put(b"k", b"2")
    a.flush()
    a.compact(max_runs=1)
    assert seen == [0, 0, 1, 0, 2]  # what was replaced in between goes
    assert Table.open(spark, path).get(b"k") == b"2" and Table.open(spark, path).runs().first()["tier"] == "remote"
    assert b.vacuum() == 1 and b.vacuum(abandoned_after=0) == 0


def test_abandoned_runs_go_after_their_time(spark, path):
    t = Table.open(spark, path)
    t.put(b"k", b"1")
    t.flush()
    spark.range(1).write.parquet(t._run_path(7, "runs"))  # a writer that died
    assert t.vacuum() == 0 and t.vacuum(abandoned_after=-1) == 1 and t.get(b"k") == b"1"


def test_writers_share_no_names(spark, path):
    a, b = Table.open(spark, path), Table.open(spark, path)
    assert a._run_path(0, "runs") != b._run_path(0, "runs")
    a.storage.create("manifests/x.json", "a")
    with pytest.raises(FileExistsError):
        b.storage.create("manifests/x.json", "b")
    assert a.storage.read("manifests/x.json") == "a" and a.storage.names("manifests") == ["x.json"]


def test_the_loser_refreshes_and_goes_on(spark, path):
    a, b = Table.open(spark, path), Table.open(spark, path)
    a.put(b"k", b"a")
    a.put(b"j", b"a")
    a.flush()
    b.put(b"k", b"b")
    with pytest.raises(FileExistsError):
        b.flush()
    b.refresh()
    b.flush()
    assert rows(Table.open(spark, path).scan()) == [(b"j", b"a"), (b"k", b"b")]


def test_a_batch_takes_one_sequence_number(spark, path):
    t = Table.open(spark, path)
    batch = spark.range(8).repartition(4).select(F.encode(F.col("id").cast("string"), "UTF-8").alias("key"), F.lit(b"v").alias("value"))
    t.upsert(batch)
    t.upsert(batch)
    assert t.manifest.max_seq == 2 and t.scan().count() == 8


# --- reads, compaction, variants --------------------------------------------------------


def test_lookups_read_only_runs_that_can_hold_the_keys(spark, path, monkeypatch):
    t = Table.open(spark, path)
    for low in (0, 1000, 2000):
        t.upsert(spark.range(low, low + 1000).select(F.encode(F.format_string("%05d", "id"), "UTF-8").alias("key"), F.lit(b"v").alias("value")))
    asked = spark.createDataFrame([(bytearray(b"%05d" % i),) for i in (1001, 1500, 9999)], "key binary")
    for named in (200, 1):
        monkeypatch.setattr("kvtable.table.NAMED_KEYS", named)
        ops = t._ops_for(asked.limit(2))
        assert len(ops.inputFiles()) and all("run-000000000001" in f for f in ops.inputFiles())
        assert {r["status"] for r in t.lookup(asked).collect()} == {"Found", "NotFound"} and t.multi_get(asked).count() == 2
    monkeypatch.setattr("kvtable.table.NAMED_KEYS", 200)
    plan = t._ops_for(asked.limit(2))._jdf.queryExecution().executedPlan().toString()
    assert "In(key" in plan[plan.index("PushedFilters") :] or "EqualTo(key" in plan[plan.index("PushedFilters") :]
    assert t.lookup(asked.limit(0)).count() == 0


def test_tiered_compaction_leaves_the_base_alone(spark, path):
    t = Table.open(spark, path, Options(max_runs=3))
    key = F.encode(F.format_string("%05d", "id"), "UTF-8").alias("key")
    t.upsert(spark.range(500).select(key, F.lit(b"base").alias("value")))
    base = t.manifest.runs[-1].path
    for i in range(6):
        t.upsert(spark.range(i, i + 3).select(key, F.lit(b"%d" % i).alias("value")))
        t.remove(spark.range(400 + i, 401 + i).select(key))
        t.compact()
        assert len(t.manifest.runs) <= 3 and t.manifest.runs[-1].path == base
    assert t.scan().count() == 494 and t.get(b"00005") == b"5" and t.get(b"00403") is None
    assert sum(r.n_tombstones for r in t.manifest.runs) == 6  # the base still needs them
    t.compact(max_runs=1)
    assert t.scan().count() == t.ops().count() == 494
    with pytest.raises(ValueError, match="tiered or oldest"):
        Options(compaction="newest")


def test_oldest_compaction_merges_the_base(spark, path):
    t = Table.open(spark, path, Options(max_runs=2, compaction="oldest"))
    for i in range(3):
        t.put(b"k%d" % i, b"v" * (10 - i))
        t.flush()
    newest = t.manifest.runs[0].path
    assert t.compact() and t.manifest.runs[0].path == newest and t.manifest.runs[1].n_rows == 2


def test_options_reach_the_files(spark, path):
    import pyarrow.parquet as pq

    sizes = []
    for bits in (1 << 10, 1 << 16):
        where = f"{path}-{bits}"
        t = Table.open(spark, where, Options(bloom_bits=bits, index_every=4))
        t.upsert(spark.range(2000).coalesce(1).select(F.encode(F.format_string("%05d", "id"), "UTF-8").alias("key"), F.lit(b"v").alias("value")))
        file = next(f for f in t.ops().inputFiles() if pq.ParquetFile(f.removeprefix("file://")).metadata.num_rows)
        sizes.append(len(open(file.removeprefix("file://"), "rb").read()))
        assert t.get(b"00007") == b"v" and t.get(b"x") is None
    assert sizes[1] > sizes[0] + 4000  # the larger filter


def test_log_table(spark, path):
    from kvtable.table import LogTable

    with LogTable.open(spark, path) as t:
        t.put(b"k", b"1")
        t.put(b"k", b"2")
        t.delete(b"j")
        assert LogTable.open(spark, path).get(b"k") == b"2"  # durable without a flush
        t.append(spark.createDataFrame([(b"k", b"3", 10), (b"j", b"4", 11), (b"k", b"5", 12)], "key binary, value binary, n bigint"), order="n")
        t.flush()
        assert [(bytes(r["key"]), r["seq"]) for r in t.replay().collect()] == [(b"k", 1), (b"k", 2), (b"j", 3), (b"k", 4), (b"j", 5), (b"k", 6)]
        for call in (t.compact, t.tier, lambda: t.upsert(spark.range(1))):
            with pytest.raises(NotImplementedError):
                call()
    with LogTable.open(spark, path) as t:
        assert t.get(b"k") == b"5" and t.get(b"j") == b"4" and rows(t.scan()) == [(b"j", b"4"), (b"k", b"5")]
        t.put(b"k", b"6")
        assert t.get(b"k") == b"6"
