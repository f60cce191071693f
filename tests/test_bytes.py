import struct
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kvtable.functions import codec
from kvtable.functions.murmur import murmur3
from kvtable.operators import log, runs
from kvtable.schema import OPS, Options
from kvtable.sources import binary


def one(df):
    return [tuple(r) for r in df.collect()]


def test_hex_is_strict(spark):
    df = spark.createDataFrame([("00ff7F",), ("",), (None,)], "t string")
    assert [bytes(r[0]) for r in df.select(codec.from_hex(F.col("t"))).collect()] == [b"\x00\xff\x7f", b"", b""]
    for bad in ("abc", "zz"):
        with pytest.raises(Exception, match="not hex"):
            spark.createDataFrame([(bad,)], "t string").select(codec.from_hex(F.col("t"))).collect()
    assert one(spark.createDataFrame([(bytearray(b"\x0a"),), (None,)], "b binary").select(codec.to_hex(F.col("b")))) == [("0a",), ("",)]


def test_encoded_numbers_and_composites_keep_their_order(spark):
    numbers = [-(2**63), -300, -1, 0, 1, 255, 256, 2**63 - 1]
    df = spark.createDataFrame([(n,) for n in numbers], "n bigint").select("n", codec.from_i64(F.col("n")).alias("k"))
    assert [r["n"] for r in df.orderBy("k").collect()] == numbers
    assert {r[0] for r in df.select(codec.to_i64(F.col("k")) == F.col("n")).collect()} == {True}
    pairs = [(b"", b"b"), (b"\x00", b""), (b"\x00", b"\x00"), (b"a", b"z"), (b"a\x00", b"a"), (b"ab", b"")]
    df = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in reversed(pairs)], "a binary, b binary")
    got = df.orderBy(codec.composite(F.col("a"), F.col("b"))).collect()
    assert [(bytes(r["a"]), bytes(r["b"])) for r in got] == pairs


def test_murmur_vectors(spark):
    """Published test vectors of the 32-bit x86 variant."""
    vectors = [(b"", 0, 0), (b"", 1, 0x514E28B7), (b"", 0xFFFFFFFF, 0x81F16F39), (b"test", 0, 0xBA6BD213), (b"test", 0x9747B28C, 0x704B81DC),
               (b"Hello, world!", 0, 0xC0363E43), (b"Hello, world!", 0x9747B28C, 0x24884CBA), (b"\xff\xff\xff\xff", 0, 0x76293B50),
               (b"aa", 0x9747B28C, 0x5D211726)]
    for data, seed, want in vectors:
        got = spark.createDataFrame([(bytearray(data),)], "b binary").select(murmur3(F.col("b"), seed)).first()[0]
        assert got == want, (data, seed)


@given(st.lists(st.tuples(st.binary(max_size=12), st.one_of(st.none(), st.binary(max_size=20))), max_size=8), st.integers(0, 60))
def test_log_prefix_survives_any_cut(records, cut):
    data, ends = b"", []
    for i, (key, value) in enumerate(records):
        data += binary.LOG_RECORD.pack(2 if value is None else 1, i, len(key), -1 if value is None else len(value)) + key + (value or b"")
        ends.append(len(data))
    short = data[: max(0, len(data) - cut)]
    whole = sum(e <= len(short) for e in ends)
    assert [(k, v) for _, k, v, _ in binary.log_records(short)] == records[:whole]


def stored_run(records, every=2):
    data, index = b"", []
    for i, (key, value, seq) in enumerate(records):
        if i % every == 0:
            index.append((key, len(data)))
        body = binary.RECORD.pack(len(key), -1 if value is None else len(value), seq) + key + (value or b"")
        data += body + struct.pack(">I", zlib.crc32(body))
    at = len(data)
    for key, offset in index:
        data += struct.pack(">i", len(key)) + key + struct.pack(">q", offset)
    return data + binary.FOOTER.pack(binary.RUN_MAGIC, at, len(index)), index


def test_stored_files(spark, tmp_path):
    records = [(b"a", b"1", 1), (b"b", None, 2), (b"c", b"", 3)]
    data, index = stored_run(records)
    (tmp_path / "data_1.sst").write_bytes(data)
    folder = "file://" + str(tmp_path)
    got = binary.read_stored_runs(spark, folder + "/data_1.sst").orderBy("offset").collect()
    assert [(bytes(r["key"]), r["value"] and bytes(r["value"]), r["seq"]) for r in got] == [(b"a", b"1", 1), (b"b", None, 2), (b"c", bytearray(b""), 3)]
    assert [r["tombstone"] for r in got] == [False, True, False]
    assert sorted((bytes(r["key"]), r["offset"]) for r in binary.read_indexes(spark, folder + "/data_1.sst").collect()) == index
    bad = bytearray(data)
    bad[20] ^= 1
    (tmp_path / "data_2.sst").write_bytes(bytes(bad))
    with pytest.raises(Exception, match="checksum"):
        binary.read_stored_runs(spark, folder + "/data_2.sst").count()
    assert len(list(binary.run_records(bytes(bad), permissive=True))) <= 1
    assert [r["run_order"] for r in binary.discover_runs(spark, folder).orderBy(F.desc("path")).collect()] == [0, 1]
    (tmp_path / "x.bf").write_bytes(struct.pack(">iiii", binary.FILTER_MAGIC, 64, 3, 2) + bytes([5, 128]))
    assert sorted(r["position"] for r in binary.read_filters(spark, folder + "/x.bf").collect()) == [0, 2, 15]
    with pytest.raises(ValueError):
        binary.filter_bits(b"BLOX" + bytes(12))
    (tmp_path / "manifest.json").write_text('{"sstables":[{"file":"s/b.sst","minKey":"61","maxKey":"7a"},{"file":"s/a.sst","bloom":"s/a.bf","minKey":"","maxKey":""}]}')
    listed = binary.read_stored_manifest(spark, folder + "/manifest.json").orderBy("run_order").collect()
    assert [(r["file"], r["bloom"], bytes(r["min_key"])) for r in listed] == [("s/b.sst", None, b"a"), ("s/a.sst", "s/a.bf", b"")]
    (tmp_path / "empty.json").write_text("{}")
    assert binary.read_stored_manifest(spark, folder + "/empty.json").count() == 0
    assert binary.index_of(b"short") == (5, [])


def test_torn_log_and_first_bad_record(spark):
    ops = spark.createDataFrame([(b"k1", b"v1", False, 1), (b"k1", b"v2", False, 2), (b"k2", b"v3", False, 3)], OPS)
    assert [r["lsn"] for r in log.log_positions(ops).orderBy("seq").collect()] == [21, 42, 63]
    assert log.torn_at(ops, 62).count() == 2
    assert log.valid_prefix(ops, F.col("seq") != 2).count() == 1
    assert log.valid_prefix(ops, F.lit(True)).count() == 3
    assert log.max_seq(ops.limit(0)).first()[0] == 0
    grown = log.buffer_bytes(ops).orderBy("seq").collect()
    assert [r["buffer_bytes"] for r in grown] == [4, 6, 10]


def test_filters_never_miss(spark):
    rows = spark.range(300).select(
        (F.col("id") % 3).alias("run"), F.encode(F.concat(F.lit("key"), F.col("id")), "UTF-8").alias("key")
    )
    filters = runs.bloom_filters(rows, bits=4096, hashes=4)
    found = runs.bloom_candidates(rows.select("key"), filters, bits=4096, hashes=4)
    assert rows.join(found, ["run", "key"], "left_anti").count() == 0
    others = spark.range(1000, 1300).select(F.encode(F.concat(F.lit("key"), F.col("id")), "UTF-8").alias("key"))
    assert runs.bloom_candidates(others, filters, bits=4096, hashes=4).count() < 60


def test_options_clamp_and_reject():
    assert Options(index_every=0, keep_local=-1).index_every == 1 and Options(keep_local=-1).keep_local == 0
    for bad in ({"bloom_bits": 0}, {"bloom_hashes": 0}, {"write_buffer_bytes": 0}, {"max_runs": 0}):
        with pytest.raises(ValueError):
            Options(**bad)


def test_running_sum_over_many_blocks(spark):
    from kvtable.operators.prefix import running_sum

    df = running_sum(spark.range(1000).withColumnRenamed("id", "seq"), "seq", F.col("seq"), "s", block=64)
    assert [r["s"] for r in df.orderBy("seq").collect()] == [i * (i + 1) // 2 for i in range(1000)]
