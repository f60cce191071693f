"""Registered queries of the table engine and their SQL counterparts.

Keys and values are shown as hex, so that a comparison does not depend on
how a client renders BINARY.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvtable.functions import codec
from kvtable.functions.murmur import SEED_1, SEED_2, murmur3
from kvtable.operators import log, merge, ranges, runs
from kvtable.plans import stored
from kvtable.plans.event_log import event_ops, event_requests, event_runs, order_ops
from kvtable.schema import Options

START, END = b"u000010", b"u000100"
LOG_TENTHS = 9
KEEP_RUNS, KEEP_LOCAL = 4, 4

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# --- SQL building blocks ------------------------------------------------------

_OPS = """ops AS (
  SELECT encode(printf('u%06d', user_id)) AS key,
         CASE WHEN event_type <> 'error' THEN encode(props) END AS value,
         event_type = 'error' AS tombstone, event_id + 1 AS seq
  FROM events)"""
_LATEST = """latest AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM ops) WHERE rn = 1)"""
_RUNS = """runs AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY run, key ORDER BY seq DESC) AS rn
    FROM (SELECT *, ((seq - 1) * 8 // (SELECT count(*) FROM events))::BIGINT AS run FROM ops)) WHERE rn = 1)"""
_STATS = """stats AS (
  SELECT run, min(key) AS min_key, max(key) AS max_key, count(*) AS n_rows,
         sum(tombstone::BIGINT)::BIGINT AS n_tombstones, min(seq) AS min_seq, max(seq) AS max_seq
  FROM runs GROUP BY run)"""
_REQUESTS = """requests AS (
  SELECT encode(printf('u%06d', user_id)) AS key FROM events UNION SELECT encode(printf('x%06d', user_id)) FROM events)"""
_ORDERS = """ops AS (
  SELECT unhex(lpad(hex(o_orderkey), 16, '0')) AS key, CASE WHEN v IS NOT NULL THEN encode(v) END AS value,
         v IS NULL AS tombstone, o_orderkey * 3 + n AS seq
  FROM (SELECT o_orderkey, o_orderpriority AS v, 0 AS n FROM orders
        UNION ALL SELECT o_orderkey, o_orderstatus, 1 FROM orders
        UNION ALL SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END, 2 FROM orders))"""
_SIZE = "coalesce(octet_length(value), 0)"
_KV = "SELECT hex(key) AS key_hex, hex(value) AS value_hex"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _registered(sql: str):
    def add(query):
        QUERIES[query.__name__] = query
        ORACLES[query.__name__] = sql
        return query

    return add


def _hexed(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(F.hex("key").alias("key_hex"), F.hex("value").alias("value_hex"), *more)


# --- reads ----------------------------------------------------------------------


@_registered(_with(_OPS, _LATEST) + f"{_KV} FROM latest WHERE NOT tombstone")
def kv_scan_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hexed(merge.scan(event_ops(spark, sf_dir)).orderBy("key"))


@_registered(_with(_OPS, _LATEST) + f"{_KV} FROM latest WHERE NOT tombstone AND key BETWEEN encode('u000010') AND encode('u000100')")
def kv_scan_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hexed(merge.scan(event_ops(spark, sf_dir), START, END).orderBy("key"))


@_registered(_with(_OPS, _LATEST) + f"{_KV} FROM latest WHERE NOT tombstone AND key >= encode('u000100')")
def kv_scan_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hexed(merge.scan(event_ops(spark, sf_dir), END, None).orderBy("key"))


@_registered(_with(_OPS, _LATEST) + f"{_KV} FROM latest WHERE NOT tombstone AND key <= encode('u000010')")
def kv_scan_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hexed(merge.scan(event_ops(spark, sf_dir), None, START).orderBy("key"))


@_registered(_with(_OPS, _LATEST) + "SELECT count(*) AS n_rows FROM latest WHERE NOT tombstone AND key BETWEEN encode('u000100') AND encode('u000010')")
def kv_scan_empty_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.scan(event_ops(spark, sf_dir), END, START).agg(F.count(F.lit(1)).alias("n_rows"))


@_registered(
    _with(_OPS, _LATEST, _REQUESTS)
    + """SELECT hex(r.key) AS key_hex, hex(value) AS value_hex,
  CASE WHEN seq IS NULL THEN 'NotFound' WHEN tombstone THEN 'Deleted' ELSE 'Found' END AS status
FROM requests r LEFT JOIN latest l ON r.key = l.key"""
)
def kv_get_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hexed(merge.status(event_requests(spark, sf_dir), event_ops(spark, sf_dir)), "status")


@_registered(_with(_OPS, _LATEST, _REQUESTS) + f"{_KV} FROM requests SEMI JOIN latest USING (key) JOIN latest USING (key) WHERE NOT tombstone")
def kv_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hexed(merge.multi_get(event_requests(spark, sf_dir), event_ops(spark, sf_dir)))


@_registered(_with(_OPS, _LATEST) + f"{_KV} FROM latest WHERE NOT tombstone")
def kv_scan_across_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hexed(merge.scan(event_runs(spark, sf_dir)).orderBy("key"))


# --- runs -------------------------------------------------------------------------


@_registered(
    _with(_OPS, _RUNS, _STATS)
    + "SELECT run, hex(min_key) AS min_key, hex(max_key) AS max_key, n_rows, n_tombstones, min_seq, max_seq FROM stats"
)
def kv_run_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = runs.run_statistics(event_runs(spark, sf_dir))
    return stats.withColumns({c: F.hex(c) for c in ("min_key", "max_key")})


@_registered(_with(_OPS, _RUNS) + "SELECT run, max(seq) AS max_seq FROM runs GROUP BY run")
def kv_max_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_statistics(event_runs(spark, sf_dir)).select("run", "max_seq")


_COMPACTED = """merged AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT * REPLACE (greatest(run - {last}, 0) AS run),
           row_number() OVER (PARTITION BY greatest(run - {last}, 0), key ORDER BY seq DESC) AS rn
    FROM runs) WHERE rn = 1)"""
_PHYSICAL = f"{_KV}, run, tombstone, seq FROM merged"


def _physical(rows: DataFrame) -> DataFrame:
    return _hexed(rows, "run", "tombstone", "seq")


@_registered(_with(_OPS, _RUNS, _COMPACTED.format(last=1)) + _PHYSICAL)
def kv_compact_two_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _physical(runs.compacted(event_runs(spark, sf_dir), 8, 7, drop_tombstones=False))


@_registered(_with(_OPS, _RUNS, _COMPACTED.format(last=4)) + _PHYSICAL)
def kv_compact_to_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _physical(runs.compacted(event_runs(spark, sf_dir), 8, KEEP_RUNS, drop_tombstones=False))


@_registered(_with(_OPS, _RUNS, _COMPACTED.format(last=4)) + _PHYSICAL + " WHERE run > 0 OR NOT tombstone")
def kv_compact_bottommost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _physical(runs.compacted(event_runs(spark, sf_dir), 8, KEEP_RUNS, drop_tombstones=True))


@_registered(
    _with(_OPS, _RUNS, _STATS)
    + "SELECT run, CASE WHEN row_number() OVER (ORDER BY run DESC) > 4 THEN 'remote' ELSE 'local' END AS tier FROM stats"
)
def kv_tier_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.tiers(runs.run_statistics(event_runs(spark, sf_dir)), KEEP_LOCAL)


@_registered(
    _with(_OPS, _RUNS, _STATS, _REQUESTS)
    + "SELECT hex(key) AS key_hex, run FROM requests JOIN stats ON key BETWEEN min_key AND max_key"
)
def kv_read_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = runs.run_statistics(event_runs(spark, sf_dir))
    return runs.read_candidates(event_requests(spark, sf_dir), stats).select(F.hex("key").alias("key_hex"), "run")


_INDEX = f"""placed AS (
  SELECT run, key, row_number() OVER w - 1 AS ordinal,
         coalesce(sum(20 + octet_length(key) + {_SIZE}) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
  FROM runs WINDOW w AS (PARTITION BY run ORDER BY key)),
indexed AS (SELECT run, ordinal, key, "offset" FROM placed WHERE ordinal % 32 = 0)"""


@_registered(_with(_OPS, _RUNS, _INDEX) + 'SELECT run, ordinal, hex(key) AS key_hex, "offset" FROM indexed')
def kv_sparse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = runs.sparse_index(event_runs(spark, sf_dir))
    return index.select("run", "ordinal", F.hex("key").alias("key_hex"), "offset")


@_registered(
    _with(_OPS, _RUNS, _INDEX, _REQUESTS)
    + """SELECT hex(r.key) AS key_hex, n.run, coalesce(max(i."offset"), 0)::BIGINT AS "offset"
FROM requests r CROSS JOIN (SELECT DISTINCT run FROM indexed) n
LEFT JOIN indexed i ON i.run = n.run AND i.key <= r.key GROUP BY r.key, n.run"""
)
def kv_index_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = runs.sparse_index(event_runs(spark, sf_dir))
    return runs.index_seek(event_requests(spark, sf_dir), index).select(F.hex("key").alias("key_hex"), "run", "offset")


@_registered(
    _with(_OPS, _RUNS, _LATEST)
    + """SELECT p AS physical_rows, l AS live_rows, p / nullif(l, 0) AS space_amplification
FROM (SELECT (SELECT count(*) FROM runs) AS p, (SELECT count(*) FROM latest WHERE NOT tombstone) AS l)"""
)
def kv_space_amplification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.amplification(event_runs(spark, sf_dir))


# --- log --------------------------------------------------------------------------

_LSN = f"lsn AS (SELECT *, sum(17 + octet_length(key) + {_SIZE}) OVER (ORDER BY seq)::BIGINT AS lsn FROM ops)"


@_registered(_with(_OPS, _LSN) + "SELECT seq, lsn FROM lsn")
def kv_wal_lsn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.log_positions(event_ops(spark, sf_dir)).select("seq", "lsn")


@_registered(
    _with(_OPS, _LSN, _LATEST.replace("FROM ops", f"FROM lsn WHERE lsn <= (SELECT max(lsn) * {LOG_TENTHS} // 10 FROM lsn)"))
    + f"{_KV}, tombstone, seq FROM latest"
)
def kv_replay_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that lost its last tenth."""
    return _hexed(log.replayed(log.torn_share(event_ops(spark, sf_dir), LOG_TENTHS)), "tombstone", "seq")


@_registered(
    _with(_OPS)
    + f"""SELECT seq, sum(delta) OVER (ORDER BY seq)::BIGINT AS buffer_bytes FROM (
  SELECT seq, greatest(octet_length(key) + {_SIZE} - coalesce(lag({_SIZE}) OVER (PARTITION BY key ORDER BY seq), 0), 0) AS delta FROM ops)"""
)
def kv_memtable_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.buffer_bytes(event_ops(spark, sf_dir)).select("seq", "buffer_bytes")


# --- bytes --------------------------------------------------------------------------


@_registered(
    """SELECT e.event_id, lower(hex(encode(props))) AS value_hex, true AS same FROM events e"""
)
def kv_hex_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", codec.from_text(F.col("props")).alias("value"))
    text = codec.to_hex(F.col("value"))
    return events.select("event_id", text.alias("value_hex"), (codec.from_hex(text) == F.col("value")).alias("same"))


@_registered(
    """SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal_cents, c_custkey) AS place
FROM (SELECT c_custkey, cast(round(c_acctbal * 100) AS BIGINT) AS c_acctbal_cents FROM customer)"""
)
def kv_byte_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by balance, negative ones too, sorted by their encoded keys."""
    cents = F.round(F.col("c_acctbal") * 100).cast("bigint")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    keyed = customers.select("c_custkey", F.concat(codec.from_i64(cents), codec.from_i64(F.col("c_custkey"))).alias("key"))
    places = ranges.numbered(keyed, [], "key", ranges.splitters(keyed))
    return places.select("c_custkey", (F.col("_nth") + 1).alias("place"))


_MUL = lambda a, c: f"((({a})::HUGEINT * {c}::HUGEINT) & 4294967295)::BIGINT"
_ROT = lambda a, n: f"((({a} << {n}) & 4294967295) | ({a} >> {32 - n}))"


def _murmur_sql(seed: int) -> str:
    scrambled = f"list_transform(ks, lambda k: {_MUL(f'({_ROT(_MUL("k", 3432918353), 15)})', 461845907)})"
    tail = _MUL(f"({_ROT(_MUL('t', 3432918353), 15)})", 461845907)
    step = f"(({_ROT('xor(h, k)', 13)})::HUGEINT * 5 + 3864292196) & 4294967295"
    return f"""(SELECT key, {_MUL("xor(z, z >> 13)", 3266489909)} AS z FROM (
    SELECT key, {_MUL("xor(y, y >> 16)", 2246822507)} AS z FROM (
      SELECT key, xor(xor(list_reduce(list_prepend({seed}::BIGINT, {scrambled}), lambda h, k: ({step})::BIGINT), {tail}), n) AS y FROM hashed)))"""


_HASHED = """byted AS (SELECT key, octet_length(key) AS n, hex(key) AS h FROM requests),
hashed AS (
  SELECT key, n::BIGINT AS n,
    list_transform(range(0, n // 4), lambda i: ('0x' || h[8*i+7:8*i+8] || h[8*i+5:8*i+6] || h[8*i+3:8*i+4] || h[8*i+1:8*i+2])::BIGINT) AS ks,
    CASE n % 4 WHEN 0 THEN 0::BIGINT
      WHEN 1 THEN ('0x' || h[2*n-1:2*n])::BIGINT
      WHEN 2 THEN ('0x' || h[2*n-1:2*n] || h[2*n-3:2*n-2])::BIGINT
      ELSE ('0x' || h[2*n-1:2*n] || h[2*n-3:2*n-2] || h[2*n-5:2*n-4])::BIGINT END AS t
  FROM byted)"""


@_registered(
    _with(_REQUESTS, _HASHED, f"first AS {_murmur_sql(SEED_1)}", f"second AS {_murmur_sql(SEED_2)}")
    + "SELECT hex(key) AS key_hex, xor(a.z, a.z >> 16) AS h1, xor(b.z, b.z >> 16) AS h2 FROM first a JOIN second b USING (key)"
)
def kv_murmur(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = event_requests(spark, sf_dir)
    return keys.select(F.hex("key").alias("key_hex"), murmur3(F.col("key"), SEED_1).alias("h1"), murmur3(F.col("key"), SEED_2).alias("h2"))


_HASHES = f"""first AS {_murmur_sql(SEED_1)},
second AS {_murmur_sql(SEED_2)},
bits AS (
  SELECT key, list_transform(range(0, {Options.bloom_hashes}), lambda i: (xor(a.z, a.z >> 16) + i * xor(b.z, b.z >> 16)) % {Options.bloom_bits}) AS p
  FROM first a JOIN second b USING (key))"""
_EVENT_KEYS = "requests AS (SELECT DISTINCT key FROM ops)"
_FILTERS = "filters AS (SELECT DISTINCT run, unnest(p) AS position FROM runs JOIN bits USING (key))"


@_registered(_with(_OPS, _RUNS, _EVENT_KEYS, _HASHED, _HASHES, _FILTERS) + "SELECT run, position FROM filters")
def kv_bloom_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set bits of each run's filter."""
    return runs.bloom_filters(event_runs(spark, sf_dir)).select("run", F.col("position").cast("bigint").alias("position"))


@_registered(
    _with(_OPS, _RUNS, _REQUESTS, _HASHED, _HASHES, _FILTERS, "asked AS (SELECT key, list_distinct(p) AS p FROM bits)")
    + """SELECT hex(key) AS key_hex, run FROM (SELECT key, len(p) AS need, unnest(p) AS position FROM asked) JOIN filters USING (position)
GROUP BY key, run, need HAVING count(*) = need"""
)
def kv_bloom_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs that a lookup of each key, present or not, cannot rule out by their filters."""
    found = runs.bloom_candidates(event_requests(spark, sf_dir), runs.bloom_filters(event_runs(spark, sf_dir)))
    return found.select(F.hex("key").alias("key_hex"), "run")


@_registered(_with(_OPS, _RUNS) + "SELECT run, count(*) AS n_keys, 0::BIGINT AS n_missed FROM runs GROUP BY run")
def kv_bloom_no_false_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_runs(spark, sf_dir)
    found = runs.bloom_candidates(rows.select("key").distinct(), runs.bloom_filters(rows)).withColumn("hit", F.lit(1))
    joined = rows.select("run", "key").join(found, ["run", "key"], "left")
    missed = F.sum(F.when(F.col("hit").isNull(), 1).otherwise(0)).cast("bigint")
    return joined.groupBy("run").agg(F.count(F.lit(1)).alias("n_keys"), missed.alias("n_missed"))


def _half_bytes() -> list[int]:
    """CRC-32 of the 16 half bytes, from its polynomial."""
    out = []
    for n in range(16):
        for _ in range(4):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


def _crc_sql(digits: str) -> str:
    """CRC-32 of hex digits; of each byte the low half counts first."""
    halves = f"list_transform(regexp_extract_all(regexp_replace({digits}, '(.)(.)', '\\2\\1', 'g'), '.'), lambda x: ('0x' || x)::BIGINT)"
    step = f"xor(c >> 4, ({_half_bytes()}::BIGINT[])[(xor(c, b) & 15) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {halves}), lambda c, b: {step}), 4294967295::BIGINT)"


_RECORD_HEX = """lpad(hex(octet_length(key)), 8, '0') || CASE WHEN value IS NULL THEN 'FFFFFFFF' ELSE lpad(hex(octet_length(value)), 8, '0') END
  || lpad(hex(seq), 16, '0') || hex(key) || coalesce(hex(value), '')"""


@_registered(_with(_OPS) + f"SELECT seq, {_crc_sql(_RECORD_HEX)}::BIGINT AS crc, true AS whole, false AS damaged_whole FROM ops")
def kv_record_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record's checksum, and whether the record, stored whole and with its last byte changed, passes the test."""
    ops = event_ops(spark, sf_dir)
    body, crc = codec.record_bytes(F.col("key"), F.col("value"), F.col("seq")), codec.record_crc(F.col("key"), F.col("value"), F.col("seq"))
    framed = ops.select("seq", crc.alias("crc"), F.concat(body, F.unhex(F.lpad(F.hex(crc), 8, "0"))).alias("record"))
    cut = lambda r, start, end: F.substr(r, start, end)

    def passes(record):
        size = F.octet_length(record)
        kept = F.conv(F.hex(cut(record, size - 3, F.lit(4))), 16, 10).cast("bigint")
        return F.crc32(cut(record, F.lit(1), size - 4)) == kept

    size = F.octet_length("record")
    last = F.conv(F.hex(cut(F.col("record"), size - 4, F.lit(1))), 16, 10).cast("int").bitwiseXOR(F.lit(1))
    damaged = F.concat(cut(F.col("record"), F.lit(1), size - 5), F.unhex(F.lpad(F.hex(last), 2, "0")), cut(F.col("record"), size - 3, F.lit(4)))
    return framed.select("seq", "crc", passes(F.col("record")).alias("whole"), passes(damaged).alias("damaged_whole"))


# --- a keyspace of orders -------------------------------------------------------------


@_registered(_with(_ORDERS, _LATEST) + f"{_KV} FROM latest WHERE NOT tombstone")
def kv_orders_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hexed(merge.scan(order_ops(spark, sf_dir)).orderBy("key"))


@_registered(
    _with(_ORDERS, _LATEST, "requests AS (SELECT DISTINCT unhex(lpad(hex(l_orderkey), 16, '0')) AS key FROM lineitem)")
    + """SELECT CASE WHEN seq IS NULL THEN 'NotFound' WHEN tombstone THEN 'Deleted' ELSE 'Found' END AS status, count(*) AS n
FROM requests LEFT JOIN latest USING (key) GROUP BY 1"""
)
def kv_orders_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order that a line item names, looked up."""
    keys = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(codec.from_u64(F.col("l_orderkey")).alias("key")).distinct()
    return merge.status(keys, order_ops(spark, sf_dir)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# --- through real tables and stored files ------------------------------------------------


def _through(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql


_BATCHED = f"""batched AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id, key ORDER BY seq DESC) AS rn
    FROM (SELECT *, ((seq - 1) * {stored.BATCHES} // (SELECT count(*) FROM events))::BIGINT AS run_id FROM ops)) WHERE rn = 1)"""
_LIVE = _with(_OPS, _LATEST) + f"{_KV} FROM latest WHERE NOT tombstone"
_SUPPLIERS = f"""records AS (
  SELECT encode(printf('s%06d', s_suppkey)) AS key, CASE WHEN s_acctbal >= 0 THEN encode(s_name) END AS value, s_acctbal < 0 AS tombstone, s_suppkey AS seq
  FROM supplier),
placed AS (
  SELECT *, row_number() OVER (ORDER BY key) - 1 AS ordinal, coalesce(sum(20 + octet_length(key) + {_SIZE}) OVER (
    ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
  FROM records)"""

_through("kv_table_upsert_scan", stored.table_upsert_scan, _LIVE)
_through("kv_table_redelivery", stored.table_redelivery, _LIVE)
_through("kv_table_compacted", stored.table_compacted, _with(_OPS, _LATEST) + f"{_KV}, tombstone FROM latest WHERE NOT tombstone")
_through("kv_table_snapshot", stored.table_snapshot, _with(_OPS, _BATCHED) + f"{_KV} FROM batched WHERE run_id = 0 AND NOT tombstone")
_through(
    "kv_table_manifest",
    stored.table_manifest,
    _with(_OPS, _BATCHED)
    + """SELECT run_id, 'local' AS tier, hex(min(key)) AS min_key, hex(max(key)) AS max_key, count(*) AS n_rows,
  sum(tombstone::BIGINT)::BIGINT AS n_tombstones, run_id + 1 AS min_seq, run_id + 1 AS max_seq FROM batched GROUP BY run_id""",
)
_through(
    "kv_table_tiers",
    stored.table_tiers,
    _with(_OPS, _BATCHED)
    + f"""SELECT run_id, CASE WHEN run_id = {stored.BATCHES - 1} THEN 'local' ELSE 'remote' END AS tier, count(*) AS n_rows,
  run_id < {stored.BATCHES - 1} AS in_remote_folder FROM batched GROUP BY run_id""",
)
_through("kv_table_lookup", stored.table_lookup, ORACLES["kv_get_status"])
_through(
    "kv_table_delete",
    stored.table_delete,
    """SELECT lpad(hex(o_orderkey), 16, '0') AS key_hex, hex(encode(o_orderpriority)) AS value_hex FROM orders WHERE o_orderstatus <> 'F'""",
)
_through(
    "kv_table_single_writes",
    stored.table_single_writes,
    """SELECT hex(encode(printf('n%03d', n_nationkey))) AS key_hex, hex(encode(n_name)) AS value_hex FROM nation WHERE n_regionkey <> 0""",
)
_through("kv_log_replay", stored.log_replay, _with(_OPS) + f"{_KV}, tombstone, seq FROM ops")
_through("kv_stored_run_scan", stored.stored_run_scan, _with(_SUPPLIERS) + f'{_KV}, tombstone, seq, "offset" FROM placed')
_through("kv_stored_run_index", stored.stored_run_index, _with(_SUPPLIERS) + 'SELECT hex(key) AS key_hex, "offset" FROM placed WHERE ordinal % 32 = 0')
_through(
    "kv_stored_log_replay",
    stored.stored_log_replay,
    _with(_SUPPLIERS) + f"{_KV}, tombstone, seq FROM placed WHERE ordinal < (SELECT max(ordinal) FROM placed)",
)
_through(
    "kv_stored_filter",
    stored.stored_filter,
    _with(_SUPPLIERS, "requests AS (SELECT key FROM records)", _HASHED, f"first AS {_murmur_sql(SEED_1)}", f"second AS {_murmur_sql(SEED_2)}")
    + """SELECT DISTINCT 4096 AS bits, 5 AS hashes, unnest(list_transform(range(0, 5),
  lambda i: (xor(a.z, a.z >> 16) + i * xor(b.z, b.z >> 16)) % 4096))::INT AS position FROM first a JOIN second b USING (key)""",
)
_through(
    "kv_stored_manifest",
    stored.stored_manifest,
    """SELECT printf('%03d.sst', r_regionkey) AS file, printf('%03d.bloom', r_regionkey) AS bloom, hex(encode(r_name)) AS min_key, '' AS max_key,
  row_number() OVER (ORDER BY r_regionkey) - 1 AS run_order, row_number() OVER (ORDER BY r_regionkey DESC) - 1 AS found_order FROM region""",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
