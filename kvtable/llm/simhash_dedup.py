"""SimHash near-dedup by similarity: wide fingerprints find the candidates, the shingle sets decide.

A text's set holds the XXH64 hashes of its distinct word shingles; texts with
equal sets are one node.  At a Jaccard similarity s the sets' cosine is
``2s / (1 + s)``, so a SimHash bit differs with probability
``acos(2s / (1 + s)) / pi`` (0.15 at 0.8).  64 bits are too few to tell 0.8
from 0.6, hence the fingerprint is as wide as the search needs.

It is cut by covering masks into ``tables`` disjoint parts of ``key_bits``
bits: pairs that differ in fewer bits than there are parts agree in a part for
certain, pairs at the similarity with a probability of ``RECALL`` or more.
``key_bits`` grows with the logarithm of the corpus, so a bucket of unrelated
texts keeps its size, and the tables grow with a power of about 0.24 of it.

1. Per bucket, nodes that have another one within the reach of 128 bits.
2. Per bucket of such nodes, the forest of nearest pairs by the whole
   fingerprint.  Each pair is verified on the sets; links give components.
3. Per bucket, all pairs within reach that still lie in different components
   are verified too, so that no link between candidates is lost.  The sets of
   such nodes come to the bucket, and only links leave it: the pairs are not
   rows.  Each is tested in one bucket, of all that hold it.

No pair is a link before its sets are compared.  NULL texts and texts without
words have the empty set and are copies of each other; repeated rows and rows
without an id take part.  A bucket beyond ``simhash.BUCKET`` rows is searched
by pairs of parts, each a task of its own; nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvtable.llm.common import in_slices, released
from kvtable.llm.components import components
from kvtable.llm.shared import removed, written
from kvtable.llm.simhash import BUCKET, MAX_BROADCAST_ROWS, SEED, covering_masks, dealt_groups, shingle_hashes

#: Probability with which a pair at the similarity itself agrees in some table.
RECALL = 0.99
#: Standard deviations beyond the expected distance that still count as within reach.
REACH = 4.5
LEAST_BITS, FILTER_BITS = 1024, 128
#: Rows that share a key by chance, at most, on average.
BUCKET_ROWS = 64
#: A key holds its table's number above this many bits.
TABLE_SHIFT = 40
#: Shingles of a bucket, beyond which it is searched by pairs of parts when the sets are in it.
SHINGLES = 2_000_000
#: Shingles whose bits are counted at a time, in one byte each.
CHUNK = 255


def flip_rate(similarity: float) -> float:
    """Probability that a fingerprint bit of two sets of this Jaccard similarity differs."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def shape(n_rows: int, similarity: float) -> tuple[int, int, int]:
    """``key_bits, tables`` and the words of 64 bits of a fingerprint, for a corpus of this size."""
    key_bits = max(8, math.ceil(math.log2(max(2, n_rows) / BUCKET_ROWS)))
    tables = math.ceil(math.log(1 - RECALL) / math.log1p(-((1 - flip_rate(similarity)) ** key_bits)))
    return key_bits, tables, math.ceil(max(LEAST_BITS, key_bits * tables) / 64)


def reach(bits: int, similarity: float) -> int:
    """The distance in ``bits`` bits that pairs of the similarity do not exceed, but for 3 in a million."""
    p = flip_rate(similarity)
    return math.ceil(p * bits + REACH * math.sqrt(p * (1 - p) * bits))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The hashes of the text's distinct shingles, ascending."""
    return np.unique(np.array(shingle_hashes(text, n), "<u8"))


def node_of(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def _factors(words: int) -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 63, words, np.uint64) * np.uint64(2) + np.uint64(1)


def wide_fingerprint(found: np.ndarray, factors: np.ndarray) -> bytes:
    """A bit is 1 if it is set in over half of the set's hashes, each spread over the words by a factor and a mix."""
    counts = np.zeros(64 * len(factors), np.int64)
    for at in range(0, len(found), CHUNK):
        spread = found[at : at + CHUNK, None] * factors
        spread ^= spread >> np.uint64(32)
        spread *= np.uint64(0xD6E8FEB86659FD93)
        spread ^= spread >> np.uint64(32)
        bits = np.unpackbits(spread.astype("<u8").view(np.uint8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(found), bitorder="little").tobytes()


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def described(docs: DataFrame, shingle: int, words: int, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``_set``: STRUCT of node, n (size of the set) and fp (BINARY)."""

    @F.arrow_udf("struct<node:bigint,n:int,fp:binary>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        factors = _factors(words)
        for texts in released(batches):
            nodes, sizes, fps = [], [], []
            for text in in_slices(texts):
                found = shingle_set(text, shingle)
                nodes.append(node_of(found))
                sizes.append(len(found))
                fps.append(wide_fingerprint(found, factors))
            columns = [pa.array(_signed(nodes)), pa.array(sizes, pa.int32()), pa.array(fps, pa.binary())]
            yield pa.StructArray.from_arrays(columns, names=["node", "n", "fp"])

    return docs.withColumn("_set", of(F.col(text_col)))


def _matrix(fps: pa.Array) -> np.ndarray:
    """One row of 64-bit words per fingerprint."""
    return np.frombuffer(b"".join(fps.to_pylist()), "<u8").reshape(len(fps), -1)


def table_keys(fps: np.ndarray, key_bits: int, tables: int) -> np.ndarray:
    """The key of each fingerprint in each table: its bits under the table's mask, and the table's number above them."""
    masks = covering_masks(tables - 1, tables, key_bits * tables)
    shifts = [(m & -m).bit_length() - 1 for m in masks]
    bits = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little")
    powers = 1 << np.arange(key_bits, dtype=np.int64)
    return np.stack([(t << TABLE_SHIFT) + bits[:, at : at + key_bits] @ powers for t, at in enumerate(shifts)], axis=1)


def keyed(nodes: DataFrame, key_bits: int, tables: int) -> DataFrame:
    """``key, node, n, w0, w1`` of each table; the empty set is a node of its own and has no keys."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fps = _matrix(batch.column("fp"))
            keys = table_keys(fps, key_bits, tables)
            again = lambda x: pa.array(np.repeat(x, tables))
            w0, w1 = (np.ascontiguousarray(fps[:, i]).view(np.int64) for i in (0, 1))
            columns = [pa.array(keys.ravel()), *(again(batch.column(c).to_numpy()) for c in ("node", "n")), again(w0), again(w1)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "node", "n", "w0", "w1"])

    return nodes.where("n > 0").select("node", "n", "fp").mapInArrow(rows, "key bigint, node bigint, n int, w0 bigint, w1 bigint")


# --- searches of one bucket -----------------------------------------------------


def _sizes_reach(n: np.ndarray, m, similarity: float) -> np.ndarray:
    return np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9


def _blocks(n_rows: int, most: int = 1 << 20) -> Iterator[slice]:
    step = max(1, most // max(1, n_rows))
    for at in range(0, n_rows, step):
        yield slice(at, min(n_rows, at + step))


def _with_neighbour(group: dict[str, np.ndarray], limit: int, similarity: float) -> np.ndarray:
    """Which rows have another node of the group within the limit of their 128 bits."""
    w0, w1, n, node = (group[c] for c in ("w0", "w1", "n", "node"))
    found = np.zeros(len(n), bool)
    for b in _blocks(len(n)):
        near = np.bitwise_count(w0[b, None] ^ w0) + np.bitwise_count(w1[b, None] ^ w1) <= limit
        near &= node[b, None] != node
        at, other = np.nonzero(near)
        found[at[_sizes_reach(n[b][at], n[other], similarity)] + b.start] = True
    return found


def _distances(fps: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps ^ one).sum(axis=1, dtype=np.int32)


def _nearest_forest(group: dict[str, np.ndarray], limit: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The edges of a minimum spanning forest by distance, of those within the limit."""
    fps, n = group["fp"], group["n"]
    best, parent, done = np.full(len(n), limit + 1, np.int32), np.zeros(len(n), np.int64), np.zeros(len(n), bool)
    a, b, i = [], [], 0
    for _ in range(len(n)):
        done[i] = True
        d = _distances(fps, fps[i])
        nearer = (d < best) & ~done & _sizes_reach(n, n[i], similarity)
        best[nearer], parent[nearer] = d[nearer], i
        i = int(np.where(done, limit + 2, best).argmin())
        if not done[i] and best[i] <= limit:
            a.append(parent[i])
            b.append(i)
    return np.array(a, np.int64), np.array(b, np.int64)


def _across(group: dict[str, np.ndarray], near: int, limit: int, similarity: float, key_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within reach that lie in different components, each in the first table alone that both share a key of."""
    fps, n, c = (group[x] for x in ("fp", "n", "c"))
    table = int(group["key"][0]) >> TABLE_SHIFT
    a, b = [], []
    for i in range(len(n) - 1 if (c != c[0]).any() else 0):
        rest = np.flatnonzero((c[i + 1 :] != c[i]) & _sizes_reach(n[i + 1 :], n[i], similarity)) + i + 1
        differing = fps[rest] ^ fps[i]
        counts = np.bitwise_count(differing)
        within = (counts.sum(axis=1, dtype=np.int32) <= limit) & (counts[:, : FILTER_BITS // 64].sum(axis=1, dtype=np.int32) <= near)
        rest, differing = rest[within], differing[within]
        if table and len(rest):
            bits = np.unpackbits(differing.view(np.uint8), axis=1, bitorder="little", count=table * key_bits)
            rest = rest[bits.reshape(len(rest), table, key_bits).any(axis=2).all(axis=1)]
        a.append(np.full(len(rest), i))
        b.append(rest)
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= similarity * (len(a) + len(b) - common) - 1e-9


def _columns(rows: pa.Table) -> dict[str, np.ndarray]:
    out = {c: rows.column(c).to_numpy() for c in rows.column_names if c not in ("fp", "data")}
    for w in {"w0", "w1"} & set(out):
        out[w] = out[w].view(np.uint64)
    if "fp" in rows.column_names:
        out["fp"] = _matrix(rows.column("fp").combine_chunks())
    return out


def _pairs(groups: DataFrame, search: Callable) -> DataFrame:
    """``a, b`` (nodes, a < b), distinct, of the pairs that ``search`` finds in each group."""

    def found(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            group = _columns(table)
            i, j = search(group)
            x, y = group["node"][i], group["node"][j]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return dealt_groups(groups, found, "a bigint, b bigint").distinct()


# --- the plan ---------------------------------------------------------------------


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a, b`` whose sets (``node, data``) have the Jaccard similarity."""
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("data").alias("_a")), "a")
    met = met.join(sets.select(F.col("node").alias("b"), F.col("data").alias("_b")), "b")
    common = F.size(F.array_intersect("_a", "_b"))
    return met.where(common >= F.lit(similarity) * (F.size("_a") + F.size("_b") - common) - 1e-9).select("a", "b")


def _few(df: DataFrame) -> DataFrame:
    """For a broadcast, if the rows (a few numbers each) are few; counted."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else df


def _sets(texts: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """``node, data`` of the nodes of ``rows`` (``node, _k, _l``), from the text of one row of each."""

    @F.arrow_udf("array<bigint>")
    def listed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in released(batches):
            yield pa.array([shingle_set(t, shingle).view(np.int64) for t in in_slices(batch)], pa.list_(pa.int64()))

    found = texts.join(_few(rows), ["_k", "_l"]).select("node", listed("text").alias("data"))
    return found.dropDuplicates(["node"])


def links(nodes: DataFrame, sets_of: Callable, similarity: float, key_bits: int, tables: int, words: int) -> DataFrame:
    """``a, b``: links that connect all candidates of the similarity; ``nodes`` holds ``node, n, fp`` and more."""
    spark, paths = nodes.sparkSession, []

    def kept(df: DataFrame) -> DataFrame:
        df, path = written(df)
        paths.append(path)
        return df

    near, far = reach(FILTER_BITS, similarity), reach(64 * words, similarity)

    def members(groups: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        for table in groups:
            group = _columns(table)
            at = np.flatnonzero(_with_neighbour(group, near, similarity))
            yield pa.RecordBatch.from_arrays([pa.array(group[c][at]) for c in ("key", "node")], names=["key", "node"])

    close = kept(dealt_groups(keyed(nodes, key_bits, tables), members, "key bigint, node bigint").distinct())
    touched = kept(nodes.join(close.select("node").distinct(), "node"))
    sets = kept(sets_of(touched))
    groups = kept(close.join(touched.select("node", "n", "fp"), "node"))
    tested = _pairs(groups, lambda g: _nearest_forest(g, far, similarity))
    first = kept(verified(tested, sets, similarity))
    named = groups.join(components(first), "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    mixed = named.groupBy("key").agg(F.min("c").alias("_c"), F.max("c").alias("_d")).where("_c <> _d").select("key")
    apart = kept(named.join(mixed, "key", "left_semi"))

    def in_reach(groups: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        for table in groups:
            group = _columns(table)
            at = np.unique(np.concatenate(_across(group, near, far, similarity, key_bits)))
            yield pa.RecordBatch.from_arrays([pa.array(group[c][at]) for c in ("key", "node")], names=["key", "node"])

    def linked(groups: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        for table in groups:
            group, data = _columns(table), table.column("data").combine_chunks()
            ends, values = data.offsets.to_numpy(), data.values.to_numpy()
            of = [values[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            pairs = zip(*(x.tolist() for x in _across(group, near, far, similarity, key_bits)), strict=True)
            hits = [(group["node"][i], group["node"][j]) for i, j in pairs if _similar(of[i], of[j], similarity)]
            yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in hits], pa.int64()) for k in (0, 1)], names=["a", "b"])

    wanted = dealt_groups(apart, in_reach, "key bigint, node bigint").distinct()
    with_sets = kept(apart.join(wanted, ["key", "node"]).join(sets, "node"))
    rest = dealt_groups(with_sets, linked, "a bigint, b bigint", weight=F.col("n") * (BUCKET / SHINGLES)).distinct()
    second, _ = written(first.union(rest))
    for path in paths:
        removed(spark, path)
    return second


def deduplicated(docs: DataFrame, shingle: int, similarity: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (NULL last), then of the smallest text hash.

    Rows are told apart by two 64-bit hashes of id and text (rows equal in
    both are one); texts are shuffled once, to meet the rows that stay, and
    the texts of candidates a second time only if these are too many rows
    for a broadcast.
    """
    key_bits, tables, words = shape(docs.count(), similarity)
    text = F.coalesce(F.col(text_col), F.lit(""))
    same = [F.xxhash64(F.lit(i), F.col(id_col), F.col(id_col).isNull(), text, F.col(text_col).isNull()) for i in (1, 2)]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), same[0].alias("_k"), same[1].alias("_l"))
    meta = described(texts, shingle, words).select(
        F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "_k", "_l").alias("_o"), "_set.*"
    )
    nodes, path = written(meta.groupBy("node", "n", "fp").agg(F.min("_o").alias("_o")))
    rows = lambda touched: touched.select("node", "_o._k", "_o._l")
    linked = links(nodes, lambda touched: _sets(texts.select("text", "_k", "_l"), rows(touched), shingle), similarity, key_bits, tables, words)
    placed = nodes.select("node", "_o").join(components(linked), "node", "left")
    stays = placed.groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("_o").alias("_o"))
    given = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    own = docs.select(given.alias("_in"), same[0].alias("_k"), same[1].alias("_l"))
    kept = own.join(stays.select("_o._k", "_o._l"), ["_k", "_l"], "left_semi")
    return kept.dropDuplicates(["_k", "_l"]).select("_in.*")
