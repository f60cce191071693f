"""SimHash near-duplicate detection with covering locality-sensitive hashing.

A text is lower-cased (A-Z), cut into words ``[^\\x20\\x09-\\x0D]+`` and
word shingles, repeats included; a fingerprint bit is 1 if it is set in over
half of the shingles' XXH64 hashes.  Texts of fewer words than a shingle have
their whole sequence as the only one; texts without words have fingerprint 0
and are linked like any other.

For a radius r every bit position is given a non-zero vector of r + 1 bits.
The mask of a vector v keeps the positions whose vector has an odd product
with v.  Up to r differing positions leave some v orthogonal to all of them,
so any two fingerprints within the radius agree under at least one of the
2^(r+1) - 1 masks: no pair is missed.  The search runs on distinct
fingerprints (copies are one row).  In a bucket the links are verified by
their Hamming distance, by a search that reports a spanning forest, never all
pairs; a bucket beyond ``BUCKET`` rows is cut into parts, and each pair of
parts is searched by a task of its own.

NULL texts count as empty; repeated rows share a component; rows without an
id take part, and a component's id is its smallest non-NULL one.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvtable.llm.common import in_slices, released
from kvtable.llm.components import components
from kvtable.llm.shared import removed, written

BITS = 64
SEED = 42
BUCKET = 2048
#: Rows of one fingerprint from which it is no key of a shuffle.
OFTEN = 5_000
#: Most oversized buckets or frequent fingerprints (two numbers each) that are broadcast; beyond it the join shuffles.
MAX_BROADCAST_ROWS = 500_000
#: Groups up to this size are first tested together, so many rows at a time.
SMALL, SEARCHED = 64, 10_000
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16

_lower = bytes(range(256)).lower()


def shingle_hashes(text: str | None, n: int) -> list[int]:
    words = (text or "").encode().translate(_lower).split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= n:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes) + np.arange(len(words))
    starts = (ends - sizes).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[n - 1 :].tolist(), strict=False)]


def simhash(text: str | None, n: int) -> int:
    hashes = shingle_hashes(text, n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = np.array(hashes[at : at + CHUNK], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, text_col: str = "text", out: str = "fp") -> DataFrame:
    """All columns of ``docs`` and ``out``, the fingerprint as a signed BIGINT; a column of that name is replaced."""

    @F.arrow_udf("bigint")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in released(batches):
            found = np.array([simhash(t, shingle) for t in in_slices(texts)], np.uint64)
            yield pa.array(found.view(np.int64))

    return docs.withColumn(out, hashed(F.col(text_col)))


def covering_masks(radius: int, parts: int = 1, bits: int = BITS) -> list[int]:
    """Masks such that each two fingerprints within the radius agree under one of them.

    With more parts the bits are divided; a pair within the radius is within
    ``radius // parts`` in some part, which has its own covering masks.  That
    takes fewer tables for a large radius, and keys of fewer bits.
    """
    if radius < 0 or parts < 1 or bits % parts:
        raise ValueError("the radius must not be negative and the parts must divide the bits")
    width, near = bits // parts, radius // parts
    n = (1 << (near + 1)) - 1
    rng = random.Random(7)
    vectors: list[int] = []
    while len(vectors) < width:
        vectors += rng.sample(range(1, n + 1), n)
    masks = [sum(1 << i for i in range(width) if (vectors[i] & v).bit_count() % 2) for v in range(1, n + 1)]
    return [m << (width * p) for p in range(parts) for m in masks]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _spanning(found: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a spanning forest of the fingerprints within the radius of each other."""
    rest = np.unique(found)
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            node = front.pop()
            near = np.bitwise_count(rest ^ node) <= radius
            if near.any():
                hits, rest = rest[near], rest[~near]
                yield np.full(len(hits), node), hits
                front.extend(hits)


def _linked(fp: np.ndarray, sizes: np.ndarray, radius: int) -> np.ndarray:
    """Which groups (of neighbouring rows) need a search: the large ones, and small ones with a link."""
    group = np.repeat(np.arange(len(sizes)), sizes)
    flags = sizes > SMALL
    rows = ~flags[group]
    fp, group = fp[rows], group[rows]
    for d in range(1, SMALL):
        same = group[d:] == group[:-d]
        if not same.any():
            break
        near = same & (np.bitwise_count(fp[d:] ^ fp[:-d]) <= radius)
        flags[group[d:][near]] = True
    return np.flatnonzero(flags)


def _forests(groups: Iterator[pa.Table], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of a spanning forest of each group."""

    def search(fp: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        pairs = [x for g in _linked(fp, sizes, radius) for x in _spanning(fp[cuts[g] : cuts[g + 1]], radius)]
        ends = [np.concatenate(x).view(np.int64) for x in zip(*pairs, strict=True)] or [np.zeros(0, np.int64)] * 2
        return pa.RecordBatch.from_arrays([pa.array(x) for x in ends], names=["a", "b"])

    held: list[np.ndarray] = []
    n_held = 0
    for group in groups:
        held.append(group.column("fp").to_numpy().view(np.uint64))
        n_held += len(held[-1])
        if n_held >= SEARCHED:
            yield search(np.concatenate(held), np.array(list(map(len, held))))
            held, n_held = [], 0
    if held:
        yield search(np.concatenate(held), np.array(list(map(len, held))))


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one ``key, p, q`` each, from rows sorted by them; most groups of a single row are left out."""
    held: list[pa.RecordBatch] = []  # of the last group so far
    last = None
    for rows in batches:
        if not rows.num_rows:
            continue
        key, p, q = (rows.column(c).to_numpy() for c in ("key", "p", "q"))
        new = (np.diff(key) != 0) | (np.diff(p) != 0) | (np.diff(q) != 0)
        cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [rows.num_rows]])
        wanted = np.diff(cuts) > 1
        wanted[[0, -1]] = True  # these may go on in another batch
        for a, b in zip(cuts[:-1][wanted].tolist(), cuts[1:][wanted].tolist(), strict=True):
            if held and last != (key[a], p[a], q[a]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(rows.slice(a, b - a))
            last = (key[a], p[a], q[a])
    if held:
        yield pa.Table.from_batches(held)


def dealt_groups(keyed: DataFrame, search: Callable, result: str, weight: Column | None = None) -> DataFrame:
    """``search`` over the rows of each ``key``; keys with one row only are left out.

    Rows of a key beyond ``BUCKET`` rows are cut into parts, and each pair of
    parts is a group of its own, so that no task holds them all.  With a
    ``weight``, a row counts for so many, but for one at least.
    """
    size = F.count(F.lit(1)) if weight is None else F.sum(F.greatest(weight, F.lit(1.0)))
    counts = keyed.groupBy("key").agg(size.alias("n")).where(F.col("n") > BUCKET)
    large, path = written(counts.select("key", F.ceil(F.col("n") / BUCKET).cast("int").alias("_parts")))
    n_large = large.limit(MAX_BROADCAST_ROWS + 1).count()
    rest = [c for c in keyed.columns if c != "key"]
    if n_large:
        members = keyed.join(F.broadcast(large) if n_large <= MAX_BROADCAST_ROWS else large, "key", "left")
        parts = F.coalesce("_parts", F.lit(1))
        members = members.select("key", *rest, parts.alias("_parts"), F.pmod(F.xxhash64(*rest), parts).cast("int").alias("own"))
        spread = members.select("key", *rest, "own", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("other"))
        groups = spread.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), *rest)
    else:
        removed(keyed.sparkSession, path)
        groups = keyed.select("key", F.lit(0).alias("p"), F.lit(0).alias("q"), *rest)
    dealt = groups.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return released(search(group for group in _whole_groups(batches) if group.num_rows > 1))

    return dealt.mapInArrow(over, result)


def links(fps: DataFrame, radius: int, parts: int = 1) -> DataFrame:
    """``a, b``: links that connect all fingerprints within the radius; ``fps`` holds distinct ``fp``."""
    table = F.array(*[F.lit(_signed(m)) for m in covering_masks(radius, parts)])
    keyed = fps.select("fp", F.posexplode(table).alias("t", "mask"))
    keyed = keyed.select(F.xxhash64("t", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp")
    return dealt_groups(keyed, lambda groups: _forests(groups, radius), "a bigint, b bigint").distinct()


def clusters(rows: DataFrame, radius: int, parts: int = 1, id_col: str = "doc_id", fp_col: str = "fp") -> DataFrame:
    """``fp, component, component_id`` of each distinct fingerprint.

    ``component`` is the smallest fingerprint reachable over links,
    ``component_id`` the smallest non-NULL id of its rows.
    """
    fps = rows.groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("_least"))
    fps, _ = written(fps)
    found = components(links(fps.select("fp"), radius, parts))
    named = fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "_least", F.coalesce("component", "fp").alias("component")
    )
    least = named.groupBy("component").agg(F.min("_least").alias("component_id"))
    return named.join(least, "component").select("fp", "component", "component_id")


def hex_of(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(docs: DataFrame, shingle: int, radius: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row.

    Fingerprints of more than ``OFTEN`` rows, as copies or empty texts have, meet their component in a broadcast.
    """
    rows = fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), shingle)
    rows, _ = written(rows.select("doc_id", "fp"))
    found = clusters(rows, radius).select("fp", "component_id")
    often = rows.groupBy("fp").count().where(F.col("count") > OFTEN).select("fp")
    hot, path = written(found.join(often, "fp").withColumn("_hot", F.lit(True)))
    if 0 < hot.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        both = rows.join(F.broadcast(hot), "fp", "left")
        rest = both.where("_hot IS NULL").select("doc_id", "fp").join(found, "fp")
        placed = both.where("_hot").select("fp", "doc_id", "component_id").union(rest)
    else:
        removed(rows.sparkSession, path)
        placed = rows.join(found, "fp")
    return placed.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")
