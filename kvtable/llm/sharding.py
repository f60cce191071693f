"""Hierarchical weighted hash tree: documents to region, rack and shard.

A document descends the tree; at each node every child draws
``-ln(u) / weight``, with ``u`` a hash of (document, child) in (0, 1], and
the least draw wins, so a child wins with the probability of its share of
the weight.  A draw depends on nothing but the document, the child's path
and the child's weight.  Hence, when weights change in one subtree, a node
outside keeps its draw: rows move only into a child whose weight rose or
out of one whose weight fell, and inside an unchanged subtree nothing moves.
A shard that joins as a region of its own (:func:`grown`) takes rows only
into itself.

NULL identifiers count as the empty identifier; NULL texts have no bytes.
Equal rows get the same shard and different slots.  Only DataFrame functions
are used, and no text is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of the row hash that spread a shard's rows over slot buckets: 16**3 buckets a shard.
BUCKET_DIGITS = 3
#: Equal rows that are told apart at a time.
COPIES = 4096


@dataclass(frozen=True)
class Tree:
    """``racks[path of a rack] = {shard: weight}``; a rack's path is ``region/rack``."""

    racks: dict[str, dict[int, float]]

    def children(self) -> dict[str, list[tuple[str, float]]]:
        """Path of each inner node to its children's paths and weights; the root is ``""``."""
        out: dict[str, list[tuple[str, float]]] = {"": []}
        regions: dict[str, float] = {}
        for rack, shards in sorted(self.racks.items()):
            region = rack.split("/")[0]
            weight = float(sum(shards.values()))
            out[rack] = [(f"{rack}/s{s}", float(w)) for s, w in sorted(shards.items()) if w > 0]
            if weight > 0:
                out.setdefault(region, []).append((rack, weight))
                regions[region] = regions.get(region, 0.0) + weight
        out[""] = sorted(regions.items())
        if not out[""]:
            raise ValueError("the tree has no shard with a positive weight")
        return {path: found for path, found in out.items() if found}


def uniform_tree(n_shards: int, racks_per_region: int = 3, shards_per_rack: int = 4) -> Tree:
    """Shards 0 to n-1 of weight 1, filled rack by rack and region by region."""
    if n_shards < 1:
        raise ValueError("at least one shard is needed")
    racks: dict[str, dict[int, float]] = {}
    for shard in range(n_shards):
        rack = shard // shards_per_rack
        racks.setdefault(f"r{rack // racks_per_region}/k{rack}", {})[shard] = 1.0
    return Tree(racks)


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, the next free number, in a region of its own.

    Only there does it take rows into itself alone.  In a rack that holds
    others it would raise the rack's weight, and rows that the rack wins would
    descend to the other shards too; add it to ``racks`` where that is wanted.
    """
    shard = 1 + max(s for shards in tree.racks.values() for s in shards)
    return Tree({**tree.racks, f"g{shard}/k{shard}": {shard: weight}})


def _key(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("string"), F.lit(""))


def _draw(key: Column, child: Column) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit("|"), child["path"])), 1, 13)
    u = (F.conv(digits, 16, 10).cast("bigint") + 1) / F.lit(float(16**13))
    return -F.log(u) / child["weight"]


def placed(key: Column, tree: Tree) -> Column:
    """Path of the shard that the key descends to."""
    nodes = tree.children()
    table = F.create_map(
        *[
            part
            for path, found in nodes.items()
            for part in (
                F.lit(path),
                F.array(*[F.struct(F.lit(p).alias("path"), F.lit(w).alias("weight")) for p, w in found]),
            )
        ]
    )
    path = F.lit("")
    for _ in ("region", "rack", "shard"):
        drawn = F.transform(
            F.element_at(table, path), lambda c: F.struct(_draw(key, c).alias("draw"), c["path"].alias("path"))
        )
        path = F.array_min(drawn)["path"]
    return path


def shard_number(path: Column) -> Column:
    return F.regexp_extract(path, r"/s(\d+)$", 1).cast("int")


def assign(docs: DataFrame, tree: Tree, id_col: str = "doc_id", out: str = "shard") -> DataFrame:
    """All columns of ``docs`` and ``out``; a map-only plan, fit for ``write.partitionBy``."""
    return docs.withColumn(out, shard_number(placed(_key(id_col), tree)))


def placement(docs: DataFrame, tree: Tree, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, path, shard, slot`` of each row.

    Slots are gapless from 0 in each shard, in the order of the row hash:
    rows are numbered within (shard, bucket), and a bucket starts where the
    counts of the buckets before it end.  No task sees a whole shard.  Equal
    rows, whose results differ in the slot alone, are counted before they are
    numbered and told apart again afterwards.
    """
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(data) + 8).cast("bigint").alias("size"),
        F.crc32(data).alias("text_crc32"),
        _key(id_col).alias("_key"),
    ).select(
        "doc_id",
        "size",
        "text_crc32",
        placed(F.col("_key"), tree).alias("path"),
        F.md5(F.concat("_key", F.lit("#"), F.col("text_crc32").cast("string"))).alias("_hash"),
    )
    rows = rows.select("*", shard_number(F.col("path")).alias("shard"), F.substring("_hash", 1, BUCKET_DIGITS).alias("_bucket"))
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_c"))
    counts = rows.groupBy("shard", "_bucket").agg(F.sum("_c").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    order = Window.partitionBy("shard", "_bucket").orderBy("_hash", "doc_id", "size", "text_crc32")
    numbered = rows.withColumn("_nth", F.coalesce(F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    names = ["doc_id", "size", "text_crc32", "path", "shard"]
    slot = (F.col("_start") + F.col("_nth")).cast("bigint").alias("_at")
    # equal rows again, in two steps: no array is longer than COPIES
    blocks = numbered.join(starts, ["shard", "_bucket"]).select(*names, slot, "_c", F.explode(F.sequence(F.lit(0), F.col("_c") - 1, F.lit(COPIES))).alias("_b"))
    last = F.least(F.col("_b") + F.lit(COPIES), F.col("_c")) - 1
    copies = blocks.select(*names, "_at", F.explode(F.sequence(F.col("_b"), last)).alias("_copy"))
    return copies.select(*names, (F.col("_at") + F.col("_copy")).cast("bigint").alias("slot"))


def _half_byte_table() -> list[int]:
    """CRC-32 of the 16 half bytes, from its polynomial."""
    table = []
    for n in range(16):
        for _ in range(4):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    return table


def _descent_sql(name: str, tree: Tree) -> str:
    children = ", ".join(f"('{parent}', '{path}', {weight!r})" for parent, found in tree.children().items() for path, weight in found)
    step = """SELECT * FROM (
    SELECT d.r, d.k, c.path, row_number() OVER (PARTITION BY d.r ORDER BY
      -ln((('0x' || substr(md5(d.k || '|' || c.path), 1, 13))::BIGINT + 1) / 4503599627370496.0::DOUBLE) / c.weight, c.path) AS n
    FROM {before} d JOIN {name}_nodes c ON c.parent = {path}) WHERE n = 1"""
    levels = [("keyed", "''"), (f"{name}_region", "d.path"), (f"{name}_rack", "d.path")]
    parts = [f"{name}_nodes(parent, path, weight) AS (VALUES {children})"]
    for (before, path), level in zip(levels, ("region", "rack", "shard"), strict=True):
        parts.append(f"{name}_{level} AS ({step.format(before=before, name=name, path=path)})")
    return ",\n".join(parts)


def oracle(tree: Tree) -> str:
    """Placement of ``documents`` in the tree and in the grown one, in DuckDB SQL."""
    table = _half_byte_table()
    half = lambda c, b: f"xor({c} >> 4, ({table}::BIGINT[])[(xor({c}, {b}) & 15) + 1])"
    # each byte gives its low and then its high half
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, halves), lambda c, b: {half('c', 'b')}), 4294967295::BIGINT)"
    return rf"""
WITH raw AS (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS t, coalesce(doc_id::VARCHAR, '') AS k FROM documents),
halved AS (
  SELECT r, doc_id, k, octet_length(t) + 8 AS size,
    list_transform(regexp_extract_all(regexp_replace(hex(t), '(.)(.)', '\2\1', 'g'), '.'), lambda x: ('0x' || x)::BIGINT) AS halves
  FROM raw),
keyed AS (SELECT r, doc_id, k, size, {crc} AS crc FROM halved),
{_descent_sql("base", tree)},
{_descent_sql("grown", grown(tree))},
placed AS (
  SELECT keyed.*, b.path, regexp_extract(b.path, '/s(\d+)$', 1)::INT AS shard, regexp_extract(g.path, '/s(\d+)$', 1)::INT AS grown_shard,
    md5(keyed.k || '#' || keyed.crc::VARCHAR) AS h
  FROM keyed JOIN base_shard b USING (r) JOIN grown_shard g USING (r))
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard, grown_shard, path,
  row_number() OVER (PARTITION BY shard ORDER BY h, doc_id, size, crc) - 1 AS slot
FROM placed
"""
