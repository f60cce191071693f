"""Document fingerprints: a Merkle tree over sections, paragraphs and spans.

Every character of a text is in exactly one leaf.  A paragraph is a line with
its line end; a long paragraph is cut into spans at sentence ends and every
``SPAN_CHARS`` characters.  A section ends at a blank line or, in unbroken
text, at a paragraph whose digest falls into one of ``SECTION_MEAN`` classes,
so an edit moves section borders only near itself.  A node's digest covers
its children's digests; the root is the fingerprint.

Equal roots mean equal texts.  Two trees are compared from the top, in order:
equal sections are aligned whole; where sections differ, their paragraphs are
aligned between the same neighbours, then spans.  What is left is where the
texts were edited, and ``2 * shared / (both lengths)`` is their likeness (two
empty texts: 1).  Nodes that only changed places count as edited on one side
of the move.

NULL texts count as empty; an empty text has a tree without sections.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvtable.llm.common import in_slices, released
from kvtable.llm.shared import written

SPAN_CHARS = 16
SECTION_MEAN = 8

_spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

#: Columns of the edit report, their Spark and their Arrow types.
REPORT = [
    ("doc_id", "bigint", pa.int64()),
    ("n_chars", "bigint", pa.int64()),
    ("edited_sha256", "string", pa.string()),
    ("fingerprint", "string", pa.string()),
    ("edited_fingerprint", "string", pa.string()),
    ("near_edited", "double", pa.float64()),
    ("near_next", "double", pa.float64()),
    ("edited_at", "array<struct<start:bigint,end:bigint>>", _spans_type),
]

_paragraphs = re.compile(r"[^\n]*\n|[^\n]+").findall
_spans = re.compile(rf"[^.!?\n]{{1,{SPAN_CHARS}}}[.!?\n]* *|[.!?\n]+ *").findall


def _digest(kind: bytes, data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16, person=kind).digest()


@dataclass
class Node:
    digest: bytes
    size: int  # code points
    children: list[Node] | None  # None at a leaf


def _inner(kind: bytes, children: list[Node]) -> Node:
    return Node(_digest(kind, b"".join(c.digest for c in children)), sum(c.size for c in children), children)


def _paragraph(text: str) -> Node:
    spans = _spans(text)
    return _inner(b"paragraph", [Node(_digest(b"span", s.encode("utf-8", "surrogatepass")), len(s), None) for s in spans])


def tree(text: str | None) -> Node:
    sections, open_section = [], []
    for line in _paragraphs(text or ""):
        node = _paragraph(line)
        open_section.append(node)
        if not line.strip() or node.digest[0] % SECTION_MEAN == 0:
            sections.append(_inner(b"section", open_section))
            open_section = []
    if open_section:
        sections.append(_inner(b"section", open_section))
    return _inner(b"document", sections)


#: A node and its place: the code points before it.
Placed = tuple[Node, int]


def _children(nodes: list[Placed]) -> list[Placed]:
    out = []
    for node, at in nodes:
        for child in node.children or []:
            out.append((child, at))
            at += child.size
    return out


def _heaviest_chain(pairs: list[tuple[int, int]], sizes: list[int]) -> list[tuple[int, int]]:
    """Of pairs ascending in the first place, those ascending in both whose sizes add up to the most (ties: the earliest)."""
    places = {j: k for k, j in enumerate(sorted(j for _, j in pairs), 1)}
    best: list[tuple[int, int]] = [(0, 1)] * (len(pairs) + 1)  # prefix maxima in a binary indexed tree: (size, -pair)
    before, weights = [], []
    for n, ((_, j), size) in enumerate(zip(pairs, sizes, strict=True)):
        top, k = (0, 1), places[j] - 1
        while k:
            top = max(top, best[k])
            k &= k - 1
        weight = top[0] + size
        before.append(-top[1])
        weights.append(weight)
        k = places[j]
        while k <= len(pairs):
            best[k] = max(best[k], (weight, -n))
            k += k & -k
    chain, n = [], max(range(len(pairs)), key=lambda n: (weights[n], -n), default=-1)
    while n >= 0:
        chain.append(pairs[n])
        n = before[n]
    return chain[::-1]


def _aligned(ours: list[Placed], theirs: list[Placed]) -> list[tuple[int, int]]:
    """Places of nodes with equal digests, ascending on both sides: equal beginnings and ends, and between them the
    heaviest chain of pairs of the k-th occurrence of a digest here with the k-th there."""
    a, b = [n.digest for n, _ in ours], [n.digest for n, _ in theirs]
    start, end = 0, 0
    short = min(len(a), len(b))
    while start < short and a[start] == b[start]:
        start += 1
    while end < short - start and a[-1 - end] == b[-1 - end]:
        end += 1
    where = defaultdict(list)
    for j in range(len(b) - end - 1, start - 1, -1):
        where[b[j]].append(j)
    pairs = [(i, where[a[i]].pop()) for i in range(start, len(a) - end) if where.get(a[i])]
    middle = _heaviest_chain(pairs, [ours[i][0].size for i, _ in pairs])
    return [(i, i) for i in range(start)] + middle + [(len(a) - k, len(b) - k) for k in range(end, 0, -1)]


def _stretches(nodes: list[Placed]) -> list[tuple[int, int]]:
    """From where to where the nodes reach, neighbours joined."""
    out: list[tuple[int, int]] = []
    for node, at in sorted(nodes, key=lambda x: x[1]):
        if out and out[-1][1] == at:
            out[-1] = (out[-1][0], at + node.size)
        elif node.size:
            out.append((at, at + node.size))
    return out


def compare(a: Node, b: Node) -> tuple[float, list[tuple[int, int]], list[tuple[int, int]]]:
    """Likeness from 0 to 1, and the stretches (in code points) of either text that the other lacks at that place."""
    if a.digest == b.digest:
        return 1.0, [], []
    shared, gaps = 0, [(_children([(a, 0)]), _children([(b, 0)]))]
    left: list[Placed] = []
    right: list[Placed] = []
    for level in range(3):
        below = []
        for ours, theirs in gaps:
            pairs = _aligned(ours, theirs)
            shared += sum(ours[i][0].size for i, _ in pairs)
            i0 = j0 = 0
            for i, j in [*pairs, (len(ours), len(theirs))]:
                mine, other = ours[i0:i], theirs[j0:j]
                i0, j0 = i + 1, j + 1
                if mine and other and level < 2:
                    below.append((_children(mine), _children(other)))
                else:
                    left += mine
                    right += other
        gaps = below
    return 2.0 * shared / (a.size + b.size), _stretches(left), _stretches(right)


def edited_text(text: str, following: str) -> str:
    """The last third replaced by as many first characters of the following text (or all of it)."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """All columns of ``docs`` and ``out``, the root digest in hex; a column of that name is replaced."""

    @F.arrow_udf("string")
    def roots(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in released(batches):
            yield pa.array([tree(t).digest.hex() for t in in_slices(texts)], pa.string())

    return docs.withColumn(out, roots(F.col(text_col)))


def _line(doc_id: int | None, text: str, own: Node, following: str, following_tree: Node) -> tuple:
    edited = edited_text(text, following)
    other = tree(edited)
    near, at, _ = compare(own, other)
    return (
        doc_id,
        len(text),
        hashlib.sha256(edited.encode()).hexdigest(),
        own.digest.hex(),
        other.digest.hex(),
        near,
        compare(own, following_tree)[0],
        [{"start": a, "end": b} for a, b in at],
    )


_ENDS = [("_place", "int", pa.int32()), ("_first", "boolean", pa.bool_()), ("_text", "string", pa.string())]


def _batch(lines: list[tuple], columns: list[tuple]) -> pa.RecordBatch:
    arrays = [pa.array(c, kind) for c, (_, _, kind) in zip(zip(*lines, strict=True), columns, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _, _ in columns])


def _ddl(columns: list[tuple]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind, _ in columns)


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text against its edited form and against the next document's text.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, edited_at``, the last being the stretches of the
    text that its edited form lacks, by the differing branches.  The next
    document is the one of the next smaller doc_id; after the last comes the
    first.  Rows that repeat an id follow each other in the order of their
    texts' hashes.  Rows without an id each count as a last one; if no row has
    an id, each is its own next.

    Rows go once, with their texts, to ranges of the order and are sorted
    there; ranges are cut by id, hash and place, so rows that repeat an id or
    are equal are no single range.  A task streams over its rows and holds two
    texts.  It passes on the first and the last row of its range, which meet
    those of the neighbouring ranges afterwards.  Of rows without an id only
    the first document's text is needed, which goes to all tasks.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = given.where("doc_id IS NOT NULL").select("*", F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_n"))
    columns = REPORT + _ENDS

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = TaskContext.get().partitionId(), None
        end = lambda row, first: (row[0], *[None] * (len(REPORT) - 1), place, first, row[1])
        for batch in released(batches):
            out = []
            for i, text in zip(*(in_slices(batch.column(c)) for c in ("doc_id", "text")), strict=True):
                row = (i, text, tree(text))
                out.append((*_line(*held, *row[1:]), None, None, None) if held else end(row, True))
                held = row
            if out:
                yield _batch(out, columns)
        if held:
            yield _batch([end(held, False)], columns)

    order = (F.col("doc_id").desc(), "_h", "_n")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    found, _ = written(dealt.mapInArrow(compared, _ddl(columns)))
    names = [name for name, _, _ in REPORT]
    places = sorted(r[0] for r in found.where("_first").select("_place").collect())  # one per range

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            cells = zip(*(in_slices(batch.column(c)) for c in ("doc_id", "text", "next")), strict=True)
            if out := [_line(i, text, tree(text), following, tree(following)) for i, text, following in cells]:
                yield _batch(out, REPORT)

    after = spark.createDataFrame([(p, places[(k + 1) % len(places)]) for k, p in enumerate(places)], "_place int, _next int")
    firsts = found.where("_first").select(F.col("_place").alias("_next"), F.col("_text").alias("next"))
    lasts = found.where("NOT _first").select("doc_id", "_place", F.col("_text").alias("text"))
    closing = lasts.join(after, "_place").join(firsts, "_next").select("doc_id", "text", "next")
    report = found.where("_first IS NULL").select(names).union(closing.mapInArrow(closed, _ddl(REPORT)))

    loose = given.where("doc_id IS NULL")
    if loose.isEmpty():
        return report
    first = found.where(F.col("_first") & (F.col("_place") == places[0])).select("_text").first()[0] if places else None
    sent = spark.sparkContext.broadcast(first)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        following = sent.value
        root = tree(following) if following is not None else None
        for batch in released(batches):
            out = []
            for text in in_slices(batch.column("text")):
                own = tree(text)
                out.append(_line(None, text, own, text, own) if root is None else _line(None, text, own, following, root))
            if out:
                yield _batch(out, REPORT)

    return report.union(loose.select("text").mapInArrow(alone, _ddl(REPORT)))
