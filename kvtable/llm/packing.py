"""Best-fit packing of documents into fixed-length sequences, sum-of-squares rule.

A document's ids are its tokens and one end id.  Only documents longer than a
sequence are cut, into whole sequences and a last shorter piece.

Packing works on groups of about ``docs_per_group`` pieces by a hash of the
piece and its place, so that no task's work grows with the corpus and no id
or text is one group.  Within a group pieces come longest first; each goes to
the open sequence whose gap leaves the sum of the squared counts of open
sequences per gap smallest, ties to the least remaining gap.  A new sequence
opens only where no open one has room: as a candidate like the others it is
taken too often, which costs sequences (measured in the README).

A group so ends with some sequences that others could still fill.  These ends
are packed once more, whole, by the same rule, over groups of groups, until
all of them were in one or no more fit together.  What stays free on real
length distributions is in the README.

NULL texts pack as empty ones (just the end id); repeated rows are packed
each; an empty table has no pieces.  Result per piece: ``doc_id, piece,
start, length, ids_crc32, sequence_id, offset`` and, on request, ``ids``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvtable.llm.common import PieceCache, ceil_div, release, released, slices
from kvtable.llm.shared import written

DOCS_PER_GROUP = 8192
#: Sequences with a gap of at least a capacity's 1/ENDS are packed once more.
ENDS = 16
#: Most moved sequences (three numbers each) that are broadcast; beyond it the join shuffles.
MAX_BROADCAST_ROWS = 200_000
#: Entries of a generation of a worker's memo, about 150 bytes each.
CACHED_RUNS = 250_000


word = re.compile("[A-Za-zÀ-ÖØ-öø-\u012f\u0131-\u024f]+").fullmatch
plain = re.compile("[\0-\u012f\u0131-\u024f]*").fullmatch
one_word = re.compile("[a-zß-öø-ÿ]+").fullmatch


def _byte_symbols() -> dict[int, str]:
    """The printable symbol of each byte in byte-level vocabularies: itself, or the next one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


_symbols = _byte_symbols()


def byte_level(run: str) -> str:
    return run.encode().decode("latin-1").translate(_symbols)


class SpacedTokenizer:
    """Ids of a text by a tokenizer that drops white space: encodes each run between spaces once.

    Only the plain separators cut; they are white space to the tokenizer and
    no token spans them, so the runs' ids joined are the text's ids.  A run of
    Latin letters (below U+0250, where composing changes nothing and each letter
    but U+0130 lower-cases to one letter) is one word to it, apart from punctuation.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)

        model = tokenizer.model

        def ids(run: str) -> bytes:
            """Words in the tokenizer's normal form go to its model, their variants to their entry, all else to it whole."""
            if one_word(run):
                return np.array([t.id for t in model.tokenize(run if run.isascii() else byte_level(run))], "<u4").tobytes()
            if "<" not in run:  # no special token in it
                if run[-1:] in (".", ",") and word(run[:-1]):
                    return self.runs[run[:-1]] + self.runs[run[-1]]
                if word(run) and one_word(run.lower()):
                    return self.runs[run.lower()]
            return np.array(tokenizer.encode(run, add_special_tokens=False).ids, "<u4").tobytes()

        self.runs = PieceCache(ids, CACHED_RUNS)

    def forget(self) -> None:
        """Empties the memo, as an idle worker keeps its memory."""
        self.runs.clear()
        self.runs.old = {}

    def packed(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if "<|" not in text and (text.isascii() or plain(text)):
            text = text.lower()  # as the tokenizer does, but once for all runs
        return b"".join(map(self.runs.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> SpacedTokenizer:
    return SpacedTokenizer(path)


def _cut(tokenizer: SpacedTokenizer, texts: pa.Array, end: bytes, capacity: int, kind: pa.StructType, keep_ids: bool) -> pa.Array:
    offsets, lengths, crcs, ids = [0], [], [], []
    for text in texts.to_pylist():
        packed = tokenizer.packed(text or "") + end
        for at in range(0, len(packed), 4 * capacity):
            part = packed[at : at + 4 * capacity]
            lengths.append(len(part) // 4)
            crcs.append(zlib.crc32(part))
            if keep_ids:
                ids.append(np.frombuffer(part, "<i4"))
        offsets.append(len(lengths))
    columns = [pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())] + [pa.array(ids, pa.list_(pa.int32()))] * keep_ids
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(kind)))


def pieces_of(text: Column, tokenizer_path: str, capacity: int, end_id: int, keep_ids: bool = False) -> Column:
    """ARRAY of (length, ids_crc32[, ids]) of the text's pieces, in order."""
    kind = pa.struct([("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * keep_ids)
    end = np.array([end_id], "<u4").tobytes()

    @F.arrow_udf("array<struct<length:bigint,ids_crc32:bigint" + ",ids:array<int>" * keep_ids + ">>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = _tokenizer(tokenizer_path)
        try:
            for texts in slices(batches):
                yield _cut(tokenizer, texts, end, capacity, kind, keep_ids)
        finally:
            tokenizer.forget()
            release()

    return cut(text)


def sum_of_squares(lengths: Iterable[int], capacity: int) -> tuple[list[int], list[int]]:
    """Sequence (from 0) and offset of each piece, placed in the order given."""
    count = np.zeros(capacity + 1, np.int64)  # open sequences by gap
    open_at: dict[int, list[int]] = {}
    sequences, offsets, opened = [], [], 0
    for length in lengths:
        gaps = np.flatnonzero(count[length:])  # what would remain of each open gap with room
        if len(gaps):
            change = np.where(gaps == 0, 0, 2 * count[gaps] + 1) - 2 * count[gaps + length] + 1
            rest = int(gaps[change.argmin()])
            gap = rest + length
            sequence = open_at[gap].pop()
            count[gap] -= 1
        else:
            sequence, gap, rest = opened, capacity, capacity - length
            opened += 1
        if rest:
            open_at.setdefault(rest, []).append(sequence)
            count[rest] += 1
        sequences.append(sequence)
        offsets.append(capacity - gap)
    return sequences, offsets


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of one group each, from batches sorted by ``_group``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        groups = batch.column("_group").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1), len(groups)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[-1].column("_group")[0].as_py() != groups[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _placed(rows: DataFrame, capacity: int) -> DataFrame:
    """Adds ``sequence_id, offset, fill`` to rows with ``_group`` and ``length``; ``fill`` is what its sequence holds in all."""
    fields = [f for f in rows.schema.fields if f.name != "_group"]
    names = [f.name for f in fields]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches):
            lengths = group.column("length").to_numpy()
            order = np.argsort(-lengths, kind="stable")
            placed = np.empty((2, len(order)), np.int64)  # the rows themselves stay where they are
            placed[:, order] = sum_of_squares(lengths[order].tolist(), capacity)
            fills = np.bincount(placed[0], lengths).astype(np.int64)
            base = group.column("_group")[0].as_py() << 32
            out = group.select(names)
            for name, values in (("sequence_id", placed[0] + base), ("offset", placed[1]), ("fill", fills[placed[0]])):
                out = out.append_column(name, pa.array(values))
            yield from out.to_batches(max_chunksize=1_000)

    dealt = rows.repartition("_group").sortWithinPartitions("_group")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return dealt.mapInArrow(lambda batches: released(place(batches)), f"{schema}, sequence_id bigint, offset bigint, fill bigint")


def joined_ends(ends: DataFrame, capacity: int, per_group: int) -> DataFrame | None:
    """``sequence_id, to, shift``: sequences that go on within another one, from that place; ``ends`` holds ``sequence_id, fill``."""
    now, paths, moves = ends.select("sequence_id", "fill"), [], None

    def stored(df: DataFrame) -> DataFrame:
        df, path = written(df)
        paths.append(path)
        return df

    n = now.count()
    while n > 1:
        groups = ceil_div(n, per_group)
        number = F.pmod(F.xxhash64("sequence_id"), F.lit(groups))
        rows = now.select(F.col("sequence_id").alias("own"), F.col("fill").alias("length"), number.alias("_group"))
        step = stored(_placed(rows, capacity))
        heads = step.where("offset = 0").select("sequence_id", F.col("own").alias("to"), F.col("fill").alias("whole"))
        step = step.join(heads, "sequence_id").select(F.col("own").alias("sequence_id"), "to", F.col("offset").alias("shift"), "whole")
        own = step.select("sequence_id", "to", "shift")
        if moves is None:
            moves = stored(own)
        else:
            after = own.select(F.col("sequence_id").alias("to"), F.col("to").alias("_to"), F.col("shift").alias("_shift"))
            on = moves.join(after, "to", "left")
            moves = stored(on.select("sequence_id", F.coalesce("_to", "to").alias("to"), (F.col("shift") + F.coalesce("_shift", F.lit(0))).alias("shift")))
        now = stored(step.where((F.col("shift") == 0) & _is_end(F.col("whole"), capacity)).select("sequence_id", F.col("whole").alias("fill")))
        before, n = n, now.count()
        if groups == 1 or n > 0.9 * before:
            break
    return moves.where("shift > 0") if moves is not None else None


def _is_end(fill: Column, capacity: int) -> Column:
    return F.lit(capacity) - fill >= F.lit(max(1, capacity // ENDS))


def pack_pieces(pieces: DataFrame, capacity: int, n_groups: int, per_group: int = DOCS_PER_GROUP) -> DataFrame:
    """Adds ``sequence_id, offset`` to rows with ``doc_id, piece, length``; lengths are 1 to ``capacity``."""
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset", "fill", "_group")]
    number = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(n_groups))
    first, _ = written(_placed(pieces.select(*names, number.alias("_group")), capacity))
    moves = joined_ends(first.where((F.col("offset") == 0) & _is_end(F.col("fill"), capacity)), capacity, per_group)
    if moves is None:
        return first.drop("fill")
    few = moves.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    both = first.join(F.broadcast(moves) if few else moves, "sequence_id", "left")
    at = (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")
    return both.select(*names, F.coalesce("to", "sequence_id").alias("sequence_id"), at)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 4096,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    docs_per_group: int = DOCS_PER_GROUP,
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece; see the module's docstring."""
    n_groups = max(1, ceil_div(docs.count(), docs_per_group))
    cut = docs.select(
        F.col(id_col).alias("doc_id"),
        F.posexplode(pieces_of(F.col(text_col), tokenizer_path, capacity, end_id, keep_ids)).alias("piece", "_p"),
    )
    pieces = cut.select(
        "doc_id",
        "piece",
        (F.col("piece").cast("bigint") * capacity).alias("start"),
        F.col("_p.length").alias("length"),
        F.col("_p.ids_crc32").alias("ids_crc32"),
        *([F.col("_p.ids").alias("ids")] if keep_ids else []),
    )
    return pack_pieces(pieces, capacity, n_groups, docs_per_group)
