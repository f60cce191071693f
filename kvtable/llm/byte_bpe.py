"""Byte-level BPE encoding and decoding by tree reduction.

Encodings of neighbouring texts form a monoid: an element is a text with its
encoding, and the product of two elements is the encoding of the joined
text.  The product touches only a window around the seam.

* Text level.  The split pattern never looks behind, so the matches from any
  true match boundary on depend only on the text from there.  A match of the
  left text that ends at least ``LOOKAHEAD`` characters before the seam was
  decided without seeing the seam; the matches of a window that starts there
  are the true ones, and as soon as one of them ends where a match of the
  right text ends, all later matches of the right text are true as well.
* Piece level (within one match).  A token sequence is the BPE encoding of
  its bytes exactly if each pair of neighbouring tokens is the encoding of
  the pair's bytes.  Two halves are joined by re-encoding a window of tokens
  around the seam; if the pairs at both window edges are stable, everything
  outside is, else the window doubles.

Decoding maps ids to bytes and concatenates up the same kind of tree.
NULL texts encode as the empty text (no ids); the empty id list and NULL
decode to empty bytes; an id outside the vocabulary raises.  Long texts are
cut into leaves, so no step is quadratic in the text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvtable.llm.common import PieceCache, released, slices

#: Characters past a match's end that the split pattern can look at, plus one.
LOOKAHEAD = 3
LEAF_CHARS = 8192
LEAF_BYTES = 48
LEAF_IDS = 4096


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.findall = regex.compile(pattern).findall
        self.stable_pairs = PieceCache(self._is_stable)
        self.packed = PieceCache(lambda piece: np.array(self.encode_piece(piece.encode()), "<i4").tobytes())

    # --- one match -------------------------------------------------------

    def merge(self, data: bytes) -> list[int]:
        """Plain BPE: join the leftmost pair of lowest rank until none is left."""
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        joined = [ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while joined:
            best = min((r for r in joined if r is not None), default=None)
            if best is None:
                break
            i = joined.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del joined[i]
            if i < len(joined):
                joined[i] = ranks.get(parts[i] + parts[i + 1])
            if i:
                joined[i - 1] = ranks.get(parts[i - 1] + parts[i])
        return [ranks[p] for p in parts]

    def _is_stable(self, pair: tuple[int, int]) -> bool:
        return self.merge(self.tokens[pair[0]] + self.tokens[pair[1]]) == [*pair]

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """The product of two encodings of neighbouring byte strings."""
        width = 4
        while left and right:
            a, b = max(0, len(left) - width), min(len(right), width)
            middle = self.merge(b"".join(self.tokens[t] for t in left[a:] + right[:b]))
            if (a == 0 or self.stable_pairs[left[a - 1], middle[0]]) and (
                b == len(right) or self.stable_pairs[middle[-1], right[b]]
            ):
                return left[:a] + middle + right[b:]
            width *= 2
        return left or right

    def encode_bytes(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            return self.merge(data)
        half = len(data) // 2
        return self.join_tokens(self.encode_bytes(data[:half]), self.encode_bytes(data[half:]))

    def encode_piece(self, data: bytes) -> list[int]:
        """A match that is a token as a whole is that token; the rest is merged."""
        rank = self.ranks.get(data)
        return self.encode_bytes(data) if rank is None else [rank]

    # --- a text as matches -----------------------------------------------

    def join_pieces(self, left: list[str], right: list[str]) -> list[str]:
        """The product of two splits of neighbouring texts."""
        if not left or not right:
            return left or right
        keep, tail = len(left), 0
        while keep and tail < LOOKAHEAD:
            keep -= 1
            tail += len(left[keep])
        seam = "".join(left[keep:])
        taken = 1
        while True:
            taken = min(2 * taken, len(right))
            window = self.findall(seam + "".join(right[:taken]))
            size = tail + sum(map(len, right[:taken]))
            ends, at = {}, tail  # ends of the right text's matches, by place
            for i, piece in enumerate(right[:taken]):
                at += len(piece)
                ends[at] = i + 1
            at = 0
            for i, piece in enumerate(window):
                at += len(piece)
                if taken < len(right) and at > size - LOOKAHEAD:
                    break
                if at in ends:
                    return left[:keep] + window[: i + 1] + right[ends[at] :]

    def split(self, text: str) -> list[str]:
        if len(text) <= LEAF_CHARS:
            return self.findall(text)
        half = len(text) // 2
        return self.join_pieces(self.split(text[:half]), self.split(text[half:]))

    def encode_packed(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        return b"".join(map(self.packed.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<i4").tolist()

    # --- back -------------------------------------------------------------

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            if ids and min(ids) < 0:
                raise ValueError("negative token id")
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> ByteBpe:
    return ByteBpe(read_ranks(ranks_path), pattern)


def _id_lists(packed: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(packed) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def encoded(text: Column, ranks_path: str, pattern: str) -> Column:
    """ARRAY<INT> of token ids."""

    @F.arrow_udf("array<int>")
    def encode_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = codec(ranks_path, pattern)
        for texts in slices(released(batches)):
            yield _id_lists([bpe.encode_packed(t or "") for t in texts.to_pylist()])

    return encode_batches(text)


def decoded(ids: Column, ranks_path: str, pattern: str) -> Column:
    """BINARY: the bytes that the ids stand for."""

    @F.arrow_udf("binary")
    def decode_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = codec(ranks_path, pattern)
        for lists in slices(released(batches)):
            values = lists.values.to_numpy(zero_copy_only=False)
            at = lists.offsets.to_numpy()
            found = [bpe.decode(values[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.array(found, pa.binary())

    return decode_batches(F.coalesce(ids, F.array().cast("array<int>")))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """All columns of ``docs`` and ``out``; a column of that name is replaced."""
    return docs.withColumn(out, encoded(F.col(text_col), ranks_path, pattern))


def decode(docs: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of ``docs`` and ``out``; a column of that name is replaced."""
    return docs.withColumn(out, decoded(F.col(ids_col), ranks_path, pattern))
