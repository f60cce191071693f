"""Suffix-array dedup: exact removal of repeated byte passages.

A byte goes if a string of ``span`` bytes covers it that also starts in a
document of smaller id.  Texts count as UTF-8; matches never cross documents
and are judged on the input.

Not every suffix has to travel.  Of the ``span - GRAM + 1`` grams in a window
of ``span`` bytes the one of least hash (leftmost on ties) is the window's
anchor; equal windows have equal anchors at equal places, so it suffices to
sort the suffixes that start at anchors, each with the few bytes before it
that windows of the anchor reach back to (its context).

1. Documents are dealt into runs of about ``run_bytes``.  A run sends its
   sorted anchor hashes, delta-coded, by hash range; the answer is a bit per
   hash: whether another document has it.  This drops nearly all clean text.
2. A run sorts the suffixes at its remaining anchors, keeps equal contexts
   once with their least document id, and sends them front-coded (length of
   the prefix shared with the one before, and the rest) by key range.  The
   ranges are cut at splitters, strings sampled evenly over the corpus' bytes.
3. Each key range merges its sorted runs with a loser tree that keeps, for
   every loser, the length of the prefix it shares with the winner.  A longer
   known prefix wins unseen; only on equal lengths are the parts beyond
   compared.  The merge so yields the common prefix of neighbours, and these
   decide: a window that begins ``p`` bytes before the anchor occurs in two
   contexts if all neighbours between them share ``span - p`` bytes or more
   and the ``p`` bytes before are equal.  Each window gets its least id.
   Anchors with more than ``hot`` different contexts are sent window by
   window instead, by the window's bytes, so that no group outgrows a task.
4. The answers go back to the runs, which mark and cut.

Texts are shuffled once: the three steps that need them share the exchange.
Steps 1 to 3 send a message per run and range that have something in common:
at most ``runs * ranges``, and never more than one per anchor.

NULL texts count as empty and come back NULL with nothing removed.  Rows that
repeat an id are the same document to each other.  Rows without an id count
as last: they lose what any row with an id has, and never take.  Texts
shorter than a span are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvtable.llm.common import ceil_div, releasing

SPAN = 50
#: Bytes of a gram, a multiple of 8, and an odd factor for each 8 of them.
GRAM = 24
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
RUN_BYTES = 4 << 20
#: Text per hash range of step 1 and per key range of step 3; the latter hold Python objects.
HASHED_BYTES, MERGED_BYTES = 8 << 20, 4 << 20
#: Strings that are sampled for the splitters; they go to the driver.
SAMPLES = 50_000
#: Different contexts, counted per run, from which an anchor's windows go separately.
HOT = 20_000
#: Window starts whose anchors are looked for at a time; the low bits of a key hold a place in it.
BLOCK_BITS = 16
MOST = 127
NO_ID = np.iinfo(np.int64).max


# --- anchors -----------------------------------------------------------------


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes at each place."""
    n = len(data) - GRAM + 1
    words = np.ascontiguousarray(np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)))
    total = words[:n] * np.uint64(ODD[0])
    for k in range(8, GRAM, 8):
        total += words[k : k + n] * np.uint64(ODD[k // 8])
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(32)
    return total


def _even(hashes: np.ndarray) -> np.ndarray:
    """Other numbers for the hashes, one to one: anchors have the least hashes around, so these crowd at the low end."""
    hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(ODD[4])
    return hashes ^ (hashes >> np.uint64(29))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def anchored(data: np.ndarray, ends: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All gram hashes, and the stretches of neighbouring windows with one anchor: first and last window start, anchor.

    ``data`` is the documents' bytes one after the other, ``ends`` where each ends.
    """
    n_windows = len(data) - span + 1
    if n_windows <= 0:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    valid = np.ones(n_windows, bool)
    for end in ends[:-1]:
        valid[max(0, end - span + 1) : end] = False
    width = span - GRAM + 1
    low = np.uint64((1 << BLOCK_BITS) - 1)
    grams = np.empty(len(data) - GRAM + 1, np.uint64)
    found = []
    step = (1 << BLOCK_BITS) - width
    for at in range(0, n_windows, step):
        size = min(step, n_windows - at)
        hashes = _gram_hashes(data[at : at + size + span - 1])
        grams[at : at + len(hashes)] = hashes
        keys = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        least = _sliding_min(keys, width)
        here = valid[at : at + size]
        turn = least[1:] != least[:-1]
        first = np.flatnonzero(here & np.concatenate([[True], turn | ~here[:-1]]))
        last = np.flatnonzero(here & np.concatenate([turn | ~here[1:], [True]]))
        found.append((first + at, last + at, (least[first] & low).astype(np.int64) + at))
    return grams, *(np.concatenate(x) for x in zip(*found, strict=True))


class Run:
    """The texts of one run and their anchors.

    Rows arrive in any order, another one each time they are read; they are
    taken in the order of id and text (``order``), so that each step finds
    the same stretches.
    """

    def __init__(self, ids: list, texts: list, span: int):
        self.span = span
        rows = sorted((NO_ID if i is None else i, t.encode() if t else b"", n) for n, (i, t) in enumerate(zip(ids, texts, strict=True)))
        encoded = [t for _, t, _ in rows]
        self.order = [n for _, _, n in rows]
        self.bytes = b"".join(encoded)
        self.ends = np.cumsum([len(t) for t in encoded], dtype=np.int64)
        self.ids = np.array([i for i, _, _ in rows], np.int64)
        self.grams, self.first, self.last, self.anchor = anchored(np.frombuffer(self.bytes, np.uint8), self.ends, span)
        self.hash = _even(self.grams[self.anchor])
        self.row = np.searchsorted(self.ends, self.first, side="right")
        self.unique = np.unique(self.hash)

    def _mixed(self, first: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """A hash of the bytes from ``first`` to the end of the window at ``last``, by grams that cover them."""
        end = last + (self.span - GRAM)
        total = (anchor - first).astype(np.uint64) * np.uint64(ODD[3]) + (last - first).astype(np.uint64)
        for at in range(0, self.span, GRAM):
            for place in (np.minimum(first + at, anchor), np.minimum(anchor + at, end)):
                total = (total ^ self.grams[place]) * np.uint64(ODD[0])
                total ^= total >> np.uint64(32)
        return (total ^ self.grams[end]) * np.uint64(ODD[1])

    def contexts(self, stretches: np.ndarray | slice = slice(None)) -> np.ndarray:
        """A hash of the context of each stretch."""
        return self._mixed(self.first[stretches], self.last[stretches], self.anchor[stretches])

    def windows(self, at: np.ndarray) -> np.ndarray:
        """A hash of each window."""
        return self._mixed(at, at, at)

    def same_bytes(self, order: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Whether contexts that follow each other in the order are equal byte by byte, with the anchor at the same place."""
        a, b = order[:-1], order[1:]
        equal = (anchor[a] - first[a] == anchor[b] - first[b]) & (last[a] - first[a] == last[b] - first[b])
        a, b, open_ones = first[a[equal]], first[b[equal]], np.flatnonzero(equal)
        size = (last - first)[order[:-1][equal]] + self.span
        if len(a):
            words = np.ascontiguousarray(np.ndarray((len(self.bytes) - 7,), "<u8", self.bytes, strides=(1,)))
            bad = np.zeros(len(a), bool)
            for at in range(0, int(size.max()), 8):
                place = np.minimum(at, size - 8)  # the last word may overlap the one before
                bad |= words[a + place] != words[b + place]
            equal[open_ones[bad]] = False
        return equal

    def marks(self) -> np.ndarray:
        """Of each unique hash the number of its contexts, up to MOST, plus MOST + 1 if two documents have it."""
        if not len(self.hash):
            return np.zeros(0, np.uint8)
        doc, shape = self.ids[self.row], self.contexts()
        order = np.lexsort((doc, self.hash))
        ordered, docs = self.hash[order], doc[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        starts = np.flatnonzero(new)
        many = np.logical_or.reduceat(~new & np.concatenate([[False], docs[1:] != docs[:-1]]), starts)
        by_shape = np.lexsort((shape, self.hash))
        changed = (np.diff(self.hash[by_shape]) != 0) | (np.diff(shape[by_shape]) != 0)
        counts = np.add.reduceat(np.concatenate([[1], changed]).astype(np.int64), starts)
        return (np.minimum(counts, MOST) + (MOST + 1) * many).astype(np.uint8)


def parts_of(hashes: np.ndarray, n_parts: int) -> np.ndarray:
    """Hash ranges of equal width, so the parts of sorted hashes are slices."""
    return ((hashes >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int64)


def _pack_sorted(values: np.ndarray) -> bytes:
    """Delta-coded: one byte for the width, then the low bytes of each difference."""
    deltas = np.diff(values, prepend=np.uint64(0))
    width = max(1, (int(deltas[1:].max()).bit_length() + 7) // 8 if len(deltas) > 1 else 1)
    return bytes([width]) + values[:1].astype("<u8").tobytes() + deltas[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack_sorted(blob: bytes) -> np.ndarray:
    width = blob[0]
    low = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, width)
    deltas = np.zeros((len(low), 8), np.uint8)
    deltas[:, :width] = low
    return np.cumsum(np.concatenate([np.frombuffer(blob, "<u8", 1, 1), deltas.view("<u8").ravel()]), dtype=np.uint64)


# --- contexts ----------------------------------------------------------------


class Entries:
    """A run's different contexts, by key range and then in the order of their hashes, and the places where they occur."""

    def __init__(self, run: Run, again: np.ndarray, hot: np.ndarray, splitters: list[bytes]):
        """``again`` and ``hot`` are flags of the run's unique hashes."""
        self.run = run
        index = np.searchsorted(run.unique, run.hash)
        plain = np.flatnonzero(again[index] & ~hot[index])
        single = np.flatnonzero(again[index] & hot[index])
        sizes = run.last[single] - run.first[single] + 1
        starts = np.repeat(run.first[single], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        first, last, anchor = (np.concatenate([x[plain], starts]) for x in (run.first, run.last, run.anchor))
        key = np.concatenate([run.hash[plain], run.windows(starts)])
        shape = np.concatenate([run.contexts(plain), np.zeros(len(starts), np.uint64)])
        row = np.concatenate([run.row[plain], np.repeat(run.row[single], sizes)])
        order = np.lexsort((shape, key))
        self.at, self.row = first[order], row[order]
        key, shape = key[order], shape[order]
        new = np.concatenate([[True], (np.diff(key) != 0) | (np.diff(shape) != 0)])[: len(key)]
        new[1:] |= ~run.same_bytes(order, first, last, anchor)
        found = np.flatnonzero(new)
        one = order[found]
        part = self._ranges(anchor[one], one >= len(plain), splitters)
        by_part = np.argsort(part, kind="stable")
        rank = np.empty(len(one), np.int64)
        rank[by_part] = np.arange(len(one))
        self.entry = rank[np.cumsum(new) - 1]  # of each place
        one = one[by_part]
        self.first, self.last, self.anchor = first[one], last[one], anchor[one]
        self.least = (np.minimum.reduceat(run.ids[self.row], found) if len(key) else np.zeros(0, np.int64))[by_part]
        self.cuts = np.searchsorted(part[by_part], np.arange(len(splitters) + 2)).tolist()

    def _ranges(self, anchor: np.ndarray, whole: np.ndarray, splitters: list[bytes]) -> np.ndarray:
        """The key range by the gram at the anchor, so that contexts of a gram meet; of single windows by all of their bytes."""
        out = np.zeros(len(anchor), np.int64)
        for rows, width in ((~whole, GRAM), (whole, self.run.span)):
            if rows.any() and splitters:
                data = np.frombuffer(self.run.bytes, np.uint8)
                strings = data[anchor[rows, None] + np.arange(width)].view(f"S{width}").ravel()
                out[rows] = np.searchsorted(np.array([x[:width] for x in splitters], f"S{width}"), strings, side="right")
        return out

    def coded(self, part: int) -> bytes:
        """The contexts of one part, sorted by the suffix at the anchor and front-coded.

        Prefix shared with the one before, sizes, least ids, the place in
        the order of hashes, the bytes before the anchors, and the rests.
        """
        span, data, at = self.run.span, self.run.bytes, self.cuts[part]
        columns = (x[at : self.cuts[part + 1]].tolist() for x in (self.first, self.last, self.anchor))
        entries = sorted((data[a : z + span], data[f:a], n) for n, (f, z, a) in enumerate(zip(*columns, strict=True)))
        shared, sizes, before, rests = bytearray(), bytearray(), bytearray(), []
        previous, size = 0, 0
        for suffix, left, _ in entries:
            key = int.from_bytes(suffix.ljust(span, b"\0"), "big")
            n = min(size, len(suffix), span - (((previous ^ key).bit_length() + 7) >> 3))  # keys are filled up with zero bytes
            previous, size = key, len(suffix)
            shared.append(n)
            sizes.append(size)
            before.append(len(left))
            rests.append(suffix[n:])
        places = np.array([n for _, _, n in entries], "<u4")
        lefts = b"".join(left for _, left, _ in entries)
        head = np.array([len(entries), len(lefts)], "<i8").tobytes()
        numbers = self.least[at + places.astype(np.int64)].astype("<i8").tobytes() + places.tobytes()
        return zstandard.compress(head + bytes(shared) + bytes(sizes) + bytes(before) + numbers + lefts + b"".join(rests), 3)

    def spans(self, answers: dict[int, bytes]) -> list[list[tuple[int, int]]]:
        """Step 4: of each row, in the order given, the maximal removed stretches, as byte offsets in its text."""
        run = self.run
        parts = [_answered(answers[p]) for p in range(len(self.cuts) - 1) if self.cuts[p] < self.cuts[p + 1]]
        out: list[list[tuple[int, int]]] = [[] for _ in run.order]
        if not parts:
            return out
        counts, lengths, least = (np.concatenate(x) for x in zip(*parts, strict=True))
        begins = np.cumsum(counts) - counts
        upto = np.cumsum(lengths) - lengths
        upto -= np.repeat(upto[begins], counts)  # windows of the entry before each stretch
        n = counts[self.entry]
        stretch = np.repeat(begins[self.entry] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        gone = least[stretch] < np.repeat(run.ids[self.row], n)
        start = (np.repeat(self.at, n) + upto[stretch])[gone]
        end = start + lengths[stretch[gone]] - 1 + run.span
        order = np.argsort(start, kind="stable")
        start, reached = start[order], np.maximum.accumulate(end[order]) if len(end) else end
        new = np.concatenate([[True], start[1:] > reached[:-1]])[: len(start)]
        stops = reached[np.concatenate([new[1:], [True]])[: len(start)]]
        starts = np.concatenate([[0], run.ends[:-1]])
        for a, b in zip(start[new].tolist(), stops.tolist(), strict=True):
            row = int(np.searchsorted(run.ends, a, side="right"))
            while True:  # a stretch may touch the next document's
                stop = min(b, int(run.ends[row]))
                if stop > a:
                    out[run.order[row]].append((a - int(starts[row]), stop - int(starts[row])))
                if stop == b:
                    break
                a, row = stop, row + 1
        return out


def _shared(a: int, b: int, span: int) -> int:
    """Length of the common prefix of two keys."""
    return span - (((a ^ b).bit_length() + 7) >> 3)


def _coded(blob: bytes, span: int) -> tuple[list[int], bytes, list[tuple[bytes, bytes]], list[int], np.ndarray]:
    """Keys, prefixes they share, contexts, least ids, and the places in the order of hashes.

    The prefixes are those of the keys, which are filled up with zero bytes:
    longer than the coded ones where a shorter suffix ends within.
    """
    raw = zstandard.decompress(blob)
    n, n_left = np.frombuffer(raw, "<i8", 2).tolist()
    at = 16
    shared, sizes, before = raw[at : at + n], raw[at + n : at + 2 * n], raw[at + 2 * n : at + 3 * n]
    at += 3 * n
    ids = np.frombuffer(raw, "<i8", n, at).tolist()
    places = np.frombuffer(raw, "<u4", n, at + 8 * n)
    left_at = at + 12 * n
    rest_at = left_at + n_left
    keys, known, entries, suffix = [], bytearray(), [], b""
    for same, size, n_before in zip(shared, sizes, before, strict=True):
        end = rest_at + size - same
        cut_short = same == len(suffix) or same == size
        suffix = suffix[:same] + raw[rest_at:end]
        rest_at = end
        entries.append((suffix, raw[left_at : left_at + n_before]))
        left_at += n_before
        keys.append(int.from_bytes(suffix.ljust(span, b"\0"), "big"))
        known.append(_shared(keys[-2], keys[-1], span) if cut_short and len(keys) > 1 else same)
    return keys, bytes(known), entries, ids, places


def merged(runs: list[tuple[list[int], bytes]], span: int) -> Iterator[tuple[int, int, int]]:
    """All keys in order as (run, place in the run, prefix shared with the key before), by a loser tree.

    ``known[r]`` is the prefix that run r's next key shares with the last key
    put out or, for a loser, with the key it lost to.  The smaller key is the
    one with the longer known prefix; parts beyond are compared on a tie only.
    """
    n = len(runs)
    end = 1 << (8 * span)
    heads = [keys[0] if keys else end for keys, _ in runs]
    known = [0 if keys else -1 for keys, _ in runs]
    at = [0] * n
    sizes = [len(keys) for keys, _ in runs]
    losers = [-1] * n
    winner = 0
    total = sum(sizes)

    def play(r: int) -> int:
        """Walks up from the run's leaf; returns who arrives at the root, or -1 if it waits for a partner."""
        node = (r + n) >> 1
        while node:
            other = losers[node]
            if other < 0:
                losers[node] = r
                return -1
            mine, theirs = known[r], known[other]
            if theirs > mine:
                losers[node], r = r, other
            elif theirs == mine:
                a, b = heads[r], heads[other]
                if b < a:
                    known[r] = _shared(a, b, span) if mine >= 0 else -1
                    losers[node], r = r, other
                else:
                    known[other] = _shared(a, b, span) if mine >= 0 else -1
            node >>= 1
        return r

    for r in range(n):
        arrived = play(r)
        if arrived >= 0:
            winner = arrived
    for _ in range(total):
        place = at[winner]
        yield winner, place, known[winner]
        keys, shared = runs[winner]
        place += 1
        at[winner] = place
        if place < sizes[winner]:
            heads[winner], known[winner] = keys[place], shared[place]
        else:
            heads[winner], known[winner] = end, -1
        winner = play(winner)


def _least_ids(group: list[tuple[tuple[bytes, bytes], int, int]], span: int) -> dict:
    """Of each context of a group: (number of windows, least id) along its windows.

    The group holds contexts in merged order, each with its least id and the
    prefix that it shares with the one before.  A prefix of q bytes keeps its
    class as long as neighbours share q bytes, so windows are equal if the
    class of their bytes from the anchor on and their bytes before it are.
    """
    least: dict = {}
    for context, doc, _ in group:
        if least.get(context, NO_ID) >= doc:
            least[context] = doc
    if len(least) == 1:
        ((context, doc),) = least.items()
        return {context: ((len(context[0]) + len(context[1]) - span + 1, doc),)}
    classes = list(range(span + 1))  # of the prefix of each length; no number stands for two
    used = span + 1
    windows: dict[tuple[int, bytes], int] = {}
    of: dict = {}
    for context, _, shared in group:
        if shared < span:
            fresh = span - shared
            classes[shared + 1 :] = range(used, used + fresh)
            used += fresh
        if context in of:
            continue
        (suffix, left), doc = context, least[context]
        n = len(left)
        found = of[context] = [(classes[span - n + j], left[j:]) for j in range(n + len(suffix) - span + 1)]
        for w in found:
            if windows.get(w, NO_ID) >= doc:
                windows[w] = doc
    out = {}
    for context, found in of.items():
        docs = [windows[w] for w in found]
        if docs.count(docs[0]) == len(docs):
            out[context] = ((len(docs), docs[0]),)
        else:
            out[context] = tuple((len(list(same)), doc) for doc, same in groupby(docs))
    return out


def resolve_part(blobs: list[bytes], span: int) -> list[bytes]:
    """Step 3 for one key range: for each run's contexts, in the order of hashes, the least ids along their windows."""
    runs = [_coded(blob, span) for blob in blobs]
    answers: list[list] = [[None] * len(run[0]) for run in runs]
    group: list[tuple[int, int, int]] = []

    def close() -> None:
        found = _least_ids([(runs[r][2][i], runs[r][3][i], shared) for r, i, shared in group], span)
        for r, i, _ in group:
            answers[r][i] = found[runs[r][2][i]]

    for r, i, shared in merged([run[:2] for run in runs], span):
        if group and shared < GRAM:
            close()
            group = []
        group.append((r, i, shared))
    if group:
        close()
    out = []
    for found, run in zip(answers, runs, strict=True):
        ordered = [found[i] for i in np.argsort(run[4]).tolist()]
        counts = np.array([len(x) for x in ordered], np.uint8)
        lengths = np.array([n for x in ordered for n, _ in x], np.uint8)
        docs = np.array([d for x in ordered for _, d in x], "<i8")
        head = np.array([len(counts), len(lengths)], "<i8").tobytes()
        out.append(zstandard.compress(head + counts.tobytes() + lengths.tobytes() + docs.tobytes(), 3))
    return out


def _answered(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each context the number of its stretches; of each stretch the windows and their least id."""
    raw = zstandard.decompress(blob)
    n, m = np.frombuffer(raw, "<i8", 2).tolist()
    counts, lengths = (np.frombuffer(raw, np.uint8, k, at).astype(np.int64) for k, at in ((n, 16), (m, 16 + n)))
    return counts, lengths, np.frombuffer(raw, "<i8", m, 16 + n + m)


def whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without the bytes of characters that they hold only in part."""
    out = []
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while a < b and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    return b"".join(kept) + data[at:]


# --- the plan ----------------------------------------------------------------


def _splitters(texts: DataFrame, total: int, n_ranges: int, span: int) -> list[bytes]:
    """Strings that cut the corpus' strings of ``span`` bytes into ranges of about equal number, ascending.

    Taken from about ``SAMPLES`` strings, one every ``total / SAMPLES`` bytes.  They steer the work, not the result.
    """
    if n_ranges < 2:
        return []
    gap = max(1, total // SAMPLES)
    data, size = F.encode("text", "UTF-8"), F.octet_length("text")
    offset = F.pmod(F.xxhash64("text"), F.lit(gap))
    places = F.when(size - span >= offset, F.sequence(offset, (size - span).cast("bigint"), F.lit(gap).cast("bigint")))
    strings = F.transform(places, lambda at: F.substr(data, (at + 1).cast("int"), F.lit(span)))
    found = sorted(bytes(r[0]) for r in texts.select(F.explode(strings)).collect())
    return sorted({found[i * len(found) // n_ranges] for i in range(1, n_ranges)}) if found else []


def dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    span: int = SPAN,
    run_bytes: int = RUN_BYTES,
    hot: int = HOT,
) -> DataFrame:
    """All columns of ``docs`` and ``removed`` (ARRAY of (start, end) byte offsets) and ``kept`` (BINARY).

    Columns of these names are replaced.
    """
    if not GRAM < span <= 255:
        raise ValueError(f"span must be from {GRAM + 1} to 255 bytes")
    fields = [f for f in docs.schema.fields if f.name not in ("removed", "kept")]
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n_runs, n_parts = max(1, ceil_div(total, run_bytes)), max(1, ceil_div(total, HASHED_BYTES))
    n_ranges = max(1, ceil_div(total, min(MERGED_BYTES, run_bytes)))
    splitters = _splitters(docs.select(F.col(text_col).alias("text")), total, n_ranges, span)
    n_ranges = len(splitters) + 1
    # rows equal in id and text are told apart by their place, so that many of them are no single run
    place = F.monotonically_increasing_id()
    number = F.pmod(F.xxhash64(F.col(id_col).cast("bigint"), F.crc32(F.encode(F.coalesce(text_col, F.lit("")), "UTF-8")), place), F.lit(n_runs))
    rows = docs.select(
        number.cast("bigint").alias("_run"),
        F.col(id_col).cast("bigint").alias("_id"),
        F.col(text_col).alias("_text"),
        *[F.col(f"`{f.name}`").alias(f"_c{i}") for i, f in enumerate(fields) if f.name != text_col],
    )
    # one exchange for the three steps that read the texts
    texts = rows.repartition("_run")

    def run_of(table: pa.Table) -> Run:
        return Run(table.column("_id").to_pylist(), table.column("_text").to_pylist(), span)

    @releasing
    def hashes(table: pa.Table) -> pa.Table:
        run = run_of(table)
        number = table.column("_run")[0].as_py()
        cuts = np.searchsorted(parts_of(run.unique, n_parts), np.arange(n_parts + 1))
        marks = run.marks()
        sent = [
            (p, number, _pack_sorted(run.unique[a:b]), zstandard.compress(marks[a:b].tobytes(), 1))
            for p, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
            if b > a
        ]
        return _table(sent, MESSAGE)

    @releasing
    def repeated(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        numbers = table.column("run").to_pylist()
        lists = [_unpack_sorted(b) for b in table.column("data").to_pylist()]
        marks = np.concatenate([np.frombuffer(zstandard.decompress(f), np.uint8) for f in table.column("flags").to_pylist()])
        _, inverse, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        inside = np.bincount(inverse, marks > MOST) > 0
        again, is_hot = (counts > 1) | inside, np.bincount(inverse, marks & MOST) > hot
        at, sent = 0, []
        for number, x in zip(numbers, lists, strict=True):
            index = inverse[at : at + len(x)]
            at += len(x)
            sent.append((part, number, np.packbits(again[index]).tobytes(), np.packbits(is_hot[index]).tobytes()))
        return _table(sent, MESSAGE)

    def candidates(table: pa.Table, flags: pa.Table) -> Entries:
        run = run_of(table)
        again, is_hot = np.zeros(len(run.unique), bool), np.zeros(len(run.unique), bool)
        cuts = np.searchsorted(parts_of(run.unique, n_parts), np.arange(n_parts + 1)).tolist()
        for part, data, more in zip(*(flags.column(c).to_pylist() for c in ("part", "data", "flags")), strict=True):
            a, b = cuts[part], cuts[part + 1]
            again[a:b] = np.unpackbits(np.frombuffer(data, np.uint8), count=b - a)
            is_hot[a:b] = np.unpackbits(np.frombuffer(more, np.uint8), count=b - a)
        return Entries(run, again, is_hot, splitters)

    @releasing
    def suffixes(table: pa.Table, flags: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table([], MESSAGE)
        number = table.column("_run")[0].as_py()
        found = candidates(table, flags)
        return _table([(p, number, found.coded(p), None) for p in range(n_ranges) if found.cuts[p] < found.cuts[p + 1]], MESSAGE)

    @releasing
    def resolved(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        answers = resolve_part(table.column("data").to_pylist(), span)
        return _table([(part, n, a, None) for n, a in zip(table.column("run").to_pylist(), answers, strict=True)], MESSAGE)

    carried = [i for i, f in enumerate(fields) if f.name != text_col]
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    @releasing
    def cut_rows(table: pa.Table, messages: pa.Table) -> pa.Table:
        is_answer = messages.column("flags").is_null()  # only hash flags come with a second bit list
        found = candidates(table, messages.filter(pc.invert(is_answer)))
        back = messages.filter(is_answer)
        spans = found.spans(dict(zip(back.column("part").to_pylist(), back.column("data").to_pylist(), strict=True)))
        texts = table.column("_text").to_pylist()
        kept = [cut((t or "").encode(), s) for t, s in zip(texts, spans, strict=True)]
        columns = {f"_c{i}": table.column(f"_c{i}") for i in carried}
        columns["_text"] = table.column("_text")
        columns["removed"] = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], spans_type)
        columns["kept"] = pa.array(kept, pa.binary())
        return pa.table(columns)

    first = texts.groupBy("_run").applyInArrow(hashes, MESSAGE_DDL)
    flags = first.groupBy("part").applyInArrow(repeated, MESSAGE_DDL)
    sent = texts.groupBy("_run").cogroup(flags.groupBy("run")).applyInArrow(suffixes, MESSAGE_DDL)
    answers = sent.groupBy("part").applyInArrow(resolved, MESSAGE_DDL)
    schema = T.StructType(
        [T.StructField(f"_c{i}", fields[i].dataType) for i in carried]
        + [
            T.StructField("_text", T.StringType()),
            T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
            T.StructField("kept", T.BinaryType()),
        ]
    )
    done = texts.groupBy("_run").cogroup(flags.union(answers).groupBy("run")).applyInArrow(cut_rows, schema)
    return done.select(
        *[F.col("_text" if f.name == text_col else f"_c{i}").alias(f.name) for i, f in enumerate(fields)], "removed", "kept"
    )


MESSAGE_DDL = "part bigint, run bigint, data binary, flags binary"
MESSAGE = pa.schema([("part", pa.int64()), ("run", pa.int64()), ("data", pa.binary()), ("flags", pa.binary())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def oracle(span: int = SPAN) -> str:
    """Digests of the kept bytes of ``documents`` in DuckDB SQL, from every string of ``span`` bytes."""
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS t FROM documents),
windows AS (
  SELECT r, doc_id, j, t[j + 1 : j + {span}] AS w
  FROM (SELECT r, doc_id, t, unnest(range(0, octet_length(t) - {span - 1})) AS j FROM docs)),
firsts AS (SELECT w, min(doc_id) AS least FROM windows GROUP BY w),
gone AS (SELECT r, j FROM windows JOIN firsts USING (w) WHERE least < doc_id OR (doc_id IS NULL AND least IS NOT NULL)),
marked AS (SELECT r, j, coalesce(j > lag(j) OVER w + {span}, true) AS fresh FROM gone WINDOW w AS (PARTITION BY r ORDER BY j)),
numbered AS (SELECT r, j, sum(fresh::INT) OVER (PARTITION BY r ORDER BY j) AS island FROM marked),
islands AS (SELECT r, island, min(j) AS a, max(j) + {span} AS b FROM numbered GROUP BY r, island),
pieces AS (
  SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM islands),
cut AS (
  SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS rest, string_agg(hex(t[before + 1 : a]), '' ORDER BY a) AS kept
  FROM pieces JOIN docs USING (r) GROUP BY r)
SELECT doc_id, octet_length(t)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN n_spans IS NULL THEN t ELSE unhex(kept || hex(t[rest + 1 : octet_length(t)])) END) AS kept_sha256
FROM docs LEFT JOIN cut USING (r)
"""
