import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from kvtable.llm import packing, queries

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_runs_of_text_give_the_tokenizer_s_ids(tokenizer):
    own, rng = packing.SpacedTokenizer(PATH), random.Random(3)
    parts = ["a", "B", "th", "The", "ß", "É", "é", "ÿ", "Ÿ", "Ő", "ª", "×", "İ", " ", "\n", "\t", "\u3000", ".", ",", "'s", "'S", "'", "!!",
             "<|endoftext|>", "<|ENDOFTEXT|>", "<", "|", "12", "😀", "日本", "Σ", "ing", "\x0b", "\u0338", "=", "\0"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        want = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert own.packed(text) == want, text


def brute(lengths, capacity):
    """The rule written out: try every gap, take the smallest sum of squares, then the least gap left."""
    gaps, out, opened = [], [], 0
    for n in lengths:
        fits = sorted({g for _, g in gaps if g >= n})
        best = None
        for g in fits:
            after = [x for _, x in gaps]
            after.remove(g)
            after += [g - n] if g > n else []
            key = (sum(after.count(x) ** 2 for x in set(after)), g - n)
            best = min(best or (key, g), (key, g))
        if best is None:
            out.append(capacity)
            gaps.append((opened, capacity - n))
            opened += 1
        else:
            out.append(best[1])
            i = max(i for i, (_, g) in enumerate(gaps) if g == best[1])
            gaps[i] = (gaps[i][0], best[1] - n)
        gaps = [(s, g) for s, g in gaps if g]
    return out, opened


def test_rule_equals_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        capacity = rng.choice([5, 10, 16])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.5:
            lengths.sort(reverse=True)
        sequences, offsets = packing.sum_of_squares(lengths, capacity)
        gaps, opened = brute(lengths, capacity)
        assert [capacity - o for o in offsets] == gaps and len(set(sequences)) == opened


def check(rows, docs, capacity, tokenizer):
    """Every document whole, every sequence gapless and within capacity; returns the number of sequences."""
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at and length >= 1
            at += length
        assert at <= capacity
    want = defaultdict(list)
    for doc_id, text in docs:
        ids = ids_of(tokenizer, text)
        for i, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[doc_id].append((i, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    return len(sequences)


def test_packs_awkward_rows(edge, edge_rows, empty, clashing, tokenizer):
    docs = [(r[0], r[1]) for r in edge_rows]
    for df, per_group in ((edge, 8192), (edge, 4), (clashing, 8192)):
        rows = packing.pack(df, PATH, capacity=64, docs_per_group=per_group).collect()
        n = check(rows, docs, 64, tokenizer)
        if per_group == 8192:
            assert n <= -(-sum(r["length"] for r in rows) // 64) + 1
    assert packing.pack(empty, PATH).count() == 0


def test_kept_ids(edge, tokenizer):
    for r in packing.pack(edge, PATH, keep_ids=True).collect():
        assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]


def test_query_is_whole_and_tight(spark, small, tokenizer):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows = queries.op5_best_fit_packing(spark, small).collect()
    assert check(rows, docs, 4096, tokenizer) <= -(-sum(r["length"] for r in rows) // 4096) + 1


@pytest.mark.parametrize("per_group", [8192, 30, 7])
def test_ends_of_groups_are_packed_again(spark, per_group):
    """Many groups leave many part-filled sequences; packed again they are hardly more than the lower bound."""
    rng = random.Random(4)
    lengths = [rng.choice([rng.randint(1, 40), rng.randint(1, 400), 1000]) for _ in range(900)]
    rows = spark.createDataFrame([(i % 5 or None, n, n) for i, n in enumerate(lengths)], "doc_id bigint, piece int, length bigint")
    found = packing.pack_pieces(rows, 1000, -(-900 // per_group), per_group).collect()
    assert sorted(r["length"] for r in found) == sorted(lengths)
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1000
    bound = -(-sum(lengths) // 1000)
    assert len(sequences) <= bound * (1.01 if per_group > 7 else 1.05) + 1


def test_one_id_and_one_text_are_no_single_group(spark):
    rows = spark.createDataFrame([(None, 0, 10)] * 600, "doc_id bigint, piece int, length bigint").repartition(3)
    found = packing.pack_pieces(rows, 100, 20, 30)
    sizes = [r["count"] for r in found.groupBy(found.sequence_id.bitwiseAND(~0xFFFFFFFF)).count().collect()]
    assert found.select("sequence_id").distinct().count() <= 62 and max(sizes) < 100
