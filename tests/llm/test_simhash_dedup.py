import itertools
import random
import re

import numpy as np
import pytest

import corpus_pipeline as pipeline
from kvtable.llm import simhash, simhash_dedup


def brute_shingles(text, n=5):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_groups(texts, similarity=0.8):
    """The component of each text, over all pairs."""
    sets, label = [brute_shingles(t) for t in texts], list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if jaccard(sets[i], sets[j]) >= similarity:
            a, b = label[j], label[i]
            label = [b if x == a else x for x in label]
    return label


def edited(seed):
    """Families of texts with single words replaced, so that the similarities lie around 0.8."""
    rng = random.Random(seed)
    out = []
    for _ in range(12):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice((40, 150, 400)))]
        for _ in range(rng.randint(1, 7)):
            now = list(words)
            for _ in range(round(len(now) * rng.uniform(0, 0.035))):
                now[rng.randrange(len(now))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(now))
            if rng.random() < 0.3:
                words = now
    rng.shuffle(out)
    return out


def kept_ids(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return sorted(r["doc_id"] for r in pipeline.drop_near_copies(spark, docs, "").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_the_stage_keeps_one_of_each_group_of_similarity_0_8(spark, seed):
    texts = edited(seed)
    label = brute_groups(texts)
    assert 12 < len(set(label)) < len(texts) - 5
    assert kept_ids(spark, texts) == sorted({g: label.index(g) for g in label}.values())


def test_pairs_of_the_tables_far_apart_in_fingerprint_bits_are_found(spark):
    """Pairs of similarity 0.8 and more whose fingerprints differ in 10 to 14 bits."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    pairs = [(7743, 9710), (4, 2540), (8421, 9728), (5108, 5918), (3650, 7230)]
    few = docs.where(docs.doc_id.isin([i for p in pairs for i in p]))
    texts = {r["doc_id"]: r["text"] for r in few.collect()}
    assert all(jaccard(brute_shingles(texts[a]), brute_shingles(texts[b])) >= 0.8 for a, b in pairs)
    kept = {r["doc_id"] for r in pipeline.drop_near_copies(spark, few, "").collect()}
    assert kept == {a for a, _ in pairs}


def test_edge_rows(spark, edge, edge_rows, empty, clashing):
    label = brute_groups([r[1] for r in edge_rows])
    for df in (edge, clashing):
        kept = simhash_dedup.deduplicated(df, 5, 0.8).collect()
        assert len(kept) == len(set(label)) and set(kept[0].asDict()) == set(df.columns)
        ids = [[edge_rows[j][0] for j in range(len(label)) if label[j] == g] for g in set(label)]
        want = [min((i for i in x if i is not None), default=None) for x in ids]
        assert sorted(map(str, (r["doc_id"] for r in kept))) == sorted(map(str, want))
    assert simhash_dedup.deduplicated(empty, 5, 0.8).count() == 0


def test_pairs_at_the_similarity_agree_in_a_table_and_are_within_reach():
    """Pairs of sets at similarity 0.8, for a small and a large corpus; unrelated ones are out of reach."""
    rng = np.random.default_rng(5)
    for n_rows in (1_000, 10_000_000):
        key_bits, tables, words = simhash_dedup.shape(n_rows, 0.8)
        assert 64 * words >= key_bits * tables
        factors, missed = simhash_dedup._factors(words), 0
        for _ in range(300):
            pool = np.unique(rng.integers(0, 1 << 63, 300, np.uint64))
            sets = pool[:90], pool[10:100], pool[200:290]
            fps = np.stack([np.frombuffer(simhash_dedup.wide_fingerprint(x, factors), "<u8") for x in sets])
            keys = simhash_dedup.table_keys(fps, key_bits, tables)
            d = np.bitwise_count(fps[0] ^ fps[1])
            near = d[:2].sum() <= simhash_dedup.reach(128, 0.8) and d.sum() <= simhash_dedup.reach(64 * words, 0.8)
            missed += not (near and (keys[0] == keys[1]).any())
            assert np.bitwise_count(fps[0] ^ fps[2]).sum() > simhash_dedup.reach(64 * words, 0.8)
        assert missed <= 9


def test_pairs_within_the_covered_radius_always_agree_in_a_table():
    rng = np.random.default_rng(6)
    key_bits, tables, words = simhash_dedup.shape(100_000, 0.8)
    for _ in range(200):
        bits = rng.integers(0, 2, 64 * words, np.uint8)
        other = bits.copy()
        other[rng.choice(64 * words, tables - 1, replace=False)] ^= 1
        fps = np.stack([np.packbits(x, bitorder="little").view("<u8") for x in (bits, other)])
        a, b = simhash_dedup.table_keys(fps, key_bits, tables)
        assert (a == b).any()


def test_a_bit_is_the_majority_of_the_sets_hashes():
    factors = simhash_dedup._factors(2)
    found = np.random.default_rng(7).integers(0, 1 << 63, 600, np.uint64)
    counts = [0] * 128
    for h in found.tolist():
        for w, factor in enumerate(factors.tolist()):
            x = h * factor % (1 << 64)
            x ^= x >> 32
            x = x * 0xD6E8FEB86659FD93 % (1 << 64)
            x ^= x >> 32
            for i in range(64):
                counts[64 * w + i] += x >> i & 1
    want = sum(1 << i for i, c in enumerate(counts) if 2 * c > len(found))
    assert int.from_bytes(simhash_dedup.wide_fingerprint(found, factors), "little") == want


def test_large_buckets_are_searched_in_parts(spark, monkeypatch):
    """Buckets cut into many parts give the same groups; the intermediate tables are gone afterwards."""
    from kvtable.llm.shared import scratch

    texts = edited(3)
    label = brute_groups(texts)
    want = sorted({g: label.index(g) for g in label}.values())
    monkeypatch.setattr(simhash, "BUCKET", 3)
    with scratch(spark):
        assert kept_ids(spark, texts) == want


def test_the_stage_leaves_nothing_behind(spark):
    from kvtable.llm.shared import scratch, shared_folder

    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    left = lambda: len(files.listStatus(folder)) if files.exists(folder) else 0
    before = left()
    with scratch(spark):
        kept_ids(spark, edited(4))
        assert left() > before
    assert left() == before


def test_texts_below_the_similarity_stay_however_near_their_fingerprints_are(spark):
    """Pairs whose fingerprints differ in at most 9 bits, with similarities of 0.49 and 0.57."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    pairs = [(110, 9989), (1880, 2141), (6973, 9542)]
    ids = [i for p in pairs for i in p]
    few = docs.where(docs.doc_id.isin(ids))
    texts = {r["doc_id"]: r["text"] for r in few.collect()}
    for a, b in pairs:
        assert jaccard(brute_shingles(texts[a]), brute_shingles(texts[b])) < 0.6
        assert (simhash.simhash(texts[a], 5) ^ simhash.simhash(texts[b], 5)).bit_count() <= 9
    assert sorted(r["doc_id"] for r in pipeline.drop_near_copies(spark, few, "").collect()) == sorted(ids)
