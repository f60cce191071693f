import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from kvtable.llm import byte_bpe, queries, token_counts
from kvtable.llm.common import with_text_batches

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.codec(RANKS, P.PATTERN)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


PARTS = ["a", "b", "th", "the ", " ", "  ", "\n", "\t", "'re", "'ll", "'", "s", "é", "ß", "1", "23", "!", "!!", "日本", "😀", "ing", "\u3000"]


@settings(deadline=None, max_examples=300)
@given(st.lists(st.sampled_from(PARTS), max_size=80), st.integers(1, 24), st.integers(1, 12))
def test_any_tree_gives_the_library_s_ids(parts, chars, size):
    text = "".join(parts)
    bpe = byte_bpe.codec(RANKS, P.PATTERN)
    saved = byte_bpe.LEAF_CHARS, byte_bpe.LEAF_BYTES
    whole = bpe.findall(text)
    ids = [t for p in whole for t in (bpe.merge(p.encode()) if p.encode() not in bpe.ranks else [bpe.ranks[p.encode()]])]
    try:
        byte_bpe.LEAF_CHARS, byte_bpe.LEAF_BYTES = chars, size
        bpe.packed.clear()
        bpe.packed.old = {}
        assert bpe.split(text) == whole
        assert bpe.encode(text) == ids
        assert bpe.decode(ids) == text.encode()
    finally:
        byte_bpe.LEAF_CHARS, byte_bpe.LEAF_BYTES = saved


def test_long_matches_and_awkward_texts(bpe, reference, edge_rows):
    texts = [t or "" for _, t, *_ in edge_rows]
    texts += ["a" * 5000, " " * 5000, "\n" * 3001 + "x", "ab" * 4000, "1" * 3000, "!?" * 3000, "ththe" * 2000]
    for text in texts:
        assert bpe.encode(text) == reference.encode_ordinary(text)
        assert bpe.decode(bpe.encode(text)) == text.encode()


def test_every_token_is_its_own_encoding(bpe):
    assert all(bpe.merge(token) == [rank] for token, rank in bpe.ranks.items())


def test_columns(edge, empty, clashing, reference):
    for df in (edge, clashing):
        got = byte_bpe.decode(byte_bpe.encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN).select("text", "ids", "decoded").collect()
        for r in got:
            assert r["ids"] == reference.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    assert byte_bpe.encode(empty, RANKS, P.PATTERN).count() == 0
    nothing = empty.sparkSession.createDataFrame([(None,)], "ids array<int>")
    assert bytes(byte_bpe.decode(nothing, RANKS, P.PATTERN).first()["decoded"]) == b""
    with pytest.raises(Exception, match="out of range"):
        byte_bpe.decode(empty.sparkSession.createDataFrame([([60_000],)], "ids array<int>"), RANKS, P.PATTERN).collect()


def test_query(spark, corpus, reference):
    want = []
    for r in spark.read.parquet(f"{corpus}/documents.parquet").collect():
        text = r["text"] or ""
        ids = reference.encode_ordinary(text)
        digests = [hashlib.sha256(x).hexdigest() for x in (" ".join(map(str, ids)).encode(), text.encode())]
        want.append((str(r["doc_id"]), len(ids), *digests))
    got = queries.op3_byte_bpe(spark, corpus).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == sorted(want)


def test_token_counts(spark, corpus, reference, bare_corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").collect()
    lengths = sorted(len(reference.encode_ordinary(r["text"] or "")) for r in docs)
    report = queries.op10_token_counts(spark, corpus)
    rows = {r["length"]: r for r in report.collect()}
    assert set(rows) == set(lengths)
    for n, r in rows.items():
        longer = [x for x in lengths if x > n]
        assert r["n_docs"] == lengths.count(n) and r["n_tokens"] == n * r["n_docs"]
        assert (r["docs_longer"], r["tokens_longer"]) == (len(longer), sum(longer))
        assert r["truncated_total"] == sum(min(x, n) for x in lengths)
        assert (r["docs_within"], r["tokens_within"]) == (len(lengths) - len(longer), sum(lengths) - sum(longer))
        assert (r["total_docs"], r["total_tokens"]) == (len(lengths), sum(lengths))
        assert abs(r["cdf"] - (1 - len(longer) / len(lengths))) < 1e-12
    quantiles = {r["q"]: r["length"] for r in token_counts.quantiles(report, [0.0, 0.5, 0.9, 1.0]).collect()}
    for q, n in quantiles.items():
        assert n == lengths[max(0, int(np.ceil(q * len(lengths))) - 1)]
    assert queries.op10_token_counts(spark, bare_corpus).count() == 0


def test_counts_of_given_lengths(spark):
    rows = token_counts.limit_report(token_counts.length_histogram(spark.createDataFrame([(None,), (0,), (3000,)], "n_tokens int")))
    assert {r["length"]: r["n_docs"] for r in rows.collect()} == {0: 2, 3000: 1}


def test_arrow_batches_are_bounded_and_smaller_settings_stay(spark):
    names = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes")]
    before = [spark.conf.get(n) for n in names]
    try:
        for given, wanted in ((("10000", "64m"), ("500", "16777216b")), (("20", "1m"), ("20", "1m")), (("0", "64m"), ("500", "16777216b"))):
            for n, v in zip(names, given, strict=True):
                spark.conf.set(n, v)
            with_text_batches(spark)
            assert [spark.conf.get(n) for n in names] == list(wanted)
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
