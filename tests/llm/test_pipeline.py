import public_tokenizers as P

import corpus_pipeline as pipeline
from kvtable.llm import quality_classifier, queries, simhash, suffix_dedup
from tests.llm.test_dedup import brute_spans
from tests.llm.test_license_and_quality import brute_base
from tests.llm.test_packing import check
from tests.llm.test_simhash_dedup import brute_groups


def plain_pipeline(spark, sf_dir):
    """All stages over lists in Python; the two fitted models are taken from the stages' own inputs."""
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in frame.collect()]
    model = queries.classifier(spark, frame, sf_dir)
    docs = [d for d in docs if model.score(quality_classifier.features(d[1])) >= 0.7]
    kept = spark.createDataFrame(docs, "doc_id bigint, text string") if docs else frame.limit(0).select("doc_id", "text")
    judged = pipeline.quality_rules.judge(kept, queries.quality_model(spark, sf_dir)).collect()
    docs = [(r["doc_id"], r["text"]) for r in judged if not brute_base(r["text"])[5] and r["_q"]["score"] >= pipeline.quality_rules.MIN_SCORE]
    label = brute_groups([t for _, t in docs])
    first = {}
    for (i, t), g in zip(docs, label, strict=True):
        first[g] = min(first.get(g, (i, t)), (i, t))
    docs = sorted(first.values())
    out = []
    for (i, t), spans in zip(docs, brute_spans(docs, 50), strict=True):
        data = t.encode()
        out.append((i, suffix_dedup.cut(data, suffix_dedup.whole_characters(data, spans)).decode()))
    return out


def test_run_equals_the_stages_in_plain_python(spark, small):
    from tokenizers import Tokenizer

    docs = plain_pipeline(spark, small)
    assert 50 < len(docs)
    rows = pipeline.run(spark, small).collect()
    check(rows, docs, 4096, Tokenizer.from_file(P.path("word_bpe_49k.json")))


def test_stages_keep_the_columns_of_documents(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in pipeline.STAGES] == ["quality_classifier", "quality_rules", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    before = docs.count()
    for i, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, corpus).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == columns and docs.count() <= before, name
            before = docs.count()
    assert before > 0 and docs.select("doc_id").distinct().count() == before


def test_empty_tables_pass_through(spark, bare_corpus):
    assert pipeline.run(spark, bare_corpus).count() == 0


def test_repeats_stage_updates_lengths_and_cuts_whole_characters(spark):
    passage = "é" * 40
    docs = spark.createDataFrame(
        [(1, "start " + passage + " end", "fr", "s", 50), (2, "x" + passage + "y", "fr", "s", 42), (3, None, None, None, None)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    )
    rows = {r["doc_id"]: r for r in pipeline.drop_repeats(spark, docs, "").collect()}
    assert rows[1]["text"].startswith("start") and rows[1]["n_chars"] == 50
    assert rows[2]["text"] == "xy" and rows[2]["n_chars"] == 2 and rows[3]["text"] is None


def test_everything_else_works_without_this_part(tmp_path):
    """The driver may delete this subpackage, its tests and the pipeline."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(pipeline.__file__))
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n[:2] == 'op' or n == 'pipeline']; e.oracle_sql()"
    env = {**os.environ, "PYTHONPATH": ""}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env).returncode == 0


def test_all_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert len([q for q in names if q.startswith(f"op{n}_")]) == 1
    assert simhash.SEED == 42
