"""The corpus pipeline: raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written and read again as the next stage's ``docs``; all but the last return
the columns of ``documents``.  Empty tables pass through, NULL and empty texts
are rejected by the quality rules, extra columns are carried along.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvtable.llm import packing, quality_classifier, quality_rules, simhash_dedup, suffix_dedup
from kvtable.llm import queries as llm_queries
from kvtable.llm.common import documents, with_text_batches
from kvtable.llm.shared import removed, scratch, written

#: Near-duplicate stage: five-word shingles, and the Jaccard similarity of their sets from which two texts are near copies.
SHINGLE, SIMILARITY = 5, 0.8


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier scores below its threshold."""
    with_text_batches(spark)
    model = llm_queries.classifier(spark, docs, sf_dir)
    scored = quality_classifier.scores(docs, model, out="__score")
    return scored.where(F.col("__score") >= quality_classifier.ACCEPT).drop("__score")


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or the log-likelihood threshold; the raw corpus is the whole of ``documents``."""
    with_text_batches(spark)
    judged = quality_rules.judge(docs, llm_queries.quality_model(spark, sf_dir))
    return judged.where("_q.kept").drop("_q")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    with_text_batches(spark)
    return simhash_dedup.deduplicated(docs, SHINGLE, SIMILARITY)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 bytes and more that an earlier document has; whole characters go, documents stay."""
    with_text_batches(spark)
    done = suffix_dedup.dedup(docs)

    @F.arrow_udf("string")
    def remaining(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, removed in batches:
            out = []
            for text, spans in zip(texts.to_pylist(), removed.to_pylist(), strict=True):
                if spans:
                    data = text.encode()
                    whole = suffix_dedup.whole_characters(data, [(s["start"], s["end"]) for s in spans])
                    text = suffix_dedup.cut(data, whole).decode()
                out.append(text)
            yield pa.array(out, pa.string())

    cut = done.select(*docs.columns, "removed").withColumn("text", remaining("text", "removed"))
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    changed = F.when(F.size("removed") > 0, length).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", changed).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document: its token ids, its sequence and place."""
    with_text_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify),
    ("quality_rules", apply_rules),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", drop_repeats),
    ("best_fit_packing", pack_sequences),
]

#: The first, third and last stage have no SQL form; the tests hold run() against the stages done in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage wrote on its way, and its input, go as soon as its result is stored."""
    docs, path = documents(spark, sf_dir), None
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            found = stage(spark, docs, sf_dir)
            stored, stored_path = written(found, keep=True)
        if path:
            removed(spark, path)
        docs, path = stored, stored_path
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
