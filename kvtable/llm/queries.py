"""The registered queries of the text operators: thin contracts over their operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvtable.llm import byte_bpe, license_scan, merkle, packing, quality_classifier, quality_rules, sharding, simhash, suffix_dedup, token_counts
from kvtable.llm.common import documents
from kvtable.llm.labels import held_out, training_labels, with_labels

N_SHARDS = 24


def _ranks() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(license_scan.scan(documents(spark, sf_dir), embedded=True))


def quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw corpus: all documents.  Trusted target: those of the training fold with quality 1."""
    labels = training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")).where("label = 1")
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return quality_rules.fit(with_labels(docs, labels, how="left"), F.col("label").isNotNull())


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return quality_rules.judge(docs, quality_model(spark, sf_dir)).select("doc_id", "_q.*")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    ids = byte_bpe.encode(docs, _ranks(), public_tokenizers.PATTERN).select("doc_id", "ids")
    both = byte_bpe.decode(ids, _ranks(), public_tokenizers.PATTERN)
    return both.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality_classifier.Model:
    return quality_classifier.fit(docs, training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = quality_classifier.scores(docs, classifier(spark, docs, sf_dir)).select("doc_id", "score")
    accepted = (F.col("score") >= quality_classifier.ACCEPT).cast("int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", accepted.alias("predicted"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = sharding.uniform_tree(N_SHARDS)
    rows = sharding.placement(documents(spark, sf_dir), tree)
    more = sharding.assign(rows, sharding.grown(tree), out="grown_shard")
    return more.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "path")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), shingle=3, radius=2)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.dedup(documents(spark, sf_dir).select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return done.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edit_report(documents(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = token_counts.encoded_length(F.col("text"), _ranks(), public_tokenizers.PATTERN)
    lengths = documents(spark, sf_dir).select(length.alias("n_tokens"))
    return token_counts.limit_report(token_counts.length_histogram(lengths))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_quality_rules": op2_quality_rules,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_sharding": op6_sharding,
        "op7_simhash": op7_simhash,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_fingerprints": op9_fingerprints,
        "op10_token_counts": op10_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    """The others have no SQL form (tokenizers, XXH64, fitted models, BLAKE2 trees); tests hold them against brute force."""
    return {
        "op1_license_scan": license_scan.oracle(),
        "op6_sharding": sharding.oracle(sharding.uniform_tree(N_SHARDS)),
        "op8_suffix_dedup": suffix_dedup.oracle(),
    }
