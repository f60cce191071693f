"""Exact token counts from the histogram of encoded lengths.

Documents are aggregated by encoded length, map-side first, so what is
shuffled is a row for each task and length.  Suffix sums over the histogram
then answer, for every context limit, how many documents are longer, how
many tokens remain after truncation, and every quantile, all exactly.

The sums run in two levels (blocks of lengths, then lengths in a block), so
no window spans the whole histogram.  NULL and empty texts have length 0;
repeated rows count as often as they occur; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvtable.llm.common import in_slices, released
from kvtable.llm.byte_bpe import codec
from kvtable.llm.shared import written

BLOCK = 1024


def encoded_length(text: Column, ranks_path: str, pattern: str) -> Column:
    """BIGINT: number of byte-level BPE tokens of the whole text."""

    @F.arrow_udf("bigint")
    def count_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = codec(ranks_path, pattern)
        for texts in released(batches):
            yield pa.array([len(bpe.encode_packed(t or "")) // 4 for t in in_slices(texts)], pa.int64())

    return count_batches(text)


def length_histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """``length, n_docs`` of a DataFrame with a length for each document; NULL counts as 0."""
    length = F.coalesce(F.col(length_col).cast("bigint"), F.lit(0).cast("bigint")).alias("length")
    return lengths.select(length).groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))


def limit_report(histogram: DataFrame) -> DataFrame:
    """For each length L that occurs, taken as a context limit:

    ``length, n_docs, n_tokens`` (documents and tokens at that length),
    ``docs_longer, tokens_longer`` (over L), ``docs_within, tokens_within``
    (up to L), ``truncated_total`` (tokens left if all are cut at L),
    ``total_docs, total_tokens`` and ``cdf`` (share of documents up to L: the
    q-quantile is the least L with cdf >= q).  Limits between two lengths
    follow by ``docs_longer * limit + tokens_within`` at the next lower row.
    """
    histogram, _ = written(histogram)  # read three times below, and the encoding is the costly part
    rows = histogram.select(
        F.expr(f"length div {BLOCK}").alias("block"),
        "length",
        "n_docs",
        (F.col("length") * F.col("n_docs")).alias("n_tokens"),
    )
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("_d"), F.sum("n_tokens").alias("_t"))
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("_d").over(after), F.lit(0)).alias("_docs_after"),
        F.coalesce(F.sum("_t").over(after), F.lit(0)).alias("_tokens_after"),
        F.sum("_d").over(whole).alias("total_docs"),
        F.sum("_t").over(whole).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    longer = rows.select(
        "*",
        F.coalesce(F.sum("n_docs").over(inside), F.lit(0)).alias("_d"),
        F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("_t"),
    ).join(blocks, "block")
    docs_longer, tokens_longer = F.col("_d") + F.col("_docs_after"), F.col("_t") + F.col("_tokens_after")
    return longer.select(
        "length",
        "n_docs",
        "n_tokens",
        docs_longer.alias("docs_longer"),
        tokens_longer.alias("tokens_longer"),
        (F.col("total_docs") - docs_longer).alias("docs_within"),
        (F.col("total_tokens") - tokens_longer).alias("tokens_within"),
        (F.col("total_tokens") - tokens_longer + F.col("length") * docs_longer).alias("truncated_total"),
        "total_docs",
        "total_tokens",
        ((F.col("total_docs") - docs_longer) / F.col("total_docs")).alias("cdf"),
    )


def quantiles(report: DataFrame, probabilities: list[float]) -> DataFrame:
    """``q, length`` for each probability: the least length whose cdf reaches it (exact, no sketch)."""
    picks = [
        F.min(F.when(F.col("cdf") >= F.lit(float(q)), F.col("length"))).alias(f"_{i}")
        for i, q in enumerate(probabilities)
    ]
    pairs = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.col(f"_{i}").alias("length")) for i, q in enumerate(probabilities)])
    return report.agg(*picks).select(F.inline(pairs))
