"""Quality rules: text statistics and a hashed n-gram log-likelihood ratio.

Words are the matches of ``[^\\x20\\x09-\\x0D]+``.  The rules read five
numbers of a text (words, their characters, symbols, repeated lines, words in
repeated 5-word windows).  The method then compares two multinomials over
hashed word uni- and bigrams: one of trusted target documents, one of the
whole raw corpus.  The raw counts are scaled to the target's total before
both get the same added counts, so an n-gram too rare to tell weighs little.
A document's score is the mean of ``log p_target - log p_raw`` over its
n-grams; it is kept if the base rules pass and the score reaches a fixed
threshold.  Nothing is drawn at random and every document is decided.

The counts cover all documents.  The model is ``n_buckets`` numbers, one
scalar subquery; documents are scored in their rows, so no text is shuffled.
Windows are compared by 64-bit hashes of their words.

NULL texts have no words and fail the base rules, as do empty ones; without
any target document the model is flat (score 0) and only the base rules
decide; repeated rows are judged each; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvtable.llm.common import blanked, text_of, words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
N_BUCKETS = 1 << 15
#: Counts added to each bucket of either multinomial.
SMOOTHING = 20.0
#: Mean log-likelihood ratio per n-gram from which a document is kept.
MIN_SCORE = -0.08


def statistics(rows: DataFrame) -> DataFrame:
    """Rows with a ``_text`` get ``_words`` (array), ``_wh`` (their hashes) and ``_stats`` (struct of the base columns)."""
    text = text_of("_text")
    lines = F.filter(
        F.split(text, "\n"), lambda line: F.trim(F.translate(line, "\t\x0b\x0c\r", "    ")) != F.lit("")
    )
    first = rows.select("*", words_of(text).alias("_words"), lines.alias("_lines"))
    hashed = first.select("*", F.transform("_words", lambda w: F.xxhash64(w)).alias("_wh"))
    n_windows = F.size("_wh") - (WINDOW - 1)
    windows = F.transform(
        F.slice("_wh", 1, F.greatest(n_windows, F.lit(0))),
        lambda h, i: F.xxhash64(h, *[F.get(F.col("_wh"), i + k) for k in range(1, WINDOW)]),
    )
    windowed = hashed.select("*", windows.alias("_windows"))
    # only texts with a repeated window are sorted
    repeats = F.when(
        F.size(F.array_distinct("_windows")) < F.size("_windows"),
        F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    ordered = windowed.select("*", repeats.alias("_ordered"))
    places = F.sort_array(
        F.transform(
            F.filter(
                F.transform(
                    "_ordered",
                    lambda x, j: F.struct(
                        x["i"].alias("i"),
                        (
                            F.coalesce(F.get(F.col("_ordered"), j - 1)["h"] == x["h"], F.lit(False))
                            | F.coalesce(F.get(F.col("_ordered"), j + 1)["h"] == x["h"], F.lit(False))
                        ).alias("again"),
                    ),
                ),
                lambda x: x["again"],
            ),
            lambda x: x["i"],
        )
    )
    covered = F.aggregate(
        F.col("_places"),
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, p: F.struct(
            p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).cast("bigint").alias("n")
        ),
        lambda acc: acc["n"],
    )
    placed = ordered.select("*", places.alias("_places"))
    plain = F.replace(blanked(text), F.lit(" "), F.lit(""))
    stats = F.struct(
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(plain).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("bigint")).alias("n_repeat_words"),
    )
    return placed.select("*", stats.alias("_stats")).drop("_lines", "_windows", "_ordered", "_places")


def grams(hashes: Column, n_buckets: int = N_BUCKETS) -> Column:
    """Buckets of the word uni- and bigrams, from the words' hashes."""
    bucket = lambda h: F.pmod(h, F.lit(n_buckets)).cast("int")
    pairs = F.transform(
        F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0))),
        lambda h, i: bucket(F.xxhash64(h, F.get(hashes, i + 1))),
    )
    return F.concat(F.transform(hashes, bucket), pairs)


def fit(
    raw: DataFrame,
    is_target: Column,
    text_col: str = "text",
    n_buckets: int = N_BUCKETS,
    smoothing: float = SMOOTHING,
) -> DataFrame:
    """One row, ``weights ARRAY<DOUBLE>``: log p_target - log p_raw of each bucket.

    The raw corpus is all rows, the target those for which ``is_target`` holds (NULL: not); both are counted in one pass.
    """
    hashes = raw.select(F.transform(words_of(text_of(text_col)), lambda w: F.xxhash64(w)).alias("_wh"), is_target.alias("_t"))
    buckets = hashes.select(F.explode(grams(F.col("_wh"), n_buckets)).alias("bucket"), "_t")
    counts = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("r"), F.count_if(F.col("_t")).alias("t"))
    return log_ratios(counts, n_buckets, smoothing)


def log_ratios(counts: DataFrame, n_buckets: int = N_BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """The row of ``fit`` from ``bucket, r, t``: how often a bucket occurs in the raw corpus and in the target."""
    every = counts.sparkSession.range(n_buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(counts, "bucket", "left").select("bucket", F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("t", F.lit(0)).alias("t"))
    model = both.agg(
        F.sum("r").alias("nr"), F.sum("t").alias("nt"), F.sort_array(F.collect_list(F.struct("bucket", "r", "t"))).alias("c")
    )
    # a product of two counts leaves BIGINT at about 100 GB of documents
    expected = lambda c: c["r"].cast("double") * F.col("nt") / F.col("nr")
    weights = F.transform("c", lambda c: F.log((c["t"] + smoothing) / (expected(c) + smoothing)))
    flat = F.transform("c", lambda c: F.lit(0.0))
    return model.select(F.when(F.col("nt") > 0, weights).otherwise(flat).alias("weights"))


def judge(
    docs: DataFrame,
    model: DataFrame,
    text_col: str = "text",
    min_score: float = MIN_SCORE,
    n_buckets: int = N_BUCKETS,
) -> DataFrame:
    """All columns of ``docs`` and ``_q``: a struct of the base columns, ``base_failed``, ``score``, ``kept``.

    A column named ``_q`` is replaced; no other name can clash.
    """
    given = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "_q"])
    rows = statistics(docs.select(given.alias("_in"), F.col(text_col).alias("_text"), model.scalar().alias("_weights")))
    rows = rows.select("*", grams(F.col("_wh"), n_buckets).alias("_grams"))
    total = F.aggregate(F.col("_grams"), F.lit(0.0), lambda acc, g: acc + F.get(F.col("_weights"), g))
    rows = rows.select("*", F.when(F.size("_grams") > 0, total / F.size("_grams")).otherwise(0.0).alias("_score"))
    n_words, repeats = F.col("_stats.n_words"), F.col("_stats.n_repeat_words")
    failed = (n_words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n_words)
    verdict = F.struct(
        "_stats.*",
        failed.alias("base_failed"),
        F.col("_score").alias("score"),
        (~failed & (F.col("_score") >= F.lit(min_score))).alias("kept"),
    )
    # the one-row explode keeps a caller's filter above: pushed down, it would repeat all of the expressions
    return rows.select("_in", F.explode(F.array(verdict)).alias("_q")).select("_in.*", "_q")
