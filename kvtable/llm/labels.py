"""Labelled documents: the training fold and the join with the texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most rows of two numbers that are broadcast; beyond it the join shuffles.
MAX_BROADCAST_ROWS = 200_000


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the identifier's text falls into the held-out fold (NULL counts as empty)."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(F.encode(key, "UTF-8")) % folds == fold


def training_labels(labels: DataFrame, label: str = "quality", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, label`` outside the held-out fold.

    Rows with a NULL id or label are left out.  Of an id that is labelled
    more than once, the highest label counts.
    """
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(id_col))
    return rows.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label).cast("int").alias("label"))


def with_labels(docs: DataFrame, labels: DataFrame, how: str = "inner") -> DataFrame:
    """``docs`` joined with ``labels`` on doc_id; texts stay in place while the labels are few (counted)."""
    few = labels.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    return docs.join(F.broadcast(labels) if few else labels, "doc_id", how)
