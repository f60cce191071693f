"""Streaming ingest: each micro-batch is one commit, applied exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kvtable.table import Table


def ingest(stream: DataFrame, table: Table, name: str, checkpoint: str, order: str, compact: bool = True, **trigger) -> StreamingQuery:
    """Applies a stream of ``key, value, tombstone`` and an ``order`` column to the table.

    The manifest keeps the last batch of each named stream, so a batch that
    is delivered again after a failure changes nothing.  ``trigger`` is
    passed on, e.g. ``availableNow=True``; the interval is the commit delay.
    """

    def apply(batch: DataFrame, number: int) -> None:
        table.upsert(batch, order=order, batch=(name, number))
        if compact:
            table.compact()

    writer = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(apply)
    return (writer.trigger(**trigger) if trigger else writer).start()
