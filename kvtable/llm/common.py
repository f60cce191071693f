"""Small shared pieces of the text operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space characters that separate words: space and \x09-\x0D.
WORD_SPACE = " \t\n\x0b\x0c\r"


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL(None).malloc_trim
    except AttributeError:  # not glibc
        return lambda pad: 0


def release() -> None:
    """Gives freed memory back to the system: a worker lives on after its task, and its pools with it."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def releasing(work: Callable) -> Callable:
    """``work`` on the tables of one group, or of two cogrouped ones, with memory released at its end."""

    def one(table):
        try:
            return work(table)
        finally:
            release()

    def two(table, other):
        try:
            return work(table, other)
        finally:
            release()

    return one if work.__code__.co_argcount == 1 else two


def released(batches: Iterator) -> Iterator:
    """The batches; memory is released after the last one."""
    try:
        yield from batches
    finally:
        release()


class PieceCache(dict):
    """A bounded memo of two generations: a piece is computed again only if both have lost it."""

    def __init__(self, make: Callable, limit: int = 300_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, piece):
        value = self.old.get(piece)
        if value is None:
            value = self.make(piece)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[piece] = value
        return value


def slices(batches: Iterator[pa.Array], rows: int = 256) -> Iterator[pa.Array]:
    """The batches in parts, so that a worker holds the results of a few rows only."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def in_slices(array: pa.Array, rows: int = 256) -> Iterator[str | None]:
    """The values of an Arrow array; only a slice of them is held as Python objects at a time."""
    for at in range(0, len(array), rows):
        yield from array.slice(at, rows).to_pylist()


#: Rows and bytes in an Arrow batch to a Python worker: whole texts, so Spark's defaults of 10,000 rows and 64 MB would be
#: held several times over on both sides.  A single longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20


def with_text_batches(spark: SparkSession) -> SparkSession:
    """The session with Arrow batches sized for rows that hold texts; smaller settings of the user's stay.

    Plans run after the call that made them, so the setting is not put back.
    """
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:  # always positive
        spark.conf.set(size, f"{BATCH_BYTES}b")
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(col: str) -> Column:
    """The text, with NULL as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


def blanked(text: Column) -> Column:
    """The text with all word separators as plain spaces."""
    return F.translate(text, WORD_SPACE[1:], " " * (len(WORD_SPACE) - 1))


def words_of(text: Column) -> Column:
    """Matches of ``[^\\x20\\x09-\\x0D]+`` in order, as an array."""
    return F.array_remove(F.split(blanked(text), " "), "")


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)
