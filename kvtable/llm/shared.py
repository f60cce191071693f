"""Intermediate tables in the folder that the cluster shares, which also cut the lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths written since each open ``scratch`` block began.
_open_blocks: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.  Where it is unset, a local folder if driver and executors are one
    process, as in tests, and an error on a cluster, whose machines would each write to their own disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame, keep: bool = False) -> tuple[DataFrame, str]:
    """The rows of ``df`` read back from Parquet in the shared folder, and the path.

    The files outlive the executors that wrote them, so a lost executor costs
    no recomputation.  What is not removed before goes when the driver ends;
    with ``keep`` the end of a ``scratch`` block leaves the table alone.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    place, files = _place(spark, path)
    files.deleteOnExit(place)
    if _open_blocks and not keep:
        _open_blocks[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    place, files = _place(spark, path)
    files.delete(place, True)
    files.cancelDeleteOnExit(place)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what was written inside; the results must have been stored elsewhere by then."""
    _open_blocks.append([])
    try:
        yield
    finally:
        for path in _open_blocks.pop():
            removed(spark, path)
