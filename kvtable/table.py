"""The table: upserts and deletes as immutable sorted runs, reads that merge them.

A batch becomes a run and is visible once the next manifest version exists;
nothing that a reader holds is changed, so a DataFrame stays on the version
it was read at until old runs are vacuumed.  One writer commits at a time;
a second one that started from the same version gets FileExistsError, and may
go on after :meth:`Table.refresh`.  A run's folder carries the version it is
written for and a name of its own, so writers never share one.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvtable.operators import merge
from kvtable.operators.runs import compacted
from kvtable.schema import OP_COLUMNS, OPS, Options, checked
from kvtable.sources import manifest as manifests
from kvtable.sources.manifest import Manifest, RunInfo
from kvtable.sources.run_files import copy_run, describe, read_runs, write_log, write_run
from kvtable.sources.storage import Storage

#: Requested keys up to which a lookup names them to the Parquet readers, whose statistics and Bloom filters then prune.
NAMED_KEYS = 200
#: Seconds after which a run that no version names, and that some writer might still be writing, is taken for abandoned.
ABANDONED_AFTER = 7 * 86_400


class Table:
    def __init__(self, spark: SparkSession, path: str, options: Options | None = None, version: int | None = None):
        self.spark, self.options = spark, options or Options()
        self.storage = Storage(spark, path)
        self._pinned = version is not None
        self.manifest = manifests.load(self.storage, version)
        self._buffer: dict[bytes, tuple[bytes | None, int]] = {}
        self._buffer_bytes = 0
        self._seq = self.manifest.max_seq
        self._closed = False

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: Options | None = None, version: int | None = None) -> Table:
        """The newest version, or a given one for reading."""
        return cls(spark, path, options, version)

    def __enter__(self) -> Table:
        return self

    def __exit__(self, *error) -> None:
        self.close()

    def close(self) -> None:
        """Flushes buffered writes.  May be called again; other calls raise from then on."""
        if not self._closed:
            if not self._pinned:
                self.flush()
            self._closed = True

    def _open_check(self, write: bool = False) -> None:
        if self._closed:
            raise OSError("table is closed")
        if write and self._pinned:
            raise OSError("a pinned version is read-only")

    # --- writes -----------------------------------------------------------

    def put(self, key: bytes, value: bytes) -> None:
        """One write, held on the driver until a flush.  For more than a few use :meth:`upsert`."""
        if key is None or value is None:
            raise ValueError("key and value must not be None")
        self._hold(bytes(key), bytes(value))

    def delete(self, key: bytes) -> None:
        """Accepted for any key; hides older values."""
        if key is None:
            raise ValueError("key must not be None")
        self._hold(bytes(key), None)

    def _hold(self, key: bytes, value: bytes | None) -> None:
        self._open_check(write=True)
        self._seq += 1
        before = self._buffer.get(key, (None, 0))[0]
        self._buffer_bytes += max(0, len(key) + len(value or b"") - len(before or b""))
        self._buffer[key] = (value, self._seq)
        if self._buffer_bytes >= self.options.write_buffer_bytes:
            self.flush()

    def _buffered(self) -> DataFrame:
        rows = [(bytearray(k), None if v is None else bytearray(v), v is None, seq) for k, (v, seq) in self._buffer.items()]
        return self.spark.createDataFrame(rows, OPS)

    def flush(self) -> None:
        """Buffered writes become a run; without any, nothing happens."""
        self._open_check(write=True)
        if self._buffer:
            self._commit_run(self._buffered(), self._seq)
            self._buffer, self._buffer_bytes = {}, 0

    def upsert(self, rows: DataFrame, order: str | None = None, batch: tuple[str, int] | None = None) -> None:
        """A batch of ``key, value[, tombstone]``; of a key the row that is last by ``order`` counts.

        Without ``order`` a batch must not hold a key twice, else which one
        counts is not defined.  ``batch`` names a stream and its batch number;
        a batch that is already in the table is not applied again.
        """
        self._open_check(write=True)
        self.flush()
        if batch and self.manifest.batches.get(batch[0], -1) >= batch[1]:
            return
        tombstone = F.col("tombstone") if "tombstone" in rows.columns else F.lit(False)
        if order:
            # the order within a key is all that counts, so no global sort is needed
            newest = F.max_by(F.struct("value", tombstone.alias("tombstone")), F.col(order)).alias("_v")
            rows = rows.groupBy("key").agg(newest).select("key", "_v.value", "_v.tombstone")
            tombstone = F.col("tombstone")
        # keys are unique within a batch, so one sequence number does
        ops = checked(rows.select("key", "value", tombstone.alias("tombstone"), F.lit(self._seq + 1).alias("seq")))
        self._commit_run(ops, None, batch)

    def remove(self, keys: DataFrame) -> None:
        """Deletes a batch of ``key``."""
        self.upsert(keys.select("key", F.lit(None).cast("binary").alias("value"), F.lit(True).alias("tombstone")).dropDuplicates(["key"]))

    def append_ops(self, ops: DataFrame) -> None:
        """A batch of ops that carry their own ``seq``, all above the table's."""
        self._open_check(write=True)
        self.flush()
        least = ops.agg(F.min("seq")).first()[0]
        if least is not None and least <= self._seq:
            raise ValueError(f"seq {least} is not above the table's {self._seq}")
        self._commit_run(checked(ops), None)

    def _commit_run(self, ops: DataFrame, seq: int | None, batch: tuple[str, int] | None = None) -> None:
        now = self.manifest
        path = self._run_path(now.next_run, "runs")
        self._write(ops, path)
        info = describe(self.spark, now.next_run, path, "local")
        batches = {**now.batches, batch[0]: batch[1]} if batch else now.batches
        runs = (info, *now.runs) if info.n_rows else now.runs
        top = max(now.max_seq, info.max_seq or 0, seq or 0)
        self._commit(replace(now, version=now.version + 1, max_seq=top, next_run=now.next_run + 1, runs=runs, batches=batches))
        self._seq = top

    def _write(self, ops: DataFrame, path: str) -> None:
        write_run(ops, path, self.options)

    def _run_path(self, number: int, folder: str) -> str:
        return f"{self.storage.root}/{folder}/run-{number:012d}-v{self.manifest.version + 1:012d}-{uuid.uuid4().hex}"

    def _commit(self, manifest: Manifest) -> None:
        manifests.commit(self.storage, manifest)
        self.manifest = manifest

    def refresh(self) -> None:
        """Goes on from the newest version, with the buffered writes as newer than all of it."""
        self._open_check()
        if self._pinned:
            return
        self.manifest = manifests.load(self.storage)
        self._seq = self.manifest.max_seq
        for key, (value, _) in sorted(self._buffer.items(), key=lambda item: item[1][1]):
            self._seq += 1
            self._buffer[key] = (value, self._seq)

    # --- reads ------------------------------------------------------------

    def ops(self, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
        """All physical rows, of runs that can hold keys within the bounds, and buffered writes."""
        self._open_check()
        held = [] if start is not None and end is not None and start > end else self.manifest.runs
        rows = read_runs(self.spark, [r.path for r in held if r.overlaps(start, end)])
        return rows.unionByName(self._buffered()) if self._buffer else rows

    def scan(self, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
        """``key, value`` within the inclusive bounds, sorted by key."""
        return merge.scan(self.ops(start, end), start, end).orderBy("key")

    def get(self, key: bytes) -> bytes | None:
        found = merge.live(self.ops(key, key).where(F.col("key") == F.lit(bytearray(key)))).select("value").first()
        return bytes(found[0]) if found else None

    def _ops_for(self, keys: DataFrame) -> DataFrame:
        """The ops of runs and row groups that can hold the keys: few keys are named in the predicate, of more their bounds."""
        few = keys.select("key").where("key IS NOT NULL").distinct().limit(NAMED_KEYS + 1).collect()
        if len(few) <= NAMED_KEYS:
            named = sorted(bytes(r[0]) for r in few)
            if not named:
                return self.ops().limit(0)
            return self.ops(named[0], named[-1]).where(F.col("key").isin([F.lit(bytearray(k)) for k in named]))
        low, high = (bytes(x) for x in keys.agg(F.min("key"), F.max("key")).first())
        return self.ops(low, high).where(merge.in_range(low, high))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """``key, status, value`` of each requested key."""
        return merge.status(keys, self._ops_for(keys))

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return merge.multi_get(keys, self._ops_for(keys))

    def runs(self) -> DataFrame:
        return manifests.as_frame(self.spark, self.manifest)

    # --- upkeep -----------------------------------------------------------

    def compact(self, max_runs: int | None = None) -> bool:
        """Merges neighbouring runs into one until ``max_runs`` remain; True if there was anything to do.

        Which ones, the option ``compaction`` says.  Tombstones go if the
        oldest run takes part.  The merged run is written and committed before
        anything is removed; the runs it replaces stay for readers of older
        versions until :meth:`vacuum`.
        """
        self._open_check(write=True)
        self.flush()
        now, keep = self.manifest, max_runs if max_runs is not None else self.options.max_runs
        if keep < 1:
            raise ValueError("max_runs must be at least 1")
        if len(now.runs) <= keep:
            return False
        n = len(now.runs) - keep + 1
        at = len(now.runs) - n
        if self.options.compaction == "tiered":  # ties: the older ones
            at = min(range(len(now.runs) - n + 1), key=lambda i: (sum(r.n_rows for r in now.runs[i : i + n]), -i))
        newer, merging, older = now.runs[:at], now.runs[at : at + n], now.runs[at + n :]
        rows = read_runs(self.spark, [r.path for r in merging]).withColumn("run", F.lit(0).cast("bigint"))
        merged = compacted(rows, 2, 1, drop_tombstones=not older).select(*OP_COLUMNS)
        path = self._run_path(now.next_run, "runs")
        self._write(merged, path)
        info = describe(self.spark, now.next_run, path, "local")
        runs = (*newer, info, *older) if info.n_rows else (*newer, *older)
        self._commit(replace(now, version=now.version + 1, next_run=now.next_run + 1, runs=runs))
        self.tier()
        return True

    def tier(self) -> None:
        """Runs beyond the newest ``keep_local`` move to the remote folder: copied by a job, committed, then removed by vacuum."""
        self._open_check(write=True)
        now, moved = self.manifest, False
        runs: list[RunInfo] = []
        for place, run in enumerate(now.runs):
            if place >= self.options.keep_local and run.tier == "local":
                path = self._run_path(run.run_id, "remote-runs")
                copy_run(self.spark, run.path, path, self.options)
                run, moved = replace(run, path=path, tier="remote"), True
            runs.append(run)
        if moved:
            self._commit(replace(now, version=now.version + 1, runs=tuple(runs)))

    def vacuum(self, abandoned_after: float = ABANDONED_AFTER) -> int:
        """Removes run folders that the newest version, by now, does not name; returns how many.

        A folder that was written for a version which exists by now is either
        named or will never be, whoever wrote it.  One for a later version may
        be a commit under way and stays, unless it has not changed for
        ``abandoned_after`` seconds.
        """
        self._open_check(write=True)
        newest = manifests.load(self.storage)
        used = {r.path for r in newest.runs}
        gone = 0
        for folder in ("runs", "remote-runs"):
            for name in self.storage.names(folder):
                path = f"{self.storage.root}/{folder}/{name}"
                aimed_at = re.search(r"-v(\d+)-", name)
                decided = aimed_at is not None and int(aimed_at[1]) <= newest.version
                if path not in used and (decided or self.storage.age(path) > abandoned_after):
                    self.storage.delete(path)
                    gone += 1
        return gone


class LogTable(Table):
    """A store that is its log: every write is durable when the call returns, nothing is merged, reads replay the log.

    ``append`` takes a batch, in the order of a column; of a key the last
    record counts.  ``flush`` has nothing to do.
    """

    def _write(self, ops: DataFrame, path: str) -> None:
        write_log(ops, path, self.options)

    def _hold(self, key: bytes, value: bytes | None) -> None:
        super()._hold(key, value)
        super().flush()

    def append(self, rows: DataFrame, order: str) -> None:
        """A batch of ``key, value[, tombstone]`` records, numbered on in the order of a unique BIGINT column."""
        self._open_check(write=True)
        tombstone = F.col("tombstone") if "tombstone" in rows.columns else F.lit(False)
        least = rows.agg(F.min(order)).first()[0]
        if least is not None:
            seq = F.lit(self._seq + 1) + F.col(order) - F.lit(least)
            self._commit_run(checked(rows.select("key", "value", tombstone.alias("tombstone"), seq.alias("seq"))), None)

    def replay(self) -> DataFrame:
        """All records, the first one first."""
        return self.ops().orderBy("seq")

    def upsert(self, rows: DataFrame, order: str | None = None, batch: tuple[str, int] | None = None) -> None:
        raise NotImplementedError("append to a log instead")

    def compact(self, max_runs: int | None = None) -> bool:
        raise NotImplementedError("a log is not compacted")

    def tier(self) -> None:
        raise NotImplementedError("a log is not tiered")


class MemoryTable:
    """The same calls over a dict on the driver; for tests and small state.  Nothing is stored."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._data: dict[bytes, bytes] = {}
        self._closed = False

    def _check(self) -> None:
        if self._closed:
            raise OSError("table is closed")

    def put(self, key: bytes, value: bytes) -> None:
        self._check()
        if key is None or value is None:
            raise ValueError("key and value must not be None")
        self._data[bytes(key)] = bytes(value)

    def delete(self, key: bytes) -> None:
        self._check()
        if key is None:
            raise ValueError("key must not be None")
        self._data.pop(bytes(key), None)

    def get(self, key: bytes) -> bytes | None:
        self._check()
        return self._data.get(bytes(key))

    def scan(self, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
        self._check()
        rows = [(bytearray(k), bytearray(v)) for k, v in self._data.items() if (start is None or k >= start) and (end is None or k <= end)]
        return self.spark.createDataFrame(rows, "key binary, value binary").orderBy("key")

    def flush(self) -> None:
        self._check()

    def close(self) -> None:
        self._closed = True
