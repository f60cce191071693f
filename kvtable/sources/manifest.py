"""The versioned manifest: which runs make up the table, newest first.

A version is one JSON file that is created whole and never changed.  Two
writers that start from the same version cannot both commit the next one.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from kvtable.schema import MANIFEST
from kvtable.sources.storage import Storage

FOLDER = "manifests"


@dataclass(frozen=True)
class RunInfo:
    run_id: int
    path: str
    tier: str
    min_key: str | None  # lower-case hex
    max_key: str | None
    n_rows: int
    n_tombstones: int
    min_seq: int | None
    max_seq: int | None

    def overlaps(self, start: bytes | None, end: bytes | None) -> bool:
        """Whether the run can hold a key within the bounds; unknown bounds keep it."""
        low = bytes.fromhex(self.min_key) if self.min_key is not None else None
        high = bytes.fromhex(self.max_key) if self.max_key is not None else None
        return not ((start is not None and high is not None and high < start) or (end is not None and low is not None and low > end))


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    max_seq: int = 0
    next_run: int = 0
    runs: tuple[RunInfo, ...] = ()  # newest first
    batches: dict[str, int] = field(default_factory=dict)  # last stream batch by query name

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        data = json.loads(text)
        return cls(**{**data, "runs": tuple(RunInfo(**r) for r in data["runs"])})


def _name(version: int) -> str:
    return f"{FOLDER}/manifest-{version:012d}.json"


def versions(storage: Storage) -> list[int]:
    return [int(n[len("manifest-") : -len(".json")]) for n in storage.names(FOLDER) if n.startswith("manifest-") and n.endswith(".json")]


def load(storage: Storage, version: int | None = None) -> Manifest:
    """The newest or a given version; a folder without any is an empty table."""
    known = versions(storage)
    if version is None:
        return Manifest.from_json(storage.read(_name(max(known)))) if known else Manifest()
    if version == 0:
        return Manifest()
    if version not in known:
        raise KeyError(f"no manifest version {version}")
    return Manifest.from_json(storage.read(_name(version)))


def commit(storage: Storage, manifest: Manifest) -> None:
    """Makes the manifest the next version, or raises FileExistsError if another writer was first."""
    storage.create(_name(manifest.version), manifest.to_json())


def as_frame(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """One row per run, newest first."""
    rows = [
        (
            r.run_id,
            r.path,
            r.tier,
            bytearray.fromhex(r.min_key) if r.min_key is not None else None,
            bytearray.fromhex(r.max_key) if r.max_key is not None else None,
            r.n_rows,
            r.n_tombstones,
            r.min_seq,
            r.max_seq,
        )
        for r in manifest.runs
    ]
    return spark.createDataFrame(rows, MANIFEST)
