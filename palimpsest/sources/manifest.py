"""Manifests: which runs make up a store, as immutable numbered files.

A new manifest is published by creating the file of the next number; whoever
creates it first wins and others have to look again. A reader that holds a
manifest keeps seeing its runs, whatever is published later."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from palimpsest.model import ManifestConflict
from palimpsest.sources.files import Files

FOLDER = "manifest"

SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("seq", T.LongType()),
    T.StructField("path", T.StringType()), T.StructField("n_keys", T.LongType()), T.StructField("bytes", T.LongType()),
    T.StructField("file_bytes", T.LongType()), T.StructField("min_key", T.BinaryType()), T.StructField("max_key", T.BinaryType()),
    T.StructField("min_ts", T.LongType()), T.StructField("max_ts", T.LongType()),
])


@dataclass(frozen=True)
class Run:
    run_id: str
    level: int
    seq: int
    path: str
    n_keys: int
    bytes: int
    file_bytes: int
    min_key: bytes
    max_key: bytes
    min_ts: int
    max_ts: int


@dataclass(frozen=True)
class Manifest:
    number: int = 0
    next_seq: int = 1
    clock: int = 0
    runs: tuple[Run, ...] = ()
    #: last batch of each stream that has been taken in
    streams: dict[str, int] = field(default_factory=dict)
    #: number of the first run since which no version has been collected as garbage
    whole_from: int = 0

    def dump(self) -> bytes:
        d = asdict(self)
        for r in d["runs"]:
            r["min_key"], r["max_key"] = r["min_key"].hex(), r["max_key"].hex()
        return json.dumps(d).encode()

    @classmethod
    def load(cls, data: bytes) -> Manifest:
        d = json.loads(data)
        runs = tuple(Run(**{**r, "min_key": bytes.fromhex(r["min_key"]), "max_key": bytes.fromhex(r["max_key"])}) for r in d.pop("runs"))
        return cls(runs=runs, **d)

    def next(self, **changes) -> Manifest:
        return replace(self, number=self.number + 1, **changes)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(asdict(r)[f.name] for f in SCHEMA) for r in self.runs], SCHEMA)


def numbers(files: Files) -> list[int]:
    return sorted(int(n[:-5]) for n in files.names(FOLDER) if n.endswith(".json"))


def latest(files: Files) -> Manifest:
    found = numbers(files)
    return Manifest.load(files.read(f"{FOLDER}/{found[-1]:012d}.json")) if found else Manifest()


def publish(files: Files, manifest: Manifest) -> Manifest:
    if not files.create(f"{FOLDER}/{manifest.number:012d}.json", manifest.dump()):
        raise ManifestConflict(f"manifest {manifest.number} has been published by another writer")
    return manifest
