"""Snapshots and cached reports as Parquet folders (K1-K3, K9, ETL11, ETL13).

A report of a label is a folder ``label=<label>/report=<report>`` of versions.  A version is written
beside its place and renamed to the next number, so readers see a report whole; older versions go only
after the new one stands, so a crash at any time leaves the old report or the new one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import DependencyGraph


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, label: str, report: str | None = None) -> str:
        return f"{self.root}/label={label}" + (f"/report={report}" if report else "")

    def _versions(self, label: str, report: str) -> list[int]:
        place = self._path(self._at(label, report))
        if not self._fs.exists(place):
            return []
        names = (x.getPath().getName() for x in self._fs.listStatus(place))
        return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))

    def save(self, label: str, report: str, df: DataFrame) -> None:
        """Replaces a report."""
        beside, place = f"{self.root}/_part-{uuid.uuid4().hex}", self._at(label, report)
        df.write.parquet(beside)
        self._fs.mkdirs(self._path(place))
        old = self._versions(label, report)
        new = (old[-1] if old else 0) + 1
        if not self._fs.rename(self._path(beside), self._path(f"{place}/version={new}")):
            raise OSError(f"cannot put a report at {place}")
        for n in old:
            self._fs.delete(self._path(f"{place}/version={n}"), True)

    def load(self, label: str, report: str) -> DataFrame:
        found = self._versions(label, report)
        if not found:
            raise FileNotFoundError(self._at(label, report))
        return self.spark.read.parquet(f"{self._at(label, report)}/version={found[-1]}")

    def exists(self, label: str, report: str) -> bool:
        return bool(self._versions(label, report))

    def save_graph(self, label: str, graph: DependencyGraph) -> None:
        """K1."""
        self.save(label, "nodes", graph.nodes)
        self.save(label, "edges", graph.edges)

    def load_graph(self, label: str) -> DependencyGraph:
        return DependencyGraph(self.load(label, "nodes"), self.load(label, "edges"))

    def labels(self) -> list[tuple[str, int]]:
        """K2: (label, time of its last change), latest first."""
        if not self._fs.exists(self._path(self.root)):
            return []
        found = [(s.getPath().getName().removeprefix("label="), s.getModificationTime()) for s in self._fs.listStatus(self._path(self.root)) if s.getPath().getName().startswith("label=")]
        return sorted(found, key=lambda x: (-x[1], x[0]))

    def delete(self, label: str) -> None:
        self._fs.delete(self._path(self._at(label)), True)

    def keep_last(self, n: int) -> list[str]:
        """K2: deletes all but the n latest; the labels that went."""
        gone = [label for label, _ in self.labels()[n:]]
        for label in gone:
            self.delete(label)
        return gone

    def older_than(self, millis: int) -> list[str]:
        """K2: deletes labels last changed before the time; the labels that went."""
        gone = [label for label, at in self.labels() if at < millis]
        for label in gone:
            self.delete(label)
        return gone

    def report(self, key: str, name: str, compute: Callable[[], DataFrame]) -> DataFrame:
        """K3: a report kept under the hash of what it was made from; computed once per key."""
        label = f"cache-{key}"
        if not self.exists(label, name):
            self.save(label, name, compute())
        return self.load(label, name)


def fingerprint(files: DataFrame, config: str = "") -> str:
    """ETL11: a key over all files (path, content), whatever their order, and the configuration."""
    row = files.agg(F.count("*").alias("n"), F.sum(F.xxhash64("path", "content").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("content", "path")).alias("x")).first()
    import hashlib

    return hashlib.sha1(f"{row['n']}|{row['s']}|{row['x']}|{config}".encode()).hexdigest()


def checked(files: Callable[[], DataFrame], analyse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """ETL13: analyses the files; if they changed meanwhile, that is an error."""
    before = fingerprint(files())
    out = analyse(files())
    if fingerprint(files()) != before:
        raise RuntimeError("files changed during the analysis")
    return out
