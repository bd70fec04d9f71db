"""Durable stages (A8, A9): tables in a shared folder that later applications
find again, keyed by what they were made of.

A stage's name ends in a digest of its inputs (each file's path, length and
time of change) and parameters, so changed inputs make another stage. A build
writes under ``_building`` and takes its name when Spark's commit marker is
there; so a stage under its name is whole, what a lost driver left is never
taken for one, and of two drivers that build the same stage the first wins.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import path_exists


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def input_version(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """``(path, length, time of change)`` of the files under ``path``."""
    fs, p = _hadoop(spark, path)
    found, files = fs.listFiles(p, True), []
    while found.hasNext():
        f = found.next()
        name = f.getPath().toString()
        if not f.getPath().getName().startswith(("_", ".")):
            files.append((name, f.getLen(), f.getModificationTime()))
    return sorted(files)


class DurableStages:
    """Stages under ``root``, a folder that all drivers and executors share."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def path(self, spark: SparkSession, name: str, inputs=(), params: dict | None = None) -> str:
        """Where the stage is, or will be. ``inputs``: paths that it is made
        of; ``params``: everything else that its rows depend on (as JSON)."""
        what = {"inputs": [input_version(spark, i) for i in inputs], "params": params or {}}
        digest = hashlib.sha256(json.dumps(what, sort_keys=True).encode()).hexdigest()[:32]
        return f"{self.root}/{name}-{digest}"

    def is_there(self, spark: SparkSession, path: str) -> bool:
        return path_exists(spark, f"{path}/_SUCCESS")

    def get(self, spark: SparkSession, name: str, build: Callable[[], DataFrame], inputs=(), params: dict | None = None, cluster_by=None) -> DataFrame:
        """The stage, built if no application has built it yet."""
        path = self.path(spark, name, inputs, params)
        if not self.is_there(spark, path):
            df = build()
            if cluster_by:
                df = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
            own = f"{self.root}/_building/{name}-{uuid.uuid4().hex}"
            df.write.parquet(own)
            fs, p = _hadoop(spark, path)
            source = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
            if fs.exists(p) and not self.is_there(spark, path):
                fs.delete(p, True)  # no stage of ours: it has no marker
            if fs.exists(p) or not fs.rename(source, p):
                fs.delete(source, True)
                if not self.is_there(spark, path):
                    raise OSError(f"stage {path} can not take its name")
        self._used(spark, path)
        return spark.read.parquet(path)

    def _used(self, spark: SparkSession, path: str) -> None:
        fs, p = _hadoop(spark, f"{path}/_SUCCESS")
        fs.setTimes(p, spark.sparkContext._jvm.System.currentTimeMillis(), -1)

    def stages(self, spark: SparkSession) -> list[tuple[str, int, int]]:
        """``(path, bytes, last use)`` of the whole stages, longest unused first."""
        fs, p = _hadoop(spark, self.root)
        if not fs.exists(p):
            return []
        out = []
        for s in fs.listStatus(p):
            path = s.getPath().toString()
            if s.isDirectory() and self.is_there(spark, path):
                marker = _hadoop(spark, f"{path}/_SUCCESS")[1]
                out.append((path, fs.getContentSummary(s.getPath()).getLength(), fs.getFileStatus(marker).getModificationTime()))
        return sorted(out, key=lambda x: (x[2], x[0]))

    def evict(self, spark: SparkSession, max_bytes: int, builds_before: int | None = None) -> list[str]:
        """Remove the longest unused stages until the rest has at most
        ``max_bytes``, and unfinished builds last changed before the time
        ``builds_before`` (milliseconds). Returns the paths removed."""
        fs, gone = _hadoop(spark, self.root)[0], []
        stages = self.stages(spark)
        total = sum(s[1] for s in stages)
        for path, size, _ in stages:
            if total <= max_bytes:
                break
            fs.delete(_hadoop(spark, path)[1], True)
            gone.append(path)
            total -= size
        building = _hadoop(spark, f"{self.root}/_building")[1]
        if builds_before is not None and fs.exists(building):
            for s in fs.listStatus(building):
                if s.getModificationTime() < builds_before:
                    fs.delete(s.getPath(), True)
                    gone.append(s.getPath().toString())
        return gone


def pending_stages(spark: SparkSession, store: DurableStages, requested: DataFrame, key: str, path_of: Callable[[str], str]) -> DataFrame:
    """The ``requested`` items (one row each, ``key``) whose stage is not
    there yet; ``path_of`` gives an item's stage path."""
    names = [r[0] for r in requested.select(key).distinct().collect()]  # one per dataset of a run
    done = [n for n in names if store.is_there(spark, path_of(n))]
    return requested.filter(F.col(key).isNull() | ~F.col(key).isin(done)) if done else requested
