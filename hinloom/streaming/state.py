"""Versioned model state: one folder per version, complete once it has its marker.

A version is known by its number and by the query run and batch it was made from.  Batch numbers start anew with a
new checkpoint folder, so the run is part of the key: a replayed batch of the same run finds its version and changes
nothing, a batch of another run continues from the newest version.  A batch that failed half way is overwritten.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

# Versions kept, besides the newest of every run.  A query replays its last batch at most, so older ones of a run are
# never asked for.
KEPT = 10

_NAME = re.compile(r"version=(\d+),run=([^,]*),batch=(-?\d+)$")


def query_run(spark: SparkSession, checkpoint: str) -> str:
    """The id a streaming query keeps in its checkpoint folder; another folder, or an emptied one, has another."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(checkpoint.rstrip("/"), "metadata")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise RuntimeError(f"{checkpoint} has no query metadata")
    return json.loads(spark.read.text(path.toString()).first()["value"])["id"]


class ModelState:
    def __init__(self, spark: SparkSession, path: str, kept: int = KEPT) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self.kept = kept

    def _filesystem(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _complete(self) -> list[tuple[int, str, int]]:
        """(version, run, batch) of the complete versions, oldest first; one listing of the few that are kept."""
        jvm = self.spark._jvm
        root, fs = self._filesystem()
        if not fs.exists(root):
            return []
        found = []
        for status in fs.listStatus(root):
            folder = status.getPath()
            name = _NAME.match(folder.getName())
            if name and fs.exists(jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")):
                found.append((int(name[1]), name[2], int(name[3])))
        return sorted(found)

    def _folder(self, version: int, run: str, batch: int) -> str:
        return f"{self.path}/version={version:012d},run={run},batch={batch}"

    def versions(self) -> list[int]:
        """Numbers of the complete versions, oldest first."""
        return [version for version, _, _ in self._complete()]

    def has(self, run: str, batch: int) -> bool:
        return any(r == run and b == batch for _, r, b in self._complete())

    def write(self, run: str, batch: int, rows: DataFrame) -> None:
        """Add a version behind the newest; the oldest beyond those kept go, but for the newest of each run."""
        known = self._complete()
        version = known[-1][0] + 1 if known else 0
        rows.coalesce(1).write.mode("overwrite").parquet(self._folder(version, run, batch))
        _, fs = self._filesystem()
        # A start (batch below 0) is never replayed.
        newest = {of: number for number, of, made in known if made >= 0} | {run: version}
        for old in known[: max(0, len(known) + 1 - self.kept)]:
            if newest.get(old[1]) == old[0]:
                continue
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(*old)), True)

    def latest(self) -> DataFrame | None:
        """The newest complete version."""
        known = self._complete()
        return self.spark.read.parquet(self._folder(*known[-1])) if known else None
