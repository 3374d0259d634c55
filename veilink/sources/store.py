"""Lineage cuts: intermediate tables in the checkpoint folder the cluster shares.

Iterative operators write each stage as a parquet table and read it back.  The table survives lost
executors, and its file statistics let the planner choose join strategies by real sizes.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

BROADCAST_BYTES = 256 * 1024 * 1024


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or by the context.

    A folder of our own is made only where driver and executors are one process (tests): elsewhere each host
    would write to its own disk, so a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="veilink-"))
    return context.getCheckpointDir()


_runs: list[list[str]] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{checkpoint_root(spark).rstrip('/')}/veilink/{label}-{uuid.uuid4().hex}"
    for paths in _runs:
        paths.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, every intermediate table written within it.

    For callers who have written or collected their results by then; frames that still read these tables fail
    afterwards.
    """
    paths: list[str] = []
    _runs.append(paths)
    try:
        yield
    finally:
        _runs.remove(paths)
        for path in paths:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@dataclass(frozen=True)
class Stored:
    """A written table and the figures observed while it was written."""

    frame: DataFrame
    rows: int
    seen: dict
    path: str
    table: str | None = None

    def drop(self) -> None:
        """Deletes the table.  For its maker, once everything that reads it has been written."""
        if self.table:
            self.frame.sparkSession.sql(f"DROP TABLE IF EXISTS {self.table}")
        _delete(self.frame.sparkSession, self.path)

    def fits(self, row_bytes: int) -> bool:
        """Whether the counted rows fit the bound of a broadcast."""
        return self.rows * row_bytes <= BROADCAST_BYTES

    def small_side(self, row_bytes: int) -> DataFrame:
        """The table, marked for broadcast if its counted rows fit the bound; else left to the planner."""
        return F.broadcast(self.frame) if self.fits(row_bytes) else self.frame


def store(df: DataFrame, label: str, buckets: tuple[int, str] | None = None, **figures: Column) -> Stored:
    """Write ``df`` once, observing its row count and any further aggregate in the same job.

    ``buckets`` (how many, of which column) lets joins by that column read the table without another exchange; a table
    in buckets has a name in the session's catalog until it is dropped.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    watch = Observation()
    watched = df.observe(watch, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in figures.items()])
    if buckets is None:
        watched.write.parquet(path)
        return Stored(spark.read.schema(df.schema).parquet(path), watch.get["rows"], watch.get, path)
    table = "veilink_" + re.sub(r"\W", "_", path.rsplit("/", 1)[-1])
    watched.write.format("parquet").option("path", path).bucketBy(*buckets).sortBy(buckets[1]).saveAsTable(table)
    return Stored(spark.table(table), watch.get["rows"], watch.get, path, table)
