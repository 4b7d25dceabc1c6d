"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; in local mode, where none is set, a temporary one."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="vellum-checkpoint-")
        sc.setCheckpointDir(found)
    return found


#: Folders of the intermediate tables written so far by this process; a deleted one is empty.
_MADE: list[str] = []


def written(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet and read again: its lineage is cut and its size known to the planner."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/vellum-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files behind: they go with each query, not with the driver's next collection of garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def made() -> int:
    """How many tables were written so far."""
    return len(_MADE)


def discard(spark: SparkSession, first: int, stop: int) -> None:
    """Deletes tables number first..stop - 1: for loops whose rounds are read by the next round only."""
    for n in range(first, stop):
        if _MADE[n]:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_MADE[n])
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
            _MADE[n] = ""
