"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing Parquet there and reading it back, so a lost
executor costs only the tasks it was running.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_roots: list[tuple[SparkSession, str]] = []
#: Rows of numbers that one task takes.
TASK_ROWS = 20_000
#: Rows of numbers up to which a table is broadcast.
BROADCAST_ROWS = 300_000


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where that is unset and all tasks run in the driver (tests, local mode)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="strataglyph-")
        spark.conf.set("spark.checkpoint.dir", folder)
        _roots.append((spark, folder))
    return folder.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _roots:
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
        except Exception:  # the session may already be gone at exit
            pass


class Workspace:
    """Named Parquet tables of one operator call."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/strataglyph/{label}-{uuid.uuid4().hex}"
        _roots.append((spark, self.root))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def close(self) -> None:
        """Deletes all its tables."""
        delete(self.spark, self.root)

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, self.path(name))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables of the workspaces that were made inside it as it ends."""
    shared_folder(spark)
    before = len(_roots)
    try:
        yield
    finally:
        for _, path in _roots[before:]:
            delete(spark, path)
        del _roots[before:]


def fresh(taken: list[str], n: int) -> list[str]:
    """Names that no column has, in whatever case."""
    low = {c.lower() for c in taken}
    return [x for k in range(len(low) + n) if (x := f"_sg_{k}") not in low][:n]


def light(df: DataFrame, rows: int) -> DataFrame:
    """df in no more partitions than so many rows of numbers need: a shuffle of few rows is read by few tasks, whatever the session's number of partitions."""
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))


def known_few(df: DataFrame, rows: int) -> DataFrame:
    """df, which has so many rows at most, to be broadcast if these are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
