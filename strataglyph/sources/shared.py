"""Tables between jobs, in the folder that driver and executors share.

What must be the same each time it is read (the border of a range, a row's
place in its partition) is written once and read from there, so a lost executor
costs the tasks that it was running and changes nothing.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that is broadcast at most; a larger one is joined by an exchange.
FEW = 200_000

_made: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession, label: str = "tables") -> str:
    """A new folder below ``spark.checkpoint.dir``; below a temporary one only where that is unset and all tasks run in the driver."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="strataglyph-")
        spark.conf.set("spark.checkpoint.dir", top)
        _made.append((spark, top))
    path = f"{top.rstrip('/')}/strataglyph/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def kept(df: DataFrame, label: str = "kept", layout: dict[str, str] | None = None) -> DataFrame:
    """df, written (with the options of layout) and read again."""
    path = folder(df.sparkSession, label)
    df.write.options(**(layout or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """df, to be broadcast if it has few rows, which are counted (no further than needed)."""
    limit = FEW if most is None else most
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def file_system(spark: SparkSession, path: str):  # noqa: ANN201
    """(file system, path) of the JVM."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def delete(spark: SparkSession, path: str) -> None:
    files, where = file_system(spark, path)
    files.delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
        except Exception:  # the session may already be gone at exit
            pass
