"""Table functions for SQL over a store: tokens with their offsets, ranges, and running offsets by partition.

They are called beside a table with LATERAL, or over one with TABLE(...)
PARTITION BY. Python sees a row, or the rows of a partition a batch after the
other; no call holds more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf, udtf

from .refs import RefError, RefRange

_TOKEN = re.compile(r"\S+")


@udtf(returnType="position int, token string, start long, stop long")
class Tokens:
    """tokens_of(text): each run of anything but white space, from 1, with its code points [start, stop); none of a null."""

    def eval(self, text: str | None) -> Iterator[tuple[int, str, int, int]]:
        for k, m in enumerate(_TOKEN.finditer(text or ""), 1):
            yield k, m[0], m.start(), m.end()


@udtf(returnType="first_surah int, first_ayah int, last_surah int, last_ayah int, level string")
class Range:
    """range_of(text): the ends of a reference or a range of them; none of a string that is neither. Ayahs of a whole surah are null."""

    def eval(self, text: str | None) -> Iterator[tuple[int, int | None, int, int | None, str]]:
        try:
            r = RefRange.parse(text or "")
        except RefError:
            return
        yield r.start.surah, r.start.ayah, r.end.surah, r.end.ayah, r.start.level


@arrow_udtf(returnType="id long, start long, stop long")
class Offsets:
    """offsets_of(TABLE(id, length) PARTITION BY ... ORDER BY ...): where each row's text stands when those of its partition are joined by single characters. It takes the rows of a partition a batch at a time."""

    def __init__(self) -> None:
        self.at = 0

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        if rows.column("length").null_count:
            raise TypeError("a length is null")
        length = rows.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
        begins = self.at + np.cumsum(length + 1) - (length + 1)
        if len(length):
            self.at = int(begins[-1] + length[-1] + 1)
        yield pa.table({"id": rows.column("id").cast(pa.int64()), "start": pa.array(begins, pa.int64()), "stop": pa.array(begins + length, pa.int64())})


def register(spark: SparkSession) -> None:
    """Makes tokens_of, range_of, offsets_of and members_of(first, last), the ids from first to last, callable from SQL."""
    for name, function in (("tokens_of", Tokens), ("range_of", Range), ("offsets_of", Offsets)):
        spark.udtf.register(name, function)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION members_of(first BIGINT, last BIGINT) RETURNS TABLE(id BIGINT) RETURN SELECT col FROM explode(sequence(first, last))")
