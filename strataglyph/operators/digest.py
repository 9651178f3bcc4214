"""Digests of table contents that don't depend on the order of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tables without content of their own.
LEFT_OUT = ("build", "postings", "term")


def row_hashes(df: DataFrame) -> DataFrame:
    return df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256).alias("h"))


def table_digest(df: DataFrame, name: str) -> DataFrame:
    """(name, rows, digest): sums of the words of the rows' SHA-256 digests, modulo 2^128 by parts; partial sums make it one small row a task."""
    words = [F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)") for k in range(8)]
    summed = row_hashes(df).agg(F.count(F.lit(1)).alias("rows"), *[F.sum(w).alias(f"w{k}") for k, w in enumerate(words)])
    told = F.concat_ws(":", F.lit(name), F.col("rows").cast("string"), *[F.coalesce(F.col(f"w{k}").cast("string"), F.lit("0")) for k in range(8)])
    return summed.select(F.lit(name).alias("name"), "rows", F.sha2(told, 256).alias("digest"))


def content_digests(tables: dict[str, DataFrame], left_out: tuple[str, ...] = LEFT_OUT) -> DataFrame:
    return reduce(DataFrame.unionByName, [table_digest(df, name) for name, df in sorted(tables.items()) if name not in left_out])


def content_digest(tables: dict[str, DataFrame]) -> str:
    import hashlib

    rows = content_digests(tables).collect()
    return hashlib.sha256("".join(f"{r['name']}={r.digest};" for r in sorted(rows, key=lambda r: r["name"])).encode()).hexdigest()
