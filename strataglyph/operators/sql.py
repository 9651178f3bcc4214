"""Read-only SQL over the store's tables."""

from __future__ import annotations

from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame, SparkSession


def register(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def read_only(spark: SparkSession, query: str) -> DataFrame:
    """The query's result. Anything that is no query (commands, DDL, inserts) is refused before it is analysed, so it has no effect."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    logical = "org.apache.spark.sql.catalyst.plans.logical."
    stack = [plan]
    while stack:
        node = stack.pop()
        if any(is_instance_of(spark.sparkContext._gateway, node, logical + kind) for kind in ("Command", "ParsedStatement")):
            raise ValueError("only queries are allowed here")
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return spark.sql(query)


def first_rows(df: DataFrame, limit: int = 50) -> tuple[list, bool]:
    """The first rows, and whether there are more."""
    rows = df.limit(limit + 1).collect()
    return rows[:limit], len(rows) > limit
