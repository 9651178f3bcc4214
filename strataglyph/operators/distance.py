"""Pairwise distances of editions, and who is nearest to whom."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(texts: DataFrame) -> DataFrame:
    """(a, b, distance) for all pairs of editions that share a unit, each with itself too: units whose rasm differs.

    texts: edition, unit, rasm. A unit's spellings meet in one row, as a digest
    each: editions are few and declared, so a unit has few. Each pair is counted
    once there, and both ways only in the sums.
    """
    one = F.struct("edition", F.xxhash64(F.lit(1), "rasm").alias("x"), F.xxhash64(F.lit(2), "rasm").alias("y"))
    units = texts.filter(F.col("rasm").isNotNull()).groupBy("unit").agg(F.array_sort(F.collect_list(one)).alias("e"))
    pairs = units.select(F.explode(F.expr("flatten(transform(e, (p, i) -> transform(slice(e, i + 1, size(e)), q -> struct(p.edition as a, q.edition as b, if(p.x = q.x and p.y = q.y, 0L, 1L) as apart))))")).alias("p"))
    half = pairs.groupBy("p.a", "p.b").agg(F.sum("p.apart").alias("distance"))
    both = half.select("a", "b", "distance", F.explode(F.when(F.col("a") == F.col("b"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("turn"))
    return both.select(F.when(F.col("turn"), F.col("b")).otherwise(F.col("a")).alias("a"), F.when(F.col("turn"), F.col("a")).otherwise(F.col("b")).alias("b"), "distance")


def intensity(distances: DataFrame) -> DataFrame:
    """Adds how strongly a pair is coloured: 1 less its share of the largest distance; null where all distances are 0."""
    most = distances.agg(F.max("distance").alias("_most"))
    return distances.join(F.broadcast(most)).withColumn("intensity", 1 - F.col("distance") / F.nullif("_most", F.lit(0))).drop("_most")


def nearest(distances: DataFrame) -> DataFrame:
    """Each edition's nearest other one; ties go to the first in edition order."""
    return distances.filter("a <> b").groupBy("a").agg(F.min(F.struct("distance", "b")).alias("m")).select("a", F.col("m.b").alias("nearest"), F.col("m.distance").alias("distance"))


def mutual(nearest_: DataFrame) -> DataFrame:
    """Undirected pairs of an edition and its nearest, each once."""
    return nearest_.select(F.least("a", "nearest").alias("first"), F.greatest("a", "nearest").alias("second")).distinct()
