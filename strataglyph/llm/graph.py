"""Connected components by randomised contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, known_few, light


def components(space: Workspace, edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (a, b); component is the smallest id reachable.

    In each round every node joins the neighbour (or itself) of least hash, with
    a fresh hash each round; the chains of joins are followed four steps, and
    what they lead to is one node in the next round. So paths shrink
    geometrically whatever their ids, and hubs are met by partial aggregation.
    Edges inside a contracted node go; when none is left, each is a component.
    A round takes as many tasks as its edges need: late ones are small.
    """
    pairs = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    left = space.save(light(pairs.distinct(), pairs.count()), "edges0")
    at = left.select(F.col("a").alias("id"), F.col("a").alias("at")).filter("false")
    turn = nodes = 0
    while size := left.count():
        turn += 1
        order = lambda c: F.xxhash64(F.col(c), F.lit(turn))  # noqa: E731, B023
        ends = left.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e")).select("e.v", "e.w")
        least = ends.groupBy("v").agg(F.min_by("w", F.struct(order("w"), "w")).alias("w"))
        joins = space.save(light(least.select("v", F.when(order("w") < order("v"), F.col("w")).otherwise(F.col("v")).alias("m")), 2 * size), f"joins{turn}")
        for _ in range(2):  # two steps, then four
            step = known_few(joins.select(F.col("v").alias("_v"), F.col("m").alias("_m")), 2 * size)
            joins = light(joins.join(step, joins["m"] == step["_v"], "left").select("v", F.coalesce("_m", "m").alias("m")), 2 * size)
        joins = space.save(joins, f"far{turn}")
        side = lambda c: known_few(joins.select(F.col("v").alias(c), F.col("m").alias(f"m{c}")), 2 * size)  # noqa: E731, B023
        two = light(left.join(side("a"), "a"), size).join(side("b"), "b").select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b"))
        if turn == 1:  # every node has an edge
            at, nodes = joins.select(F.col("v").alias("id"), F.col("m").alias("at")), joins.count()
        else:
            at = light(at.join(side("at"), "at", "left").select("id", F.coalesce("mat", "at").alias("at")), nodes)
        left = space.save(light(two.filter("a <> b").distinct(), size), f"edges{turn}")
    least = light(at.groupBy("at").agg(F.min("id").alias("component")), nodes)
    return light(at.join(known_few(least, nodes), "at").select("id", "component"), nodes)
