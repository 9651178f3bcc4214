import math
import random

from pyspark.sql import functions as F

from strataglyph.llm import topk
from strataglyph.llm.topk import search


def test_against_brute_force(spark):
    r = random.Random(6)
    vectors = {i: [r.gauss(0, 1) for _ in range(8)] for i in range(120)}
    for i in range(60, 80):  # copies, so that scores tie
        vectors[i] = vectors[10]
    rows = [(i, v, 1, 2) for i, v in vectors.items()] + [(500, None, 1, 2), (550, [1.0, None] * 4, 1, 2), (600, [math.nan] * 8, 1, 2), (650, [math.inf] * 8, 1, 2), (None, [0.5] * 8, 1, 2), (700, [], 1, 2), (3, vectors[3], 1, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score int")
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in search(df, F.col("vec_id") % 10 == 0).collect())
    import numpy as np

    q = {i: [math.floor(256 * float(np.float32(c))) for c in v] for i, v in vectors.items()}
    want = []
    for a in vectors:
        if a % 10 == 0:
            best = sorted(((-sum(x * y for x, y in zip(q[a], q[b], strict=True)), b) for b in vectors if b != a))[:5]
            want += [(a, k + 1, b, -s) for k, (s, b) in enumerate(best)]
    assert got == sorted(want)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, -1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in search(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, -65536)]
    assert search(df.limit(0), F.lit(True)).count() == 0
    assert search(df.filter("vec_id = 0"), F.lit(True)).count() == 0


def test_blocks_are_packed_and_exchanged(spark, monkeypatch):
    """Copies of blocks don't pass through the driver, and a component takes the bytes that it needs."""
    plans, paired = [], topk._paired
    monkeypatch.setattr(topk, "BLOCK", 32)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    monkeypatch.setattr(topk, "TILE", 3)
    monkeypatch.setattr(topk, "_paired", lambda *blocks: plans.append(paired(*blocks)) or plans[-1])
    rows = [(i, [((i * 37 + k * 11) % 101) / 101 - 0.5 for k in range(6)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in search(df, F.col("vec_id") % 10 == 0).collect())
    v = {x.vec_id: x.v for x in topk.quantised(df).collect()}
    score = lambda a, b: sum(x * y for x, y in zip(v[a], v[b], strict=True))
    want = {a: sorted((-score(a, b), b) for b in v if b != a)[:5] for a in v if a % 10 == 0}
    assert got == sorted((a, k + 1, b, -s) for a, best in want.items() for k, (s, b) in enumerate(best))
    assert len(plans) == 2
    for plan in plans:
        assert "SortMergeJoin [j#" in plan._jdf.queryExecution().executedPlan().toString()
    cell = plans[0].select("c.ids", "c.x").first()
    assert len(cell.x) == len(cell.ids) // 8 * 3  # three components a list, a byte each
