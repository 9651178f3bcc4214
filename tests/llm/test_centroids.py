import hashlib
import math
import random

import numpy as np

from strataglyph.llm.centroids import cluster, nearest


def brute(rows, k, rounds, scale):
    """Plain k-means over Python integers."""
    v = [(i, [math.floor(scale * x) for x in xs]) for i, xs in rows]
    hashed = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), xs) for i, xs in v if i is not None)
    centroids = [xs for _, xs in hashed[:k]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(xs, c, strict=True)), j) for j, c in enumerate(centroids)) for _, xs in v]

    for _ in range(rounds):
        where = assigned()
        for j in range(len(centroids)):
            own = [xs for (_, c), (_, xs) in zip(where, v, strict=True) if c == j]
            if own:
                centroids[j] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    where = assigned()
    of = lambda n: n if n < 1 << 63 else None
    total = [sum(d for d, c in where if c == j) for j in range(len(centroids))]
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(map(str, ((i, c, of(d), of(total[c]), of(sum(total)), shas[c]) for (i, _), (d, c) in zip(v, where, strict=True))))


def table(spark, rows):
    return spark.createDataFrame([(i, x, "a", 1) for i, x in rows], "vec_id long, embedding array<double>, cluster string, n int").repartition(3)


def test_against_plain_integers(spark):
    r = random.Random(7)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    rows += [(i, rows[5][1]) for i in range(400, 420)] + [(5, rows[5][1]), (5, rows[6][1]), (None, rows[9][1])]
    bad = [(900, None), (901, [1.0] * 5), (902, []), (903, [None] + [1.0] * 5), (904, [math.nan] * 6), (905, [math.inf] * 6), (906, [1e308] * 6)]
    got = cluster(table(spark, rows + bad), k=12, rounds=4, dim=6)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(str(tuple(x)) for x in got.collect()) == brute(rows, 12, 4, 256)


def test_large_components_are_measured_with_integers(spark):
    r = random.Random(8)
    rows = [(i, [r.choice((1, 2.0**20, 2.0**30, 2.0**70)) * r.gauss(0, 1) for _ in range(3)]) for i in range(60)]
    got = cluster(table(spark, rows), k=5, rounds=3, dim=3)
    assert sorted(str(tuple(x)) for x in got.collect()) == brute(rows, 5, 3, 256)


def test_the_bound_keeps_float64_exact():
    r = np.random.default_rng(9)
    for most in (2**20, 2**23, 2**24, 2**25, 2**27):
        v = r.integers(-most, most, (200, 64)).astype(np.float64)
        centroids = r.integers(-most, most, (10, 64)).tolist()
        where, far = nearest(v, centroids)
        for x, c, d in zip(v.astype(int).tolist(), where.tolist(), far.tolist(), strict=True):
            assert (d, c) == min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), j) for j, y in enumerate(centroids))


def test_few_and_none(spark):
    assert cluster(table(spark, [])).count() == 0
    assert cluster(table(spark, [(None, [1.0, 2.0])]), dim=2).count() == 0
    got = cluster(table(spark, [(1, [0.5, -0.5]), (2, [0.5, -0.5])]), dim=2).collect()
    assert [(x.distance, x.inertia, x.cluster) for x in got] == [(0, 0, 0)] * 2
