"""Centroid clustering of integer vectors, exact in float64.

Vectors become blocks: a matrix of integers in the narrowest type that holds
it, with its ids. A round tells every task the centroids, which are k vectors,
and finds the nearest ones of a block as |x|^2 - 2 x.c + |c|^2 with one matrix
product. Every term and partial sum of it is an integer; as long as
dim * (|x| + |c|)^2, by the largest component of a row and of the centroids,
stays below 2^53, float64 holds all of them exactly, in whatever order BLAS
adds them. Rows beyond that bound are measured with Python's integers. Sums and
counts by cluster, which are k rows whatever a block holds, meet in
``treeAggregate``; no vector is shuffled, and no cluster is ever in one place.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .memory import turn_to
from .workspace import Workspace, table

K, ROUNDS, DIM, SCALE, SALT = 40, 5, 64, 256, "2:"
#: Vectors of a block at most.
BLOCK = 4096
#: Float64 holds every integer below it.
EXACT = 1 << 53
_WIDTHS = (np.int16, np.int32, np.float64)
_OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def kept(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id, x (array<double>): rows with exactly dim components, none null or not finite, not even scale times."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < F.lit(float("inf"))))
    return vectors.filter(F.coalesce((F.size(x) == dim) & finite, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def blocks(rows: DataFrame, dim: int, scale: int) -> DataFrame:
    """Rows (vec_id, x) as blocks: n, width (of the components' type), v and ids; a null id is kept apart as a bit."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to(None)
        for whole in batches:
            for at in range(0, len(whole), BLOCK):
                part = whole.slice(at, BLOCK)
                ids = part.column(0)
                v = np.floor(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(part), dim) * scale)
                most = np.abs(v).max(initial=0)
                kind = next(k for k, w in enumerate(_WIDTHS) if w is np.float64 or most <= np.iinfo(w).max)
                columns = [[len(part)], [kind], [v.astype(_WIDTHS[kind]).tobytes()], [ids.fill_null(0).to_numpy(zero_copy_only=False).tobytes()], [np.packbits(ids.is_valid().to_numpy(zero_copy_only=False)).tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["n", "kind", "v", "ids", "there"])

    return rows.mapInArrow(pack, "n int, kind int, v binary, ids binary, there binary")


def _matrix(n: int, kind: int, v: bytes) -> np.ndarray:
    """A block's integers, as float64."""
    flat = np.frombuffer(v, _WIDTHS[kind])
    return flat.reshape(n, len(flat) // n).astype(np.float64)


def nearest(v: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, list[int] | np.ndarray]:
    """(cluster, squared distance) of each row of v, whole numbers in float64; the smaller number wins a tie."""
    most_c = max(max(map(abs, c), default=0) for c in centroids)
    dim = max(1, v.shape[1])
    # (|x| + |c|)^2 dim < 2^53, with a margin for the rounding of this very bound
    reach = math.isqrt((EXACT - 1) // dim) - most_c - 1
    safe = np.abs(v).max(axis=1, initial=0) <= reach
    if safe.all():
        return _gemm(v, centroids)
    where, far = np.empty(len(v), np.int32), np.empty(len(v), object)
    if safe.any():
        where[safe], far[safe] = _gemm(v[safe], centroids)
    for i in np.flatnonzero(~safe):
        x = [int(a) for a in v[i]]
        far[i], where[i] = min((sum((a - b) * (a - b) for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(centroids))
    return where, far


def _gemm(v: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    c = np.array(centroids, np.float64)
    square = (v * v).sum(axis=1)[:, None] - 2.0 * (v @ c.T) + (c * c).sum(axis=1)
    where = square.argmin(axis=1)
    return where.astype(np.int32), np.take_along_axis(square, where[:, None], 1)[:, 0].astype(np.int64)


def _sums(v: np.ndarray, where: np.ndarray, k: int) -> list[list[int] | None]:
    """By cluster: the count and then the sum of every component; None for a cluster that no row has."""
    out: list[list[int] | None] = [None] * k
    small = np.abs(v).max(initial=0) * len(v) < EXACT
    for c in np.unique(where):
        own = v[where == c]
        out[c] = [len(own), *(own.sum(axis=0).astype(np.int64).tolist() if small else (sum(int(a) for a in column) for column in own.T))]
    return out


def _added(one: list[list[int] | None], two: list[list[int] | None]) -> list[list[int] | None]:
    return [a if b is None else b if a is None else [x + y for x, y in zip(a, b, strict=True)] for a, b in zip(one, two, strict=True)]


def _gathered(held: DataFrame, told: Broadcast, final: bool) -> list[list[int] | None]:
    """By cluster of the told centroids: count and sums of components, or of distances in the last round."""
    k = len(told.value)

    def block(so_far: list[list[int] | None], row) -> list[list[int] | None]:  # noqa: ANN001
        v = _matrix(row.n, row.kind, row.v)
        where, far = nearest(v, told.value)
        if not final:
            return _added(so_far, _sums(v, where, k))
        # distances of float64 are below 2^53, and a block has few rows
        return _added(so_far, [[len(own), int(own.sum())] if len(own := far[where == c]) else None for c in range(k)])

    return held.select("n", "kind", "v").rdd.treeAggregate([None] * k, block, _added)


def starts(rows: DataFrame, k: int, scale: int, salt: str) -> list[list[int]]:
    """The components of the k rows with the smallest hash of salt and id; of one id, the smaller vector comes first. Rows without an id start none."""
    hashed = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    first = rows.filter(F.col("vec_id").isNotNull()).select(hashed.alias("h"), "x").orderBy("h", "x").limit(k)
    return [[math.floor(a * scale) for a in r.x] for r in first.collect()]


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, salt: str = SALT) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every kept row.

    The first centroids are the k kept rows of least hash, or as many as there
    are. A round assigns all rows and replaces each centroid that has any by
    the floor of their mean; then rows are assigned once more. Rows of another
    length than dim, null vectors and those with null or non-finite components
    don't come back. Rows that repeat count as often as they do. A row without
    an id is clustered but starts no centroid; a table without ids, and an
    empty one, give no rows. A distance or inertia beyond a long is null. Other
    columns play no part, whatever their names.
    """
    spark = vectors.sparkSession
    space = Workspace(spark, "centroids")
    rows = kept(vectors, dim, scale)
    centroids = starts(rows, k, scale, salt)
    if not centroids:
        return spark.createDataFrame([], _OUT)
    held = space.save(blocks(rows, dim, scale), "blocks")
    for _ in range(rounds):
        told = spark.sparkContext.broadcast(centroids)
        sums = _gathered(held, told, final=False)
        centroids = [c if s is None else [a // s[0] for a in s[1:]] for c, s in zip(centroids, sums, strict=True)]
        told.destroy()
    told = spark.sparkContext.broadcast(centroids)
    inertias = [0 if s is None else s[1] for s in _gathered(held, told, final=True)]
    of_long = lambda n: int(n) if n < 1 << 63 else None
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    clusters, inertia = list(map(of_long, inertias)), of_long(sum(inertias))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to(None)
        for batch in batches:
            for n, kind, v, ids, there in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                where, far = nearest(_matrix(n, kind, v), told.value)
                missing = ~np.unpackbits(np.frombuffer(there, np.uint8), count=n).astype(bool)
                at = where.tolist()
                columns = [pa.array(np.frombuffer(ids, np.int64), pa.int64(), mask=missing), pa.array(where, pa.int32()), pa.array([of_long(d) for d in far.tolist()], pa.int64()), pa.array([clusters[c] for c in at], pa.int64()), pa.array([inertia] * n, pa.int64()), pa.array([shas[c] for c in at], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _OUT.split(", ")])

    return held.mapInArrow(assign, _OUT)


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _round_sql(n: int) -> str:
    """Rows assigned to the centroids of round n, and the centroids that follow."""
    return f"""
a{n} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
  SELECT v.r, t.c, list_sum(list_transform(list_zip(v.e, t.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v CROSS JOIN c{n} t) GROUP BY r),
c{n + 1} AS MATERIALIZED (SELECT t.c, coalesce(m.e, t.e) AS e FROM c{n} t LEFT JOIN (
  SELECT c, list(floor_mean ORDER BY i) AS e FROM (
    SELECT c, i, (s - ((s % n + n) % n)) // n AS floor_mean FROM (
      SELECT a.c, i, sum(v.e[i])::BIGINT AS s, count(*) AS n FROM a{n} a JOIN v USING (r) CROSS JOIN range(1, {DIM + 1}) x(i) GROUP BY a.c, i)) GROUP BY c) m USING (c))"""


OP12_SQL = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SALT}' || vec_id), e) - 1 AS c, e FROM v WHERE vec_id IS NOT NULL QUALIFY c < {K}),{",".join(map(_round_sql, range(ROUNDS + 1)))}
SELECT v.vec_id, a.c::INTEGER AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(t.e, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN v USING (r) JOIN c{ROUNDS} t ON t.c = a.c
"""
