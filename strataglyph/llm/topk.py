"""Exact top-k search by a three-phase uniform threshold.

A vector's dimensions are dealt to a few lists. A list is held and scored for
itself, in cells of a block of candidates and a block of queries; a score is the
sum of a candidate's local scores over the lists. Phase one gathers every
list's best entries for each query and looks the exact scores of these few
candidates up; the k-th best of them is a lower bound. Its uniform share, told
to all lists, is a safe cutoff: whatever misses it everywhere cannot be among
the best. Phase two collects each list's entries at or above it, joins them by
query and candidate, and drops candidates whose upper bound stays below the new
k-th lower bound. Phase three resolves the exact scores of what is left.

Local scores may be negative, so each is taken above its list's least for the
query. Equal vectors are one candidate (with its smallest ids) and one query,
so copies multiply no work. A cell meets one block of either side, so no key
gathers more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .workspace import Workspace, table

LISTS = 2
#: Vectors in a block of candidates, and of queries, about; queries that are scored at a time.
BLOCK, QUERY_BLOCK, TILE = 8192, 4096, 512


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component; rows with a null id, a null vector, or null or non-finite components, go."""
    x = F.col("embedding").cast("array<double>")
    finite = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.filter(F.coalesce(finite, F.lit(False)) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _classes(rows: DataFrame, ids: int, salts: int = 16) -> DataFrame:
    """One row a distinct vector: v, and its ``ids`` smallest ids in order; found under a salt first, as one vector may fill a third of the table."""
    salted = Window.partitionBy("v", "salt").orderBy("vec_id")
    some = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts))).withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= ids)
    whole = Window.partitionBy("v").orderBy("vec_id")
    few = some.withColumn("r", F.row_number().over(whole)).filter(F.col("r") <= ids)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("cid", F.col("ids")[0])


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest type that holds them."""
    least, most = (int(x.min()), int(x.max())) if x.size else (0, 0)
    return x.astype(np.result_type(np.min_scalar_type(min(least, -1)), np.min_scalar_type(most if most < 0 else -most - 1)))


def _blocks(rows: DataFrame, size: int, name: str, cuts: list[slice]) -> tuple[DataFrame, int]:
    """Rows (cid, v, and maybe floors and share) as blocks of a list each: j, number, and packed bytes of its rows with the list's components; and how many numbers there are. Rows are dealt by number and packed as they stream by."""
    count = max(1, -(-rows.count() // size))
    asking = "share" in rows.columns

    def packed(number: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        told = pa.Table.from_batches(parts).combine_chunks()
        ids = told["cid"].to_numpy()
        x = told["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        shares = told["share"].to_numpy() if asking else np.empty(0, np.int64)
        floors = told["floors"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), len(cuts)) if asking else np.empty((0, len(cuts)), np.int64)
        cells = [{"ids": ids.tobytes(), "x": (own := _narrow(x[:, cut])).tobytes(), "kind": own.dtype.str, "share": shares.tobytes(), "floor": floors[:, j].tobytes()} for j, cut in enumerate(cuts)]
        kind = pa.struct([("ids", pa.binary()), ("x", pa.binary()), ("kind", pa.string()), ("share", pa.binary()), ("floor", pa.binary())])
        return pa.RecordBatch.from_arrays([pa.array(range(len(cuts)), pa.int32()), pa.array([number] * len(cuts), pa.int32()), pa.array(cells, kind)], names=["j", f"{name}b", name])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
            for lo, hi in pairwise(edges) if len(numbers) else ():
                # a number that many rows share is more than one block
                if held and (numbers[lo] != at or sum(map(len, held)) >= 2 * size):
                    yield packed(at, held)
                    held = []
                at = int(numbers[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield packed(at, held)

    dealt = rows.withColumn("b", F.pmod(F.xxhash64("cid"), F.lit(count)).cast("int")).repartition(F.col("b")).sortWithinPartitions("b")
    return dealt.select("b", *rows.columns).mapInArrow(pack, f"j int, {name}b int, {name} struct<ids:binary,x:binary,kind:string,share:binary,floor:binary>"), count


def _ids(cell: dict) -> np.ndarray:
    return np.frombuffer(cell["ids"], np.int64)


def _scores(q: dict, c: dict) -> Iterator[tuple[slice, np.ndarray]]:
    """Scores of a few rows of q at a time with all rows of c; single precision where that is exact."""
    x, y = (np.frombuffer(cell["x"], cell["kind"]).reshape(len(cell["ids"]) // 8, -1) for cell in (q, c))
    most = x.shape[1] * max(map(abs, (int(x.min()), int(x.max())))) * max(map(abs, (int(y.min()), int(y.max())))) if x.size else 0
    kind = np.float32 if most < 1 << 24 else np.float64
    x, y = x.astype(kind), y.astype(kind).T
    for lo in range(0, len(x), TILE):
        yield slice(lo, lo + TILE), x[lo : lo + TILE] @ y


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict, dict]]:
    for batch in batches:
        for j, q, c in zip(*batch.columns, strict=True):
            yield j.as_py(), q.as_py(), c.as_py()


def _paired(told: DataFrame, told_n: int, held: DataFrame, held_n: int) -> DataFrame:
    """(j, q, c): every block of queries beside every block of candidates, list by list. Copies of blocks are many times what their table holds, so they are exchanged, whatever a plan takes their size to be: a broadcast would gather them in the driver."""
    one = told.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(held_n - 1))))
    two = held.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(told_n - 1))))
    return one.hint("merge").join(two, ["j", "cb", "qb"]).select("j", "q", "c")


def _slices(dim: int, lists: int) -> list[slice]:
    bounds = [dim * k // lists for k in range(lists + 1)]
    return [slice(a, b) for a, b in zip(bounds, bounds[1:], strict=False)]


def _dot(x: str, y: str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0).cast("long"), lambda a, b: a + b)


def search(vectors: DataFrame, is_query, k: int = 5, lists: int = LISTS, scale: int = 256) -> DataFrame:  # noqa: ANN001
    """query_id, rank, vec_id, score for the rows that is_query (a Column over vec_id) picks.

    Ranks run from 1; ties go to the smaller vec_id; a query is no candidate of
    its own; with fewer than k candidates all come. Vectors of another length
    than the query's are no candidates of it; empty ones have score 0 with each
    other. Rows that repeat an id and a vector are one candidate, and rows of
    one id with unlike vectors are several. Rows without an id take no part. No
    rows, or none that is a query, give none. Other columns play no part,
    whatever their names. Integer products must stay below 2^53.
    """
    spark = vectors.sparkSession
    space = Workspace(spark, "topk")
    rows = space.save(quantised(vectors, scale).distinct(), "rows")
    out = None
    for (dim,) in rows.select(F.size("v")).distinct().collect():  # vectors of one table have one length, as a rule
        part = rows.filter(F.size("v") == dim)
        found = _search(Workspace(spark, "topk"), part, part.filter(is_query), dim, k, max(1, min(lists, dim)))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return out


def _search(space: Workspace, rows: DataFrame, asked: DataFrame, dim: int, k: int, lists: int) -> DataFrame:
    # a query drops itself at the end, so one more is sought
    want = k + 1
    classes = space.save(_classes(rows, want), "classes")
    queries = space.save(asked.groupBy("v").agg(F.min("vec_id").alias("cid")), "queries")
    own = space.save(asked.join(queries, "v").select(F.col("vec_id").alias("query_id"), F.col("cid").alias("q")), "own")
    by_q = queries.select(F.col("cid").alias("q"), F.col("v").alias("x"))
    by_c = classes.select(F.col("cid").alias("c"), F.col("v").alias("y"), "ids")
    cuts = _slices(dim, lists)
    held, held_n = _blocks(classes.select("cid", "v"), BLOCK, "c", cuts)
    held = space.save(held, "held")

    def cells(asking: DataFrame) -> DataFrame:
        return _paired(*_blocks(asking, QUERY_BLOCK, "q", cuts), held, held_n)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phase one: a list's best entries of a cell, and its least score there."""
        for j, q, c in _cells(batches):
            q_ids, c_ids = _ids(q), _ids(c)
            top = min(want, len(c_ids))
            for part, s in _scores(q, c):
                best = np.argpartition(s, len(c_ids) - top, axis=1)[:, len(c_ids) - top :]
                own = np.repeat(q_ids[part], top)
                entries = [own, np.full(len(own), j, np.int32), c_ids[best].ravel(), np.take_along_axis(s, best, 1).ravel().astype(np.int64), np.repeat(s.min(axis=1).astype(np.int64), top)]
                yield pa.RecordBatch.from_arrays([pa.array(e) for e in entries], names=["q", "j", "c", "s", "least"])

    first = space.save(cells(queries).mapInArrow(local, "q long, j int, c long, s long, least long"), "local")
    floors = space.save(first.groupBy("q", "j").agg(F.min("least").alias("least")), "floors")
    # what the lists told: each one's best, whose exact scores are looked up
    of_list = Window.partitionBy("q", "j").orderBy(F.desc("s"), "c")
    told = first.withColumn("r", F.row_number().over(of_list)).filter(F.col("r") <= want).select("q", "c").distinct()
    sums = told.join(by_q, "q").join(by_c, "c").select("q", _dot("x", "y").alias("total"))
    base = floors.groupBy("q").agg(F.sum("least").alias("base"), F.array_sort(F.collect_list(F.struct("j", "least"))).alias("f"))
    # the want-th best of them; none if there are fewer candidates
    kth = sums.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("total")))).filter(F.col("r") == want).select("q", "total")
    low = F.coalesce(F.col("total") - F.col("base"), F.lit(0))
    # at least the share of each of the lists, above its floor; 0 takes all
    cutoff = space.save(base.join(kth, "q", "left").select("q", F.col("f.least").alias("floors"), F.ceil(low / lists).cast("long").alias("share")), "cutoff")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phase two: a list's entries of a cell at or above the cutoff."""
        for _, q, c in _cells(batches):
            q_ids, c_ids, shares, floors = _ids(q), _ids(c), np.frombuffer(q["share"], np.int64), np.frombuffer(q["floor"], np.int64)
            for part, s in _scores(q, c):
                a, b = np.nonzero(s >= (shares[part] + floors[part])[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[part][a]), pa.array(c_ids[b]), pa.array(s[a, b].astype(np.int64) - floors[part][a])], names=["q", "c", "s"])

    asking = queries.join(cutoff, queries["cid"] == cutoff["q"]).select("cid", "v", "floors", "share")
    second = cells(asking).mapInArrow(collect, "q long, c long, s long")
    # lists that told nothing of a candidate have it below the cutoff
    joined = second.groupBy("q", "c").agg(F.sum("s").alias("low"), F.count(F.lit(1)).alias("n")).join(cutoff.select("q", "share"), "q")
    bounds = space.save(joined.select("q", "c", "low", (F.col("low") + (lists - F.col("n")) * F.greatest(F.col("share") - 1, F.lit(0))).alias("high")), "bounds")
    best = bounds.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("low")))).filter(F.col("r") == want).select("q", F.col("low").alias("bar"))
    left = bounds.join(best, "q", "left").filter(F.col("high") >= F.coalesce("bar", F.lit(0))).select("q", "c")
    # phase three: exact scores of what is left
    exact = left.join(by_q, "q").join(by_c, "c").select("q", "ids", _dot("x", "y").alias("score"))
    each = exact.select("q", "score", F.explode("ids").alias("vec_id"))
    final = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    top = space.save(each.withColumn("r", F.row_number().over(final)).filter(F.col("r") <= want).select("q", "score", "vec_id"), "top")
    # copies of a query share its answer, each without itself
    answers = own.join(top, "q").filter(F.col("vec_id") != F.col("query_id"))
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP5_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
