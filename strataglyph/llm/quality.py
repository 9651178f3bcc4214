"""Quality rules: text statistics and robust multivariate outliers.

Everything is built-in functions. Within a text, repeated three-word windows
are found by sorting packed (hash, position) numbers, so a text costs
n log n and no row leaves its task until it is a handful of numbers.

The estimate is a regularised minimum covariance determinant: a diagonal of
noise variances is added to each subset's covariance, as clean texts have no
symbols and hardly a repeated line and their covariance alone is singular. Of
the estimates that concentration reaches from several starts, each group takes
the one of least determinant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace, fresh, table

_SPACE = r"[ \\t\\n\\x0B\\f\\r]"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def with_statistics(docs: DataFrame, prefix: str = "") -> DataFrame:
    """Adds the STATS of ``text``, each named with the prefix, and ``base_failed``. A null text has no words."""
    p = "_sg_"
    text = docs.withColumn(f"{p}text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    words = text.withColumn(f"{p}w", F.expr(rf"filter(split({p}text, '{_SPACE}+'), x -> x <> '')"))
    counted = words.select(
        "*",
        F.expr(f"size({p}w)").alias(f"{p}n"),
        F.expr(f"cast(length(array_join({p}w, '')) as long)").alias(f"{p}chars"),
        F.expr(f"cast(length(regexp_replace({p}text, '[^#*$%&|<>]+', '')) as long)").alias(f"{p}symbols"),
        F.expr(rf"filter(split({p}text, '\\n'), l -> l rlike '[^ \\t\\n\\x0B\\f\\r]')").alias(f"{p}lines"),
        F.expr(f"case when size({p}w) >= 3 then transform(sequence(0, size({p}w) - 3), i -> xxhash64({p}w[i], {p}w[i + 1], {p}w[i + 2])) else array() end").alias(f"{p}h"),
        F.expr(f"cast(ceil(log2(size({p}w) + 2)) as int)").alias(f"{p}bits"),
    ).drop(f"{p}w", f"{p}text")
    # (hash, position) in one number, sorted: windows with equal hashes become neighbours
    packed = counted.withColumn(f"{p}s", F.expr(f"sort_array(transform({p}h, (x, i) -> shiftleft(x, {p}bits) | i))"))
    near = packed.withColumn(
        f"{p}c",
        F.expr(
            f"transform(filter({p}s, (x, i) -> (i > 0 and shiftright(x, {p}bits) = shiftright({p}s[i - 1], {p}bits))"
            f" or (i < size({p}s) - 1 and shiftright(x, {p}bits) = shiftright({p}s[i + 1], {p}bits))), x -> cast(x & (shiftleft(1L, {p}bits) - 1) as int))"
        ),
    )
    # the bits of the hash that packing dropped are compared as well
    hits = near.withColumn(
        f"{p}r",
        F.expr(f"sort_array(filter({p}c, (x, i) -> (i > 0 and {p}h[x] = {p}h[{p}c[i - 1]]) or (i < size({p}c) - 1 and {p}h[x] = {p}h[{p}c[i + 1]])))"),
    )
    repeat = F.expr(f"aggregate({p}r, struct(-3 as last, 0L as total), (a, x) -> struct(x as last, a.total + least(3, x - a.last) as total), a -> a.total)")
    out = hits.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.col(f"{p}n").cast("long").alias(f"{prefix}n_words"),
        F.col(f"{p}chars").alias(f"{prefix}word_chars"),
        F.col(f"{p}symbols").alias(f"{prefix}n_symbols"),
        F.expr(f"cast(size({p}lines) - size(array_distinct({p}lines)) as long)").alias(f"{prefix}n_dup_lines"),
        repeat.cast("long").alias(f"{prefix}n_repeat_words"),
    )
    n, r = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return out.withColumn(f"{prefix}base_failed", (n < 50) | (100 * r > 50 * n))


# Minimum covariance determinant ------------------------------------------------

#: Standard deviations below which a feature's spread is not told from noise: the diagonal that regularises.
NOISE = (0.08, 0.35, 0.6, 0.2, 0.7)
DIM = len(NOISE)
#: Share of a group that the estimate rests on, and the factor that makes its covariance consistent for it.
SHARE, CONSISTENCY = 0.75, 1.41
#: Concentration steps of each start, and the starts: from the median under noise scales, under the group's own quartile ranges, and from quartiles of length and symbols.
STEPS, STARTS = 4, 4
#: Buckets of a squared distance up to its doubling; a bucket that the subset's edge cuts counts in part.
FINE = 16
#: Upper quantiles of chi-square with five degrees: 0.975 for reweighting, 1 - 1e-5 for rejection.
REWEIGHT, REJECT = 12.83, 30.86
#: Smaller groups take the estimate of their language, or else of all texts.
LEAST = 50
#: Rows of group estimates up to which they are broadcast.
BROADCAST_ROWS = 20_000


def features(prefix: str = "") -> list[Column]:
    n, chars, symbols, lines, repeats = (F.greatest(F.col(f"{prefix}{c}"), F.lit(0)).cast("double") for c in STATS)
    n = F.greatest(n, F.lit(1.0))
    chars = F.greatest(chars, F.lit(1.0))
    return [F.log(chars / n), F.log1p(100 * symbols / chars), F.log1p(100 * lines / n), F.sqrt(repeats / n), F.log(n)]


def _attach(rows: DataFrame, small: DataFrame, key: list[str]) -> DataFrame:
    """rows (with _sg_id, a hash) with the one row of small that has their key: broadcast if small has few rows, else joined under a salt."""
    if small.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), key)
    salted = rows.withColumn("_sg_salt", F.pmod("_sg_id", F.lit(32)).cast("int"))
    return salted.join(small.withColumn("_sg_salt", F.explode(F.sequence(F.lit(0), F.lit(31)))), [*key, "_sg_salt"]).drop("_sg_salt")


def _distance() -> Column:
    """Squared Mahalanobis distance of _sg_f from centre _sg_mu under the Cholesky factor _sg_l, row by row."""
    z: list[Column] = []
    for i in range(DIM):
        rest = F.col("_sg_f")[i] - F.col("_sg_mu")[i]
        for j in range(i):
            rest = rest - F.col("_sg_l")[i * (i + 1) // 2 + j] * z[j]
        z.append(rest / F.col("_sg_l")[i * (i + 1) // 2 + i])
    return sum((x * x for x in z[1:]), z[0] * z[0])


def _factor(moments: DataFrame, factor: float) -> DataFrame:
    """Centre, Cholesky factor and log determinant from sums: _sg_g, _sg_s, _sg_size, _sg_mu, _sg_l, _sg_det."""
    mu = [F.col(f"s{i}") / F.col("n") for i in range(DIM)]
    out = moments.select("_sg_g", "_sg_s", "_sg_size", *[m.alias(f"m{i}") for i, m in enumerate(mu)], *[(factor * F.greatest(F.col(f"q{i}_{j}") / F.col("n") - mu[i] * mu[j], F.lit(0.0 if i == j else float("-inf"))) + (NOISE[i] ** 2 if i == j else 0.0)).alias(f"c{i}_{j}") for i in range(DIM) for j in range(i + 1)])
    for i in range(DIM):
        for j in range(i + 1):
            rest = F.col(f"c{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            out = out.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(rest, F.lit(NOISE[i] ** 2 / 4))) if i == j else rest / F.col(f"l{j}_{j}"))
    det = sum((2 * F.log(f"l{i}_{i}") for i in range(DIM)), F.lit(0.0))
    return out.select("_sg_g", "_sg_s", "_sg_size", F.array(*[f"m{i}" for i in range(DIM)]).alias("_sg_mu"), F.array(*[f"l{i}_{j}" for i in range(DIM) for j in range(i + 1)]).alias("_sg_l"), det.alias("_sg_det"))


def _starts(spread: DataFrame) -> DataFrame:
    """The first estimates of every group, STARTS of them."""
    at = [0.25, 0.5, 0.75]
    quartiles = spread.groupBy("_sg_g").agg(F.count(F.lit(1)).alias("_sg_size"), F.array(*[F.percentile_approx(F.col("_sg_f")[i], F.array(*map(F.lit, at)), 1000) for i in range(DIM)]).alias("p"))
    diagonal = lambda scales: F.array(*[scales[i] if i == j else F.lit(0.0) for i in range(DIM) for j in range(i + 1)])
    noise = [F.lit(x) for x in NOISE]
    own = [F.greatest((F.col("p")[i][2] - F.col("p")[i][0]) / 1.349, F.lit(NOISE[i] / 8)) for i in range(DIM)]
    centre = lambda which: F.array(*[F.col("p")[i][which.get(i, 1)] for i in range(DIM)])
    starts = ((centre({}), noise), (centre({}), own), (centre({1: 0, 4: 0}), noise), (centre({1: 0, 4: 2}), noise))[:STARTS]
    each = F.array(*[F.struct(F.lit(k).alias("_sg_s"), mu.alias("_sg_mu"), diagonal(scales).alias("_sg_l")) for k, (mu, scales) in enumerate(starts)])
    return quartiles.withColumn("e", F.explode(each)).select("_sg_g", "e._sg_s", "_sg_size", "e._sg_mu", "e._sg_l", F.lit(0.0).alias("_sg_det"))


def fit(space: Workspace, rows: DataFrame) -> DataFrame:
    """Estimates for every group of rows (_sg_id, _sg_keys: its groups' names, _sg_f: features): _sg_g, _sg_size, _sg_mu, _sg_l.

    Concentration steps from deterministic starts, all at once, then one step
    of reweighting from the start that ends at the least determinant. Each step
    is one grouped aggregation: moments by group, start and fine bucket of the
    distance, so that the closest SHARE of a group is the sum of its first
    buckets, whatever the group's size. A group's rows are summed where they
    are before any is moved, so that a group of a third of all rows is a few
    rows a task.
    """
    from pyspark.sql.window import Window

    spread = rows.select("_sg_id", F.explode("_sg_keys").alias("_sg_g"), "_sg_f")
    estimate = space.save(_starts(spread), "estimate0")
    names = ["n", *[f"s{i}" for i in range(DIM)], *[f"q{i}_{j}" for i in range(DIM) for j in range(i + 1)]]
    for step in range(1, STEPS + 2):
        last = step == STEPS + 1
        if last:
            best = F.min_by(F.struct("_sg_size", "_sg_mu", "_sg_l"), F.struct("_sg_det", "_sg_s")).alias("e")
            estimate = space.save(estimate.groupBy("_sg_g").agg(best).select("_sg_g", F.lit(0).alias("_sg_s"), "e.*"), "least")
        seen = _attach(spread, estimate, ["_sg_g"]).withColumn("_sg_d", _distance())
        bucket = (F.col("_sg_d") > REWEIGHT).cast("int") if last else F.floor(FINE * F.log2(1 + F.col("_sg_d"))).cast("int")
        sums = [F.count(F.lit(1)).cast("double").alias("n"), F.max("_sg_size").alias("_sg_size"), *[F.sum(F.col("_sg_f")[i]).alias(f"s{i}") for i in range(DIM)], *[F.sum(F.col("_sg_f")[i] * F.col("_sg_f")[j]).alias(f"q{i}_{j}") for i in range(DIM) for j in range(i + 1)]]
        parts = seen.withColumn("_sg_b", bucket).groupBy("_sg_g", "_sg_s", "_sg_b").agg(*sums)
        before = F.coalesce(F.sum("n").over(Window.partitionBy("_sg_g", "_sg_s").orderBy("_sg_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        # how much of a bucket the subset takes
        taken = F.when(F.col("_sg_b") == 0, 1.0).otherwise(0.0) if last else F.least(F.lit(1.0), (F.ceil(SHARE * F.col("_sg_size")) - F.col("before")) / F.col("n"))
        inner = parts.withColumn("before", before).withColumn("w", taken).filter("w > 0")
        moments = inner.groupBy("_sg_g", "_sg_s").agg(F.max("_sg_size").alias("_sg_size"), *[F.sum(F.col("w") * F.col(c)).alias(c) for c in names])
        estimate = space.save(_factor(moments, 1.0 if last else CONSISTENCY), f"estimate{step}")
    return estimate.drop("_sg_s", "_sg_det")


def judge(docs: DataFrame, prefix: str = "", carry: list[str] | None = None) -> DataFrame:
    """All rows of docs with its columns (or those in carry) and the STATS, base_failed, distance2 and kept, named with the prefix.

    A row that fails the base rules, as null and empty texts do, is not kept,
    and takes no part in the estimates; its distance is null. Null lang and null
    source are groups like any other. Rows that repeat are judged alike, and
    each counts in its group. Texts of any length are taken whole. An empty
    table stays empty. A column of docs that is named like an added one gives
    way to it; any other name may be used.
    """
    space = Workspace(docs.sparkSession, "quality")
    added = [f"{prefix}{c}" for c in (*STATS, "base_failed", "distance2", "kept")]
    own = [c for c in (docs.columns if carry is None else carry) if c.lower() not in {a.lower() for a in added}]
    row = F.struct(*[F.col(f"`{c}`") for c in own]) if own else F.lit(None).cast("struct<none:int>")
    safe = docs.select(row.alias("row"), "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    known = with_statistics(safe)
    group = F.to_json(F.struct("lang", "source"))
    language = F.to_json(F.struct(F.col("lang").alias("only")))
    number = F.xxhash64("text", "lang", "source", *STATS)
    keyed = known.withColumn("_sg_keys", F.array(group, language, F.lit("all"))).withColumn("_sg_f", F.array(*features())).withColumn("_sg_id", number)
    stats = [*STATS, "base_failed"]
    kept = space.save(keyed.select("row", *stats, "_sg_keys", "_sg_f", "_sg_id"), "statistics")
    fair = kept.filter("not base_failed").select("_sg_id", "_sg_keys", "_sg_f")
    estimates = fit(space, fair)
    # the finest group of a row that has enough rows
    sizes = estimates.filter((F.col("_sg_size") >= LEAST) | (F.col("_sg_g") == "all"))
    cells = fair.select(F.col("_sg_keys")[0].alias("_sg_cell"), "_sg_keys").groupBy("_sg_cell").agg(F.first("_sg_keys").alias("_sg_keys"))
    tried = cells.select("_sg_cell", F.posexplode("_sg_keys").alias("_sg_rank", "_sg_g")).join(sizes, "_sg_g")
    best = space.save(tried.groupBy("_sg_cell").agg(F.min_by(F.struct("_sg_mu", "_sg_l"), "_sg_rank").alias("_sg_e")).select("_sg_cell", "_sg_e._sg_mu", "_sg_e._sg_l"), "best")
    good = _attach(kept.filter("not base_failed").withColumn("_sg_cell", F.col("_sg_keys")[0]), best, ["_sg_cell"])
    good = good.withColumn("distance2", _distance()).select("row", *stats, "distance2", (F.col("distance2") <= REJECT).alias("kept"))
    bad = kept.filter("base_failed").select("row", *stats, F.lit(None).cast("double").alias("distance2"), F.lit(False).alias("kept"))
    both = good.unionByName(bad)
    return both.select(*[F.col("row").getField(c).alias(c) for c in own], *[F.col(c).alias(f"{prefix}{c}") for c in (*stats, "distance2", "kept")])


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that pass, with the columns that docs had."""
    (prefix,) = fresh(docs.columns, 1)
    return judge(docs, f"{prefix}_").filter(F.col(f"{prefix}_kept")).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source"), carry=["doc_id"])
