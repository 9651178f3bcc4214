"""Mixing sources to target weights by Poisson replication.

A source's rate is its target share times the wanted total over the rows it
has; each row is replicated a Poisson number of times with that mean. The
number is the inverse of the distribution at a uniform value hashed from seed
and doc_id, so that a lost task repeats its draws. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace, fresh, table

SEED = 20240607
#: Rates beyond this are drawn as sums of equal Poisson parts, as exp(-rate) would vanish.
PART = 128.0
#: Sources up to which the table of their distributions is broadcast.
BROADCAST_ROWS = 5_000


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the MD5 digest of the parts, joined by colons."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def rates(docs: DataFrame, weights: dict[str, float] | None, total: float | None, weight_of_others: float) -> DataFrame:
    """_sg_source, rate: the mean number of copies. A null source is a source of its own, named by weights[None]."""
    sizes = docs.groupBy(F.col("source").cast("string").alias("_sg_source")).agg(F.count(F.lit(1)).alias("n"))
    named = {k: float(v) for k, v in (weights or {}).items()}
    weight = F.lit(float(weight_of_others))
    for source, value in named.items():
        same = F.col("_sg_source").isNull() if source is None else F.col("_sg_source") == source
        weight = F.when(same, F.lit(value)).otherwise(weight)
    weighed = sizes.withColumn("w", weight)
    sums = weighed.agg(F.sum("w").alias("sum_w"), F.sum("n").alias("sum_n"))
    wanted = F.col("sum_n") if total is None else F.lit(float(total))
    share = F.when(F.col("sum_w") > 0, F.col("w") / F.col("sum_w")).otherwise(F.lit(0.0))
    return weighed.join(F.broadcast(sums)).select("_sg_source", (share * wanted / F.col("n")).alias("rate"))


def distributions(rate_table: DataFrame) -> DataFrame:
    """_sg_source, _sg_parts and _sg_cdf: P(X <= 0), P(X <= 1), ... of one Poisson part, far enough for any 52-bit uniform value."""
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    one = rate_table.withColumn("parts", parts).withColumn("mean", F.col("rate") / F.col("parts")).withColumn("last", F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 24).cast("int"))
    cdf = F.expr(
        "aggregate(sequence(1, last), named_struct('p', exp(-mean), 'sum', exp(-mean), 'cdf', array(exp(-mean))), "
        "(a, k) -> named_struct('p', a.p * mean / k, 'sum', a.sum + a.p * mean / k, 'cdf', concat(a.cdf, array(a.sum + a.p * mean / k))), a -> a.cdf)"
    )
    return one.select("_sg_source", F.col("parts").alias("_sg_parts"), cdf.alias("_sg_cdf"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, weight_of_others: float = 1.0, seed: int = SEED, names: tuple[str, str] | None = ("copy", "n_copies")) -> DataFrame:
    """The rows of docs, each as often as drawn, in a global random order.

    weights: target weights by source; sources that it does not name have
    weight_of_others. total: wanted rows, by default as many as there are.
    names: of the two columns that number the copies, or None for docs' columns
    only; a column of docs named so gives way. Rows that share source and doc_id
    (null counts as an id) are drawn alike; text and other columns play no part,
    may be null and of any length, and keep whatever names they have. A source
    of weight 0 goes. No rows give no rows.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "mix")
    own = [c for c in docs.columns if c.lower() not in {n.lower() for n in names or ()}]
    known = space.save(distributions(rates(docs, weights, total, weight_of_others)), "distributions")
    of, parts, cdf, u_, n_, copy, deal, place, salt, salt2 = fresh(docs.columns, 10)
    known = known.toDF(of, parts, cdf)
    source = F.col("source").cast("string")
    if known.count() <= BROADCAST_ROWS:
        joined = docs.join(F.broadcast(known), source.eqNullSafe(F.col(of)))
    else:
        # a source may hold a third of all rows: its rows are dealt under a salt
        salted = docs.withColumn(salt, F.pmod(F.xxhash64("doc_id"), F.lit(64)).cast("int"))
        spread = known.withColumn(salt2, F.explode(F.sequence(F.lit(0), F.lit(63))))
        joined = salted.join(spread, source.eqNullSafe(F.col(of)) & (F.col(salt) == F.col(salt2)))
    u = lambda k: uniform(F.lit(seed), F.col("doc_id"), k)
    below = lambda k: F.size(F.filter(cdf, lambda c: c <= u(k))).cast("long")
    one = F.size(F.filter(cdf, lambda c: c <= F.col(u_))).cast("long")
    many = F.aggregate(F.sequence(F.lit(1), F.col(parts)), F.lit(0).cast("long"), lambda a, k: a + below(k))
    counted = joined.withColumn(u_, u(F.lit(1))).withColumn(n_, F.when(F.col(parts) == 1, one).otherwise(many))
    copies = counted.filter(F.col(n_) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n_))))
    # where a row goes and its place there are hashes of their own: a global shuffle in one exchange
    dealt = copies.withColumn(deal, F.xxhash64(F.lit(seed), F.col("doc_id"), F.col(copy))).withColumn(place, F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col(copy)))
    shuffled = dealt.repartition(deal).sortWithinPartitions(place)
    extra = [] if names is None else [F.col(copy).alias(names[0]), F.col(n_).alias(names[1])]
    return shuffled.select(*[F.col(f"`{c}`") for c in own], *extra)


#: Half of the mix from four named sources, the other half shared alike by all others.
TARGETS = {"src0": 0.2, "src1": 0.1, "src2": 0.1, "src3": 0.1}
OTHERS = 0.5 / 16


def op8_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return mix(docs, TARGETS, weight_of_others=OTHERS)


OP8_SQL = f"""
WITH sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
weighed AS (SELECT source, n, CASE source WHEN 'src0' THEN 0.2e0 WHEN 'src1' THEN 0.1e0 WHEN 'src2' THEN 0.1e0 WHEN 'src3' THEN 0.1e0 ELSE {OTHERS!r}::DOUBLE END AS w FROM sizes),
rates AS (SELECT source, w / sum(w) OVER () * sum(n) OVER () / n AS rate FROM weighed),
terms AS (SELECT source, k, CASE WHEN k = 0 THEN exp(-rate) ELSE exp(-rate + k * ln(rate) - lgamma(k + 1)) END AS p FROM rates, range(0, 100) AS t(k)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
drawn AS (SELECT d.*, (('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, 'null') || ':1'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u FROM documents d),
counted AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source AND cdf.c <= d.u) AS n_copies FROM drawn d)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n_copies + 1)) AS copy, n_copies FROM counted WHERE n_copies > 0
"""
