"""Quality and toxicity by hierarchical empirical Bayes.

A sparse logistic classifier gives each document's own evidence. Documents of
one host, and of one path of a host, share posteriors: Beta priors whose mean
is the level above and whose strength is fitted to how far sites differ, so a
sparse site stays near its host and a sparse host near all documents. Both
levels are grouped sums. A document's probability is its own odds with the
prior odds moved from the global mean to its path's posterior, in which it does
not count itself.
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace, table

#: Labelled rows that the classifier is fitted on, and documents of them in which a word must be to count.
SAMPLE, LEAST = 4000, 5
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 4.0, 0.01, 12
TARGETS = ("quality", "toxic")
#: Rows of site sums up to which they are broadcast.
BROADCAST_ROWS = 20_000
_WORD = re.compile(r"[^\W\d_]+")
_SIGNS = {"upper": range(65, 91), "digit": range(48, 58), "symbol": b"#*$%&|<>", "stop": b"!?", "other": b"{}[]=~^\\@"}
_CLASS = np.array([[b in members for members in _SIGNS.values()] for b in range(256)], np.float64)


#: Lengths of the word beginnings that count as features beside whole words: stems that take many endings are rarely seen twice in one form.
STEMS = (4, 5, 6)


def evidence(text: str | None) -> tuple[set[str], np.ndarray]:
    """(distinct words and their stems, a few numbers about the text)."""
    text = text or ""
    words = _WORD.findall(text.lower())
    distinct = set(words)
    data = text.encode("utf-8", "replace")
    shares = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASS / max(1, len(data))
    n = max(1, len(words))
    lines = [line for line in text.split("\n") if line.strip()]
    # distinct words against what a text of this length has as a rule
    numbers = [math.log1p(len(words)), len(distinct) / n ** 0.8, sum(map(len, words)) / n, len(set(lines)) / max(1, len(lines)), *np.sqrt(shares)]
    stems = {f"{w[:k]}-" for k in STEMS for w in distinct if len(w) >= k}
    return distinct | stems, np.array(numbers)


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def train(rows: list[tuple[set[str], np.ndarray, list[int]]]) -> dict:
    df: dict[str, int] = {}
    for words, _, _ in rows:
        for w in words:
            df[w] = df.get(w, 0) + 1
    vocabulary = {w: i for i, w in enumerate(sorted(w for w, c in df.items() if c >= LEAST))}
    dense = np.array([r[1] for r in rows])
    mean, spread = dense.mean(axis=0), dense.std(axis=0) + 1e-3
    size = len(vocabulary) + 2 * len(mean) + 1
    x = []
    for words, numbers, _ in rows:
        ids = [vocabulary[w] for w in words if w in vocabulary]
        x.append((np.array([*ids, *range(len(vocabulary), size)]), np.concatenate([np.ones(len(ids)), _dense(numbers, mean, spread), [1.0]])))
    weights = []
    for t in range(len(TARGETS)):
        z, n = np.zeros(size), np.zeros(size)
        order = np.random.default_rng(5)

        def solve(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
            return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

        for _ in range(EPOCHS):
            for i in order.permutation(len(rows)):
                ids, v = x[i]
                zi, ni = z[ids], n[ids]
                wi = solve(zi, ni)
                g = (_sigmoid(float(wi @ v)) - rows[i][2][t]) * v
                z[ids] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * wi
                n[ids] = ni + g * g
        weights.append(solve(z, n))
    w = np.array(weights)
    words = {word: w[:, i].copy() for word, i in vocabulary.items() if w[:, i].any()}
    return {"words": words, "mean": mean, "spread": spread, "dense": w[:, len(vocabulary) : -1], "bias": w[:, -1]}


def _dense(numbers: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    x = np.clip((numbers - mean) / spread, -6, 6)
    return np.concatenate([x, np.abs(x)])


def score(model: dict | None, text: str | None) -> list[float]:
    """Probabilities of TARGETS from the text alone; one half each without a model."""
    if model is None:
        return [0.5, 0.5]
    distinct, numbers = evidence(text)
    logits = model["dense"] @ _dense(numbers, model["mean"], model["spread"]) + model["bias"]
    known = model["words"]
    for w in known.keys() & distinct:
        logits = logits + known[w]
    return [_sigmoid(float(v)) for v in logits]


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | None:
    """The classifier from the ``sample`` labelled documents of least hash of doc_id; None without any.

    A document of several rows is learnt from one of them, so that no more than
    ``sample`` rows are. One that any label calls toxic, or bad, counts as such.
    """
    h = F.xxhash64(F.lit(13), F.col("doc_id"))
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    chosen = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"), F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(h).limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "quality", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(*evidence(r.text), [r.quality, r.toxic]) for r in batch.itertuples()]
            yield pd.DataFrame({"row": [pickle.dumps((sorted(a), b, c)) for a, b, c in found], "doc_id": batch["doc_id"]})

    known = Workspace(docs.sparkSession, "sites-sample").save(rows.mapInPandas(features, "row binary, doc_id long"), "rows")

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = sorted(((r.doc_id, r.row) for b in batches for r in b.itertuples()))
        if got:
            parts = [pickle.loads(r) for _, r in got]
            yield pd.DataFrame({"model": [pickle.dumps(train([(set(a), b, c) for a, b, c in parts]))]})

    # one task: the sample is bounded
    found = known.coalesce(1).mapInPandas(fit, "model binary").first()
    return pickle.loads(found[0]) if found else None


def _attach(rows: DataFrame, small: DataFrame, key: list[str]) -> DataFrame:
    if small.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), key)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "own_quality"), F.lit(32)).cast("int"))
    return salted.join(small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31)))), [*key, "salt"]).drop("salt")


def _strength(groups: DataFrame, up: str) -> tuple[float, float]:
    """Prior strengths of TARGETS by the method of moments: how many documents the level above counts for.

    groups: n, s_ sums and up_ means of the level above. Without a difference
    between groups beyond chance the strength is large.
    """
    out = []
    for t in TARGETS:
        m = F.col(f"{up}_{t}")
        chance = F.sum(m * (1 - m))  # sum over groups of n times the variance of a mean
        seen = F.sum(F.col("n") * (F.col(f"s_{t}") / F.col("n") - m) ** 2)
        weight = F.sum(F.col("n") * m * (1 - m))
        r = groups.filter("n > 1").agg(chance.alias("c"), seen.alias("o"), weight.alias("w")).first()
        excess = max(0.0, (r.o or 0.0) - (r.c or 0.0))
        ratio = excess / r.w if r.w else 0.0
        out.append(min(1e4, max(2.0, 1 / ratio - 1 if ratio > 0 else 1e4)))
    return tuple(out)


def posteriors(docs: DataFrame, model: dict | None, host: Column, path: Column) -> DataFrame:
    """One row a row of docs: doc_id, own_, site_ and final probabilities of TARGETS, kept.

    A null host or path is a site like any other. Null and empty texts are
    scored as texts without words, texts of any length as a whole. Rows that
    repeat are scored alike and each counts in its site; a null doc_id stays
    null. An empty table gives no rows. Columns of docs other than doc_id, text
    and those of host and path play no part, whatever their names. kept: quality at least one half, and toxic
    below it; without labelled rows every probability is one half and all are
    kept.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "sites")
    shared = spark.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("own_quality", pa.float64()), ("own_toxic", pa.float64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [score(shared.value, t.as_py()) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *[pa.array([f[k] for f in found], pa.float64()) for k in (0, 1)]], schema=schema)

    site = lambda c: F.to_json(F.struct(c.cast("string").alias("s")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), site(host).alias("host"), site(path).alias("path"), F.col("text").cast("string").alias("text"))
    own = space.save(rows.mapInArrow(each, "doc_id long, host string, path string, own_quality double, own_toxic double"), "own")
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(f"own_{t}").alias(f"s_{t}") for t in TARGETS]]
    paths = space.save(own.groupBy("host", "path").agg(*sums), "paths")
    again = [F.sum("n").alias("n"), *[F.sum(f"s_{t}").alias(f"s_{t}") for t in TARGETS]]
    hosts = space.save(paths.groupBy("host").agg(*again), "hosts")
    total = hosts.agg(*again).first()
    mean = {t: min(1 - 1e-6, max(1e-6, total[f"s_{t}"] / total.n)) if total.n else 0.5 for t in TARGETS}
    for t in TARGETS:
        hosts = hosts.withColumn(f"all_{t}", F.lit(mean[t]))
    for t, k in zip(TARGETS, _strength(hosts, "all"), strict=True):
        hosts = hosts.withColumn(f"host_{t}", (F.col(f"s_{t}") + k * mean[t]) / (F.col("n") + k))
    above = hosts.select("host", *[f"host_{t}" for t in TARGETS])
    levels = space.save(paths.join(above, "host"), "levels")
    strength = _strength(levels, "host")
    joined = _attach(own, levels, ["host", "path"])
    odds = lambda p: F.log(F.greatest(p, F.lit(1e-9)) / F.greatest(1 - p, F.lit(1e-9)))
    for t, k in zip(TARGETS, strength, strict=True):
        others = (F.col(f"s_{t}") - F.col(f"own_{t}") + k * F.col(f"host_{t}")) / (F.col("n") - 1 + k)
        joined = joined.withColumn(f"site_{t}", others)
        joined = joined.withColumn(t, 1 / (1 + F.exp(-(odds(F.col(f"own_{t}")) + odds(F.col(f"site_{t}")) - odds(F.lit(mean[t]))))))
    kept = F.lit(True) if model is None else (F.col("quality") >= 0.5) & (F.col("toxic") < 0.5)
    return joined.select("doc_id", *[f"own_{t}" for t in TARGETS], *[f"site_{t}" for t in TARGETS], *TARGETS, kept.alias("kept"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host: the document's source; path: its language within the source, for documents carry no address."""
    docs = table(spark, sf_dir, "documents")
    return posteriors(docs, learn(docs, table(spark, sf_dir, "labels")), F.col("source"), F.col("lang"))
