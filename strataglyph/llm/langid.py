"""Language identification: sparse multinomial logistic regression on TF-IDF of hashed character n-grams.

Trained with follow-the-regularised-leader (per-coordinate rates, elastic net)
on a bounded, hashed sample of labelled rows, then calibrated by a temperature
on rows of the sample that training didn't see. A text's vector is linear in
its n-gram counts, so its logits are a mean over all its n-grams: whole texts
are scored in one pass and constant memory.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace, table

#: Rows of the sample.
SAMPLE = 4000
#: N-gram lengths, and hashed features.
ORDERS, DIM = (1, 2, 3), 1 << 16
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 2e-3, 1e-4, 3
#: Times a text's mean n-gram vector, so that rates and penalties are on a usual scale.
SCALE = 50.0
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
#: Characters of a text that are scored at once.
STRIDE = 1 << 18


def grams(text: str) -> Iterator[np.ndarray]:
    """Hashed n-grams of the lower-cased text with a space around it, stride by stride."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    for begin in range(0, len(codes), STRIDE):
        part = codes[begin : begin + STRIDE + max(ORDERS) - 1]
        for n in ORDERS:
            size = min(STRIDE, len(codes) - n + 1 - begin)
            if size > 0:
                h = np.full(size, n, np.uint64)
                for k in range(n):
                    h = (h + part[k : k + size]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                yield (h >> np.uint64(7)).astype(np.int64) & (DIM - 1)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, their shares of the text's n-grams)."""
    total = np.zeros(DIM, np.int64)
    for ids in grams(text):
        total += np.bincount(ids, minlength=DIM)
    seen = np.flatnonzero(total)
    return seen, total[seen] / max(1, total.sum())


def train(rows: list[tuple[np.ndarray, np.ndarray, str, bool]]) -> dict:
    """The model from (features, shares, lang, whether it trains or calibrates)."""
    langs = sorted({r[2] for r in rows})
    fit = [r for r in rows if r[3]] or rows
    df = np.zeros(DIM)
    for ids, _, _, _ in fit:
        df[ids] += 1
    idf = np.log((1 + len(fit)) / (1 + df)) + 1
    k = len(langs)
    z, n, w = np.zeros((DIM, k)), np.zeros((DIM, k)), np.zeros((DIM, k))
    bias, bias_n = np.zeros(k), np.zeros(k)
    index = {lang: i for i, lang in enumerate(langs)}
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(fit)):
            ids, share, lang, _ = fit[i]
            x = share * idf[ids] * SCALE
            zi, ni = z[ids], n[ids]
            wi = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            p = _softmax(x @ wi + bias)
            p[index[lang]] -= 1
            g = x[:, None] * p
            z[ids] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * wi
            n[ids] = ni + g * g
            bias_n += p * p
            bias -= 0.1 * p / (1 + np.sqrt(bias_n))
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    weights = w * idf[:, None] * SCALE
    held = [r for r in rows if not r[3]] or rows
    logits = np.array([share @ weights[ids] + bias for ids, share, _, _ in held])
    truth = np.array([index[r[2]] for r in held])
    grid = np.geomspace(0.05, 20, 121)
    loss = [-np.mean(np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12))) for t in grid]
    return {"langs": langs, "weights": weights.astype(np.float32), "bias": bias, "temperature": float(grid[int(np.argmin(loss))])}


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def classify(model: dict, text: str | None) -> tuple[str, float]:
    if not text or not _LETTER.search(text) or not model["langs"]:
        return UNKNOWN, 0.0
    weights, total, n = model["weights"], np.zeros(len(model["langs"])), 0
    for ids in grams(text):
        total += np.bincount(ids, minlength=DIM).astype(np.float32) @ weights if len(ids) > DIM else weights[ids].sum(axis=0, dtype=np.float64)
        n += len(ids)
    p = _softmax((total / n + model["bias"]) / model["temperature"])
    best = int(p.argmax())
    return model["langs"][best], float(p[best])


def held_out() -> Column:
    """Whether crc32 of doc_id as text leaves 2 modulo 4 (false without a doc_id)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """The model from the ``sample`` labelled rows, not held out, of least hash of doc_id (of rows that share one, of text). No more rows are taken, however often a doc_id repeats."""
    spark = docs.sparkSession
    space = Workspace(spark, "langid")
    open_rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    h = F.xxhash64(F.lit(11), F.col("doc_id"))
    least = open_rows.select(h.alias("h")).orderBy("h").limit(sample)
    cut = least.agg(F.max("h")).first()[0]
    if cut is None:
        return {"langs": [], "weights": np.zeros((DIM, 0), np.float32), "bias": np.zeros(0), "temperature": 1.0}
    below = least.filter(F.col("h") < cut).count()
    text = F.col("text").cast("string")
    known = open_rows.select(text.alias("text"), F.col("lang").cast("string").alias("lang"), h.alias("h"), (F.pmod(h, F.lit(5)) != 0).alias("fits"))
    last = known.filter(F.col("h") == cut).orderBy(F.xxhash64("text"), "lang").limit(sample - below)
    chosen = known.filter(F.col("h") < cut).unionByName(last).select("text", "lang", "fits")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [counts(t) for t in batch["text"]]
            yield pd.DataFrame({"ids": [a.astype(np.int32).tobytes() for a, _ in found], "shares": [b.astype(np.float32).tobytes() for _, b in found], "lang": batch["lang"], "fits": batch["fits"]})

    rows = space.save(chosen.mapInPandas(features, "ids binary, shares binary, lang string, fits boolean"), "sample")

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = [(np.frombuffer(r.ids, np.int32), np.frombuffer(r.shares, np.float32).astype(np.float64), r.lang, r.fits) for b in batches for r in b.itertuples()]
        if known:
            known.sort(key=lambda r: (r[2], r[0].tobytes(), r[1].tobytes()))  # the same order however rows were dealt
            yield pd.DataFrame({"model": [pickle.dumps(train(known))]})

    # one task: the sample is bounded
    return pickle.loads(rows.coalesce(1).mapInPandas(fit, "model binary").first()[0])


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row.

    Null texts and texts without a letter are ``und``, with score 0; so are all
    texts where nothing was learnt. Whole texts are scored, of any length. Ties
    go to the first lang by name. Rows that repeat are scored alike; a null
    doc_id stays null. An empty table gives no rows. Other columns play no part,
    whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [classify(shared.value, t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(each, "doc_id long, held_out boolean, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, learn(docs))
