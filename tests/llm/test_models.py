"""Language identification and the quality classifier: held-out accuracy and edges."""

import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from strataglyph.llm import langid, sites

from ..conftest import SMALL


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.learn(docs)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert set(got) == set(truth)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r.held_out} == set(held)
    assert sum(got[i].lang_pred == truth[i] for i in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 !", None), (None, "the of and", "x")], "doc_id long, text string, lang string")
    assert sorted((r.doc_id or 0, r.lang_pred == "und") for r in langid.predict(odd, model).collect()) == [(0, False), (1, True), (2, True), (3, True)]
    assert langid.learn(docs.limit(0))["langs"] == []
    assert langid.predict(docs.limit(0), model).count() == 0
    one = langid.learn(docs.filter("lang = 'en'"))
    assert one["langs"] == ["en"]


def plain_grams(text):
    """Features of a text one n-gram after the other."""
    mask = (1 << 64) - 1
    text = f" {text.lower()} "
    for n in langid.ORDERS:
        for i in range(len(text) - n + 1):
            h = n
            for ch in text[i : i + n]:
                h = (h + ord(ch)) * 0x9E3779B97F4A7C15 & mask
                h ^= h >> 29
            yield h >> 7 & langid.DIM - 1


def test_predictions_against_plain_sums(spark):
    """Every text of documents, by a dictionary of weights and one n-gram after the other."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.learn(docs)
    got = {r.doc_id: r for r in langid.op2_language_id(spark, SMALL).collect()}
    rows = docs.select("doc_id", "text").orderBy(F.length("text")).limit(150).collect()
    for d in rows:
        text = d.text or ""
        if not any(ch.isalpha() for ch in text):
            assert (got[d.doc_id].lang_pred, got[d.doc_id].score) == ("und", 0.0)
            continue
        grams = list(plain_grams(text))
        logits = [(sum(float(model["weights"][g, k]) for g in grams) / len(grams) + model["bias"][k]) / model["temperature"] for k in range(len(model["langs"]))]
        odds = [math.exp(x - max(logits)) for x in logits]
        best = odds.index(max(odds))
        assert got[d.doc_id].lang_pred == model["langs"][best]
        assert abs(got[d.doc_id].score - odds[best] / sum(odds)) < 1e-4


def test_training_against_plain_updates(monkeypatch):
    """Follow-the-regularised-leader, coordinate by coordinate."""
    monkeypatch.setattr(langid, "DIM", 64)
    r = random.Random(2)
    rows = []
    for k in range(40):
        ids = np.array(sorted(r.sample(range(0 if k % 2 else 20, 40 if k % 2 else 60), 6)))
        share = np.array([r.random() for _ in ids])
        rows.append((ids, share / share.sum(), "ab"[k % 2], True))
    got = langid.train(rows)
    idf = [math.log((1 + len(rows)) / (1 + sum(i in x[0] for x in rows))) + 1 for i in range(64)]
    z, n, bias, bias_n = np.zeros((64, 2)), np.zeros((64, 2)), [0.0, 0.0], [0.0, 0.0]

    def weight(i, c):
        if abs(z[i, c]) <= langid.L1:
            return 0.0
        return -(z[i, c] - math.copysign(langid.L1, z[i, c])) / ((langid.BETA + math.sqrt(n[i, c])) / langid.ALPHA + langid.L2)

    order = np.random.default_rng(7)
    for _ in range(langid.EPOCHS):
        for k in order.permutation(len(rows)):
            ids, share, lang, _ = rows[k]
            x = {int(i): float(v) * idf[i] * langid.SCALE for i, v in zip(ids, share, strict=True)}
            w = {(i, c): weight(i, c) for i in x for c in (0, 1)}
            logits = [sum(v * w[i, c] for i, v in x.items()) + bias[c] for c in (0, 1)]
            odds = [math.exp(v - max(logits)) for v in logits]
            for c in (0, 1):
                p = odds[c] / sum(odds) - ("ab"[c] == lang)
                for i, v in x.items():
                    g = v * p
                    z[i, c] += g - (math.sqrt(n[i, c] + g * g) - math.sqrt(n[i, c])) / langid.ALPHA * w[i, c]
                    n[i, c] += g * g
                bias_n[c] += p * p
                bias[c] -= 0.1 * p / (1 + math.sqrt(bias_n[c]))
    want = np.array([[weight(i, c) * idf[i] * langid.SCALE for c in (0, 1)] for i in range(64)])
    assert np.allclose(got["weights"], want, rtol=1e-4, atol=1e-5) and np.allclose(got["bias"], bias)
    assert (want == 0).any() and (want != 0).any()


def test_samples_are_bounded_by_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(k % 7, f"text {k} of words", "ab"[k % 2]) for k in range(400)], "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(langid.Workspace, "save", lambda self, df, name: seen.append(df.count()) or df)
    langid.learn(docs, 50)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(7)], "doc_id long, quality int, toxic int")
    sites.learn(docs, labels, 5)
    assert seen == [50, 5]


def test_clashing_names_long_and_repeated_texts(spark):
    long = "the of and to in " * 60_000
    rows = [(1, long, "en", "h", 1, "x"), (1, long, "en", "h", 2, "y"), (2, "le la les des", "fr", "h", 3, None), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string, score int, own_quality string")
    model = langid.learn(df.filter("lang is not null"), 10)
    got = langid.predict(df, model).collect()
    assert len(got) == 4 and len({(r.lang_pred, r.score) for r in got if r.doc_id == 1}) == 1
    own = sites.posteriors(df, None, F.col("host"), F.col("lang")).collect()
    assert len(own) == 4 and all(r.kept and r.quality == 0.5 for r in own)


def test_posteriors_against_plain_sums(spark):
    """Every document's probabilities from the evidence of all, group by group."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = sites.learn(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    got = sites.posteriors(docs, model, F.col("source"), F.col("lang")).collect()
    site = {r.doc_id: (r.source, r.lang) for r in docs.select("doc_id", "source", "lang").collect()}
    clip = lambda p: max(p, 1e-9)
    odds = lambda p: math.log(clip(p) / clip(1 - p))

    def strength(groups):  # (n, sum, mean of the level above)
        many = [g for g in groups if g[0] > 1]
        excess = max(0.0, sum(n * (s / n - m) ** 2 for n, s, m in many) - sum(m * (1 - m) for _, _, m in many))
        weight = sum(n * m * (1 - m) for n, _, m in many)
        ratio = excess / weight if weight else 0.0
        return min(1e4, max(2.0, 1 / ratio - 1 if ratio > 0 else 1e4))

    for target in sites.TARGETS:
        own = {r.doc_id: r[f"own_{target}"] for r in got}
        mean = sum(own.values()) / len(own)
        hosts, paths = {}, {}
        for i, p in own.items():
            for table, key in ((hosts, site[i][0]), (paths, site[i])):
                n, s = table.get(key, (0, 0.0))
                table[key] = (n + 1, s + p)
        k = strength([(n, s, mean) for n, s in hosts.values()])
        host = {h: (s + k * mean) / (n + k) for h, (n, s) in hosts.items()}
        k = strength([(n, s, host[h]) for (h, _), (n, s) in paths.items()])
        for r in got:
            n, s = paths[site[r.doc_id]]
            others = (s - own[r.doc_id] + k * host[site[r.doc_id][0]]) / (n - 1 + k)
            assert abs(r[f"site_{target}"] - others) < 1e-6
            assert abs(r[target] - 1 / (1 + math.exp(-(odds(own[r.doc_id]) + odds(others) - odds(mean))))) < 1e-6


def test_long_text_equals_its_parts():
    r = random.Random(1)
    text = "".join(r.choice("abc é") for _ in range(3000))
    whole = [x.tolist() for x in langid.grams(text)]
    old, langid.STRIDE = langid.STRIDE, 97
    try:
        parts = [v for x in langid.grams(text) for v in x.tolist()]
    finally:
        langid.STRIDE = old
    assert sorted(parts) == sorted(v for x in whole for v in x)


def test_quality_held_out(spark):
    docs = spark.read.parquet(f"{SMALL.replace('0.001', '0.1')}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL.replace('0.001', '0.1')}/labels.parquet")
    model = sites.learn(docs, labels, 1500)
    rest = labels.withColumn("h", F.xxhash64(F.lit(13), F.col("doc_id"))).orderBy("h").offset(1500).drop("h")
    got = sites.posteriors(docs, model, F.col("source"), F.col("lang")).join(rest.select("doc_id", F.col("quality").alias("q"), F.col("toxic").alias("t")), "doc_id")
    right = got.agg(F.avg((F.col("kept") == ((F.col("q") == 1) & (F.col("t") == 0))).cast("int"))).first()[0]
    assert right > 0.97
    odd = spark.createDataFrame([(1, None, None, None), (None, "", "x", "y"), (2, "a b", "x", "y")], "doc_id long, text string, source string, lang string")
    rows = sites.posteriors(odd, model, F.col("source"), F.col("lang")).collect()
    assert len(rows) == 3 and all(0 <= r.quality <= 1 for r in rows)
    assert sites.learn(docs, labels.limit(0)) is None
    assert all(r.kept for r in sites.posteriors(odd, None, F.col("source"), F.col("lang")).collect())
    assert sites.posteriors(odd.limit(0), model, F.col("source"), F.col("lang")).count() == 0


def test_sparse_sites_stay_near_the_prior(spark):
    n, few = 400, 2
    rows = [(i, "h1", "p", 0.95 if i % 10 else 0.05, 0.01) for i in range(n)] + [(n + i, "h2", "p", 0.1, 0.01) for i in range(n)] + [(5000 + i, "h3", "p", 0.1, 0.01) for i in range(few)]
    own = spark.createDataFrame(rows, "doc_id long, host string, path string, own_quality double, own_toxic double")
    hosts = own.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("own_quality").alias("s_quality"), F.sum("own_toxic").alias("s_toxic")).withColumn("all_quality", F.lit(0.5)).withColumn("all_toxic", F.lit(0.01))
    strength = sites._strength(hosts, "all")[0]
    assert 2 <= strength < 50
    shrunk = (few * 0.1 + strength * 0.5) / (few + strength)
    assert abs(shrunk - 0.5) < abs((n * 0.1 + strength * 0.5) / (n + strength) - 0.5)
