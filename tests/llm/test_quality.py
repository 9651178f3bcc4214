import itertools
import math
import random
import re
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

from strataglyph.llm.quality import CONSISTENCY, NOISE, SHARE, fit, judge, keep_good, with_statistics
from strataglyph.llm.workspace import Workspace

DOCS = "doc_id long, text string, lang string, source string, kept string, n_words int"


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def prose(r, n=80):
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(r.randint(0, 400)) for _ in range(n))


def test_statistics(spark):
    r = random.Random(4)
    pool = ["a", "b", "é", "𝒳", "#", "\n", "\t", " ", "  ", "\x0b", " ", "&&", "|"]
    texts = [None, "", " \n ", "a", "a b", "a a a", "a a a a", "a b c a b c", "x\nx\n\n \nx"] + ["".join(r.choice(pool) for _ in range(r.randint(0, 90))) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for row in with_statistics(df).collect():
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == brute(texts[row.doc_id])
        assert row.base_failed == (row.n_words < 50 or 100 * row.n_repeat_words > 50 * row.n_words)


def test_outliers_go_and_clean_texts_stay(spark):
    r = random.Random(5)
    rows = [(i, prose(r), "en" if i % 4 else None, f"s{i % 3}", "x", 1) for i in range(300)]
    rows += [(1000 + i, " ".join(w + "&&&" for w in prose(r).split()), "en", f"s{i % 3}", "x", 1) for i in range(12)]
    rows += [(2000, None, None, None, None, None), (2001, "", "en", "s1", None, None), (None, prose(r), "en", "s1", None, 7), (3, prose(r), "zz", "only", None, None)]
    df = spark.createDataFrame(rows, DOCS)
    got = judge(df, "q_").collect()
    assert len(got) == len(rows)
    for row in got:
        junk = row.doc_id is not None and row.doc_id >= 1000
        assert row.q_kept == (not junk), row.doc_id
    # the robust distance, worked out plainly from the clean majority
    clean = [x for x in got if not x.q_base_failed and x.lang == "en" and x.source == "s1"]
    f = np.array([[np.log(x.q_word_chars / x.q_n_words), np.log1p(100 * x.q_n_symbols / x.q_word_chars), np.log1p(100 * x.q_n_dup_lines / x.q_n_words), np.sqrt(x.q_n_repeat_words / x.q_n_words), np.log(x.q_n_words)] for x in clean])
    core = np.array([x.doc_id is None or x.doc_id < 1000 for x in clean])
    cov = np.cov(f[core].T, bias=True) + np.diag(np.array(NOISE) ** 2)
    d = f - f[core].mean(axis=0)
    plain = np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)
    assert np.allclose([x.q_distance2 for x in clean], plain, rtol=0.05, atol=0.05)
    kept = keep_good(df)
    assert kept.columns == df.columns
    assert kept.count() == sum(x.q_kept for x in got)
    assert judge(df.limit(0)).count() == 0


def determinant(f):
    cov = CONSISTENCY * np.cov(f.T, bias=True) + np.diag(np.array(NOISE) ** 2)
    return np.linalg.slogdet(cov)[1]


def test_determinant_against_every_subset(spark):
    """The reweighted estimate rests on the subset of least determinant among all subsets of a small group."""
    r = np.random.default_rng(3)
    for outliers in (0, 2, 3):
        f = r.normal(size=(13, 5)) * np.array(NOISE) * 0.6
        f[:outliers] += np.array([0.2, 8, 4, 3, 2]) + r.normal(size=(outliers, 5)) * 0.1
        size = math.ceil(SHARE * len(f))
        best = min(itertools.combinations(range(len(f)), size), key=lambda x: determinant(f[list(x)]))
        df = spark.createDataFrame([(i, ["g"], [float(v) for v in x]) for i, x in enumerate(f)], "_sg_id long, _sg_keys array<string>, _sg_f array<double>")
        space = Workspace(spark, "t")
        (got,) = fit(space, df).collect()
        (raw,) = spark.read.parquet(space.path("estimate4")).orderBy("_sg_det").limit(1).collect()
        assert raw._sg_det <= determinant(f[list(best)]) + 0.35
        far = lambda x: np.einsum("ij,jk,ik->i", x - f[list(best)].mean(axis=0), np.linalg.inv(CONSISTENCY * np.cov(f[list(best)].T, bias=True) + np.diag(np.array(NOISE) ** 2)), x - f[list(best)].mean(axis=0))  # noqa: E731, B023
        inner = f[far(f) <= 12.83]
        assert np.allclose(got._sg_mu, inner.mean(axis=0), atol=0.25)


def test_clashing_names_ties_and_long_texts(spark):
    r = random.Random(8)
    long = prose(r, 60_000)
    rows = [(1, long, "en", "a", "x", 1, 2), (1, long, "en", "a", "x", 1, 2)] + [(2, prose(r), "en", "a", None, None, None)] * 60
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _sg_text string, row int, _SG_0 int")
    got = judge(df).collect()
    assert len(got) == 62 and {x["_sg_text"] for x in got} == {"x", None} and {x.n_words for x in got if x.doc_id == 1} == {60_000}
    assert len({(x.n_words, x.distance2, x.kept) for x in got}) == 2
    assert keep_good(df).columns == df.columns
