import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from strataglyph.llm import mixing, neardup, packing, quality, secrets
from strataglyph.llm.registry import ORACLES, QUERIES

from ..conftest import SMALL
from .test_neardup import closure, sets
from .test_packing import best_fit
from .test_quality import brute as statistics


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "minhash_near_dedup", "secret_scans", "poisson_mixing", "best_fit_packing"]
    good = {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
    one = docs.filter(docs.doc_id.isin(list(good)))
    first = {r.doc_id for r in neardup.link(one).filter("kept").collect()}
    assert len(first) < len(good) < docs.count()
    two = one.filter(one.doc_id.isin(list(first)))
    masked = [(r.doc_id, secrets.redact_text(r.text), r.lang, r.source, r.n_chars) for r in two.collect()]
    three = spark.createDataFrame(masked, docs.schema)
    mixed = mixing.mix(three, mixing.TARGETS, weight_of_others=mixing.OTHERS, names=None)
    want = sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packing.pieces(mixed).collect())
    got = corpus_pipeline.run(spark, SMALL)
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in got.collect()) == want
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(20), SMALL).columns == docs.columns
    assert packing.pack(docs.limit(0)).count() == 0


def poisson(rate, u):
    """The least k whose distribution function exceeds u."""
    k, p, total = 0, math.exp(-rate), math.exp(-rate)
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


def test_run_against_brute_force(spark, tmp_path):
    """All five stages over a small table whose outliers are plain to see, each worked out again without the operators."""
    r = random.Random(12)
    words = [f"{a}{b}" for a in "ka lo mi nu pe ra so tu vi we".split() for b in "ba de fi go hu".split()]
    prose = lambda n: [r.choice(words) + str(r.randint(0, 900)) for _ in range(n)]
    rows = [(i, " ".join(prose(r.randint(70, 160))), ("en", "fr")[i % 2], f"src{i % 3 * 9}") for i in range(240)]
    for i in range(240, 280):  # near copies and exact ones of the first
        copy = rows[i - 240][1].split()
        for at in r.sample(range(len(copy)), r.choice((0, 0, 1, 2, 30))):
            copy[at] = r.choice(words)
        rows.append((i, " ".join(copy), *rows[i - 240][2:]))
    secret = "token = 'abcdefghij0123456789'"
    rows = [(i, f"{t} {secret}" if i % 17 == 0 else t, *rest) for i, t, *rest in rows]
    junk = [(500 + i, " ".join(w + "&&&" for w in prose(90)), "en", "src0") for i in range(8)]
    junk += [(600, None, "en", "src0"), (601, "", None, None), (602, "too short", "fr", "src9"), (603, "the same three " * 60, "en", "src0")]
    every = [(i, t, lang, source, len(t or "")) for i, t, lang, source in r.sample(rows + junk, len(rows) + len(junk))]
    spark.createDataFrame(every, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    # quality: the base rules, and the outliers that were planted
    bad = {i for i, t, *_ in every if (s := statistics(t))[0] < 50 or 100 * s[4] > 50 * s[0]}
    assert bad == {600, 601, 602, 603}
    good = {i: (t, lang, source) for i, t, lang, source, _ in every if i < 500}
    # near-duplicates
    shingles = {i: sets(t) for i, (t, *_) in good.items()}
    linked = [(a, b) for a in good for b in good if a < b and 100 * len(shingles[a] & shingles[b]) >= 75 * len(shingles[a] | shingles[b])]
    least = closure(good, linked)
    first = {i: v for i, v in good.items() if least[i] == i}
    assert 240 <= len(first) < 280
    # secrets
    masked = {i: (t.replace(secret, "[assign]'"), lang, source) for i, (t, lang, source) in first.items()}
    assert any("[assign]" in t for t, *_ in masked.values())
    # mixing
    size = Counter(source for *_, source in masked.values())
    weight = {x: mixing.TARGETS.get(x, mixing.OTHERS) for x in size}
    pieces, tokenizer = Counter(), Tokenizer.from_file(packing.vocabulary(packing.VOCABULARY))
    for i, (t, _, source) in masked.items():
        rate = weight[source] / sum(weight.values()) * len(masked) / size[source]
        u = (int(hashlib.md5(f"{mixing.SEED}:{i}:1".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), packing.CAPACITY):
            part = ids[k : k + packing.CAPACITY]
            pieces[(i, k // packing.CAPACITY, k, len(part), zlib.crc32(part.tobytes()))] += poisson(rate, u)
    # packing
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == +pieces
    used = Counter()
    for x in sorted(got, key=lambda x: (x.sequence_id, x.offset)):
        assert used[x.sequence_id] == x.offset
        used[x.sequence_id] += x.length
    assert max(used.values()) <= packing.CAPACITY and len(used) == best_fit([x.length for x in got], packing.CAPACITY)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    theirs = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.select(*columns).collect()))) == sorted(map(str, theirs))
