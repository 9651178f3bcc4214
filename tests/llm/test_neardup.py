import random

import numpy as np
from pyspark.sql import functions as F

from strataglyph.llm import neardup
from strataglyph.llm.graph import components
from strataglyph.llm.neardup import keep_first, link, merged
from strataglyph.llm.workspace import Workspace

DOCS = "doc_id long, text string, component_id string, id long, kept int"


def sets(text):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def closure(ids, linked):
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(least[a], least[b])
            if (least[a], least[b]) != (m, m):
                least[a] = least[b] = m
                changed = True
    return least


def test_against_brute_force(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", "one", "ONE", "one two", "É a b c d e", "é a b c d e", "x " * 40, "X " * 41]
    for _ in range(12):
        base = [r.choice(words) for _ in range(r.randint(20, 120))]
        for _ in range(r.randint(1, 9)):
            copy = list(base)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = r.choice(words)
            texts.append(" ".join(copy))
    passage = " ".join(r.choice(words) for _ in range(25))
    texts += [passage + " " + " ".join(r.choice(words) for _ in range(60)) for _ in range(40)]
    texts += [texts[20]] * 15
    rows = [(i, t, "c", i, 1) for i, t in enumerate(texts)]
    s = [sets(t) for t in texts]
    linked = [(a, b) for a in range(len(s)) for b in range(a) if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b])]
    want = closure(range(len(s)), linked)
    df = spark.createDataFrame(rows, DOCS)
    got = link(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(s[i]), want[i], want[i] == i) for i in want}
    kept = keep_first(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in want if want[i] == i}


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f", "x", 1, 1), (None, "a b c d e f", "x", 1, 1), (7, "a b c d e f", None, None, None), (7, "a b c d e f", None, None, None), (None, " ", "x", 1, 1), (None, None, "x", 1, 1), (None, "g h", "x", 1, 1), (None, "G h", "x", 1, 1)], DOCS)
    got = link(df).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True)] * 4 + [(0, 7, False)] * 2 + [(7, 7, True)] * 2
    kept = keep_first(df).collect()
    assert sorted((r.doc_id or 0, r.text or "", r.component_id) for r in kept if r.text not in ("g h", "G h")) == [(0, "", "x"), (0, " ", "x"), (7, "a b c d e f", None)]
    assert len(kept) == 4
    assert link(df.limit(0)).count() == 0 and keep_first(df.limit(0)).count() == 0


def test_rows_that_share_an_id_are_one_document(spark):
    one, two = "a b c d e f g", "p q r s t u v"
    rows = [(3, one), (5, one), (5, two), (9, two), (5, ""), (11, two + " w x y z 0 1")]
    for turn in range(3):
        df = spark.createDataFrame(random.Random(turn).sample(rows, len(rows)), "doc_id long, text string").repartition(1 + turn)
        got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in link(df).collect()}
        assert got == {(3, 3, 3, True), (5, 3, 3, False), (9, 3, 3, False), (5, 0, 5, True), (11, 9, 11, True)}
        assert sorted((r.doc_id, r.text) for r in keep_first(df).collect()) == [(3, one), (5, ""), (11, two + " w x y z 0 1")]


def test_clashing_names_and_a_long_text(spark):
    long = " ".join(f"w{i}" for i in range(150_000))
    names = ["doc_id", "text", "_sg_0", "_SG_1", "t1", "group", "row", "key", "n_shingles"]
    df = spark.createDataFrame([(1, long, *"abcdefg"), (2, long + " x", *"abcdefg"), (3, "y", *"abcdefg"), (3, "y", *"abcdefg")], ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))
    assert {(r.doc_id, r.component_id) for r in link(df).collect()} == {(1, 1), (2, 1), (3, 3)}
    kept = keep_first(df)
    assert kept.columns == names and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5)] + [(r.randint(0, 90), r.randint(0, 90)) for _ in range(40)]
    want = closure({v for e in edges for v in e}, edges)
    got = components(Workspace(spark, "t"), spark.createDataFrame(edges, "a long, b long"))
    assert {r.id: r.component for r in got.collect()} == {k: v for k, v in want.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_components_take_tasks_by_their_edges(spark):
    """However many partitions a shuffle has, a round of few edges is a few tasks."""
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(100)] + [(r.randint(0, 400), r.randint(0, 400)) for _ in range(100)]
    want = closure({v for e in edges for v in e}, edges)
    held = {"spark.sql.shuffle.partitions": "96", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("few edges", "")
        got = components(Workspace(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()
        status = spark.sparkContext.statusTracker()
        stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup("few edges") for s in status.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert {r.id: r.component for r in got} == {k: v for k, v in want.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert sum(s.numCompletedTasks for s in stages if s) < 4 * 96


def test_merged_adds_links_to_components(spark):
    r = random.Random(6)
    edges = [(r.randint(0, 150), r.randint(0, 150)) for _ in range(90)]
    space = Workspace(spark, "t")
    found = spark.createDataFrame([], "id long, component long")
    for k in range(3):
        found = merged(space, found, spark.createDataFrame(edges[30 * k : 30 * k + 30], "a long, b long"), str(k))
        some = [e for e in edges[: 30 * k + 30] if e[0] != e[1]]
        want = closure({v for e in some for v in e}, some)
        assert sorted(found.collect()) == sorted(want.items())


def crowd(r, size, words, edits):
    base = [f"b{i}" for i in range(words)]
    texts = []
    for k in range(size):
        copy = list(base)
        for at in r.sample(range(words), r.randint(*edits)):
            copy[at] = f"e{k}x{at}"
        texts.append(" ".join(copy))
    return texts


def brute(texts):
    s = [sets(t) for t in texts]
    column = {x: i for i, x in enumerate(sorted(set().union(*s)))}
    held = np.zeros((len(s), len(column)), np.float32)
    for row, x in zip(held, s, strict=True):
        row[[column[y] for y in x]] = 1
    common, size = held @ held.T, held.sum(axis=1)
    near = 100 * common >= 75 * (size[:, None] + size - common)
    least = np.arange(len(s))
    while (now := np.where(near, least, len(s)).min(axis=1)).tolist() != least.tolist():
        least = now
    return dict(enumerate(least.tolist()))


def test_crowded_family(spark):
    texts = crowd(random.Random(5), 1000, 204, (4, 6))
    want = brute(texts)
    assert 1 < len(set(want.values())) < 1000
    got = link(spark.createDataFrame([(i, t, "c", i, 1) for i, t in enumerate(texts)], DOCS)).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_star(spark):
    """Every copy is linked with the hub only, which lies among thousands of them in every tree."""
    r = random.Random(11)
    base = [f"b{i}" for i in range(109)]
    texts = [" ".join(base)]
    for k in range(3000):
        copy = list(base)
        for at in (20, 50, 80):  # far apart: 90 of 105 shingles stay, of 120 in both
            copy[at + r.randint(-9, 9)] = f"e{k}x{at}"
        texts.append(" ".join(copy))
    ids = r.sample(range(10_000), len(texts))
    got = link(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")).collect()
    assert {x.component_id for x in got} == {min(ids)}


def test_refuted_favourites(spark, monkeypatch):
    """Links are found whatever pairs the walks emit, even none, as long as rows are told to be open; and in crowded regions."""
    texts = crowd(random.Random(9), 60, 204, (4, 6))
    want = brute(texts)
    assert len(set(want.values())) < 60
    forest = neardup.candidates

    def none(space, reps):
        opened = spark.createDataFrame(reps.collect()).select("id", F.explode(F.array(*[F.expr(f"({t}L << 32) | cast(conv(hex(substring(orders, {t * neardup.ORDER + 1}, 4)), 16, 10) as long)") for t in range(neardup.TREES)])).alias("key"))
        return forest(space, reps)[0].limit(0), opened

    monkeypatch.setattr(neardup, "candidates", none)
    for crowded in (neardup.CROWDED, 30):
        monkeypatch.setattr(neardup, "CROWDED", crowded)
        got = link(spark.createDataFrame([(i, t, "c", i, 1) for i, t in enumerate(texts)], DOCS)).collect()
        assert {r.doc_id: r.component_id for r in got} == want
