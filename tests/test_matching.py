"""Units aligned a batch at a time give the rows of the rounds."""

import random

from strataglyph.operators import matching, variants

SCHEMA = "ayah_id long, edition_id long, ref_plain array<string>, ref_rasm array<string>, var_plain array<string>, var_rasm array<string>"


def units(n, seed):
    r = random.Random(seed)
    bare = lambda words: [w.replace("'", "").replace("ء", "") for w in words]
    for k in range(n):
        letters = "بتجحسنصءkz"[: r.randint(1, 10)]
        a = [r.choice(letters) + r.choice(["", "", "'"]) for _ in range(r.randint(0, 12))]
        b = [x for w in a if r.random() < 0.8 for x in ([w] if r.random() < 0.7 else [w.rstrip("'"), r.choice(letters) + "'"])]
        yield k, 2, a, bare(a), b, bare(b)


def rows(df):
    return sorted((x.ayah_id, x.edition_id, x.block // 2, x.k, x.op, x.ref_position, x.ref_text, x.var_text, x.same_rasm, x.same_archi) for x in df.collect())


def test_rows_of_batches_equal_those_of_rounds(spark, monkeypatch):
    pairs = spark.createDataFrame([*units(1500, 5), (5000, 2, None, None, ["a"], ["a"]), (5001, 2, ["a"], ["a"], [], []), (5002, 2, [], [], [], [])], SCHEMA).repartition(3)
    wanted = rows(variants.differences(pairs))
    assert rows(variants.of_units(pairs, 30)) == wanted != []
    monkeypatch.setattr(variants, "IN_ROW", 40)  # longer units take the rounds
    assert rows(variants.of_units(pairs)) == wanted


def test_few_pairs_are_held_at_a_time(spark, monkeypatch):
    found = []
    split = matching._split
    monkeypatch.setattr(matching, "AT_A_TIME", 100)
    monkeypatch.setattr(matching, "_split", lambda *runs: found.append(int(runs[3].sum())) or split(*runs))
    import pyarrow as pa

    columns = [pa.array(c, pa.list_(pa.string())) for c in [*zip(*[u[2:] for u in units(300, 6)], strict=True)]]
    got = matching.rows.func(*columns)
    assert len(got) == 300 and len(found) > 10 and max(found) <= 200 + 12 * 24


def test_what_is_asked_of_units_is_asked_before_they_are_aligned(spark):
    pairs = spark.createDataFrame([*units(20, 7)], SCHEMA)
    plan = variants.of_units(pairs, 30).filter("ayah_id = 3")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.rindex("ayah_id#") and "(ayah_id#" in plan[plan.index("ArrowEvalPython") :]
