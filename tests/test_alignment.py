import random
from difflib import SequenceMatcher

from strataglyph.operators import variants

PAIRS = "ayah_id long, edition_id long, a array<string>, b array<string>"


def random_pairs(n, seed):
    r = random.Random(seed)
    for _ in range(n):
        alphabet = "abcdefgh"[: r.randint(1, 8)]
        a = [r.choice(alphabet) for _ in range(r.randint(0, 12))]
        b = [r.choice(alphabet) for _ in range(r.randint(0, 12))] if r.random() < 0.5 else [x for x in a if r.random() < 0.8 for x in ([x] if r.random() < 0.8 else [x, r.choice(alphabet)])]
        yield a, b


def test_opcodes_equal_the_recursive_definition(spark):
    """The standard library's matcher, of which the engine takes the result and not the code, is the definition here."""
    pairs = list(random_pairs(10_000, 1))
    df = spark.createDataFrame([(k, k % 3, a, b) for k, (a, b) in enumerate(pairs)], PAIRS).repartition(4)
    got: dict = {}
    for x in variants.opcodes(df).orderBy("ayah_id", "block").collect():
        steps = got.setdefault(x.ayah_id, [])
        if steps and steps[-1][0] == "equal" == x.op:  # neighbouring blocks of equal tokens are one
            steps[-1] = ("equal", steps[-1][1], x.i2, steps[-1][3], x.j2)
        else:
            steps.append((x.op, x.i1, x.i2, x.j1, x.j2))
    for k, (a, b) in enumerate(pairs):
        assert got.get(k, []) == SequenceMatcher(None, a, b, autojunk=False).get_opcodes(), (a, b)


def test_more_rounds_than_one_job_plans(spark, monkeypatch):
    monkeypatch.setattr(variants, "ROUNDS", 1)
    a = [f"t{i}" for i in range(64)]
    b = [x for i, x in enumerate(a) if i % 5]
    df = spark.createDataFrame([(1, 1, a, b), (2, 1, [], ["x"]), (3, 1, ["x"], []), (4, 1, [], [])], PAIRS)
    got = [(x.ayah_id, x.op, x.i1, x.i2, x.j1, x.j2) for x in variants.opcodes(df).filter("op <> 'equal'").orderBy("ayah_id", "block").collect()]
    assert got == [(1, *o) for o in SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if o[0] != "equal"] + [(2, "insert", 0, 0, 0, 1), (3, "delete", 0, 1, 0, 0)]


def test_rows_of_every_kind(spark):
    schema = "ayah_id long, edition_id long, ref_plain array<string>, ref_rasm array<string>, var_plain array<string>, var_rasm array<string>"
    plain = lambda *words: (list(words), [w.replace("'", "").replace("ء", "") for w in words])
    rows = [
        (1, 2, *plain("a", "b", "c"), *plain("a", "x", "y", "b", "c'")),  # in the middle, and a spelling
        (2, 2, *plain("a", "b", "c", "d"), *plain("a", "d")),
        (3, 2, *plain("a", "b"), *plain("p", "q", "r")),
        (4, 2, *plain("ء", "a", "ء", "b"), *plain("a'", "b", "c")),  # tokens without any rasm keep the places of others
        (5, 2, *plain("a"), *plain("a")),
    ]
    got = variants.differences(spark.createDataFrame(rows, schema))
    assert sorted((x.ayah_id, x.op, x.ref_position, x.ref_text, x.var_text, x.same_rasm) for x in got.collect()) == [
        (1, "insert", 2, "", "x y", 0), (1, "replace", 3, "c", "c'", 1), (2, "delete", 2, "b c", "", 0), (3, "replace", 1, "a b", "p q r", 0), (4, "insert", 5, "", "c", 0), (4, "replace", 2, "a", "a'", 1),
    ]
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()
