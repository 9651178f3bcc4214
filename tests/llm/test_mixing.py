from collections import Counter

from strataglyph.llm.mixing import mix

DOCS = "doc_id long, text string, source string, rate double, copy string"


def test_rates_and_edges(spark):
    rows = [(i, None, "a", 1.0, "c") for i in range(400)] + [(1000 + i, "t", "b", None, None) for i in range(100)] + [(5000 + i, "", None, None, None) for i in range(50)] + [(None, "x", "gone", 0.0, None)]
    df = spark.createDataFrame(rows, DOCS)
    got = mix(df, {"a": 1.0, "b": 2.0, None: 1.0, "gone": 0.0}, total=4000, names=("k", "of"))
    assert got.columns == [*df.columns, "k", "of"]
    n = Counter(r.source for r in got.collect())
    assert abs(n["a"] - 1000) < 130 and abs(n["b"] - 2000) < 180 and abs(n[None] - 1000) < 130 and n["gone"] == 0
    for r in got.filter("source = 'b'").collect():
        assert 1 <= r.k <= r.of
    again = mix(df.repartition(3), {"a": 1.0, "b": 2.0, None: 1.0, "gone": 0.0}, total=4000, names=("k", "of"))
    key = lambda d: Counter((r.doc_id, r.source, r.k) for r in d.collect())
    assert key(again) == key(got)
    assert mix(df, names=None).columns == df.columns
    assert mix(df.limit(0)).count() == 0


def test_large_rates(spark):
    df = spark.createDataFrame([(1, "t", "a", 0.0, "")], DOCS)
    n = mix(df, total=5000, names=None).count()
    assert abs(n - 5000) < 5 * 5000**0.5


def test_order_is_shuffled(spark):
    df = spark.range(2000).selectExpr("id as doc_id", "'s' as source")
    ids = [r.doc_id for r in mix(df, names=None).collect()]
    assert ids != sorted(ids)


def test_clashing_names_and_long_texts(spark):
    df = spark.createDataFrame([(k % 40, "t " * 500_000 if not k else None, "a", "mine", 1, 2) for k in range(80)], "doc_id long, text string, source string, copy string, _sg_0 int, _SG_1 int")
    got = mix(df, total=400)
    assert got.columns == ["doc_id", "text", "source", "_sg_0", "_SG_1", "copy", "n_copies"]
    rows = got.collect()
    assert abs(len(rows) - 400) < 100
    assert all(1 <= x["copy"] <= x.n_copies for x in rows)
    drawn = Counter((x.doc_id, x["copy"]) for x in rows)
    assert set(drawn.values()) == {2}  # repeated rows are drawn alike
    assert mix(df, names=None).columns == df.columns
