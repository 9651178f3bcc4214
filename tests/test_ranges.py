import random

import pytest
from pyspark.sql import functions as F

from strataglyph.functions import refs
from strataglyph.operators import spine

SPELLED = ["Q1", "1:2", "q2:255-257", "Q2:255-3:1", "2-4", "Q1:1-Q2", "Q1:2:3-4", "Q1:1-2:3:4", " Q7:3 - 9 ", "Q5:9-8", "Q2-1", "Q1:1-1:1", "1-", "-1", "", "x", "1:0", "115", "Q1:1-2-3", "Q1:2-1:2:5", "Q٢:٣-٥", "1:1:1:1-2", "Q3:4-Q3:4", None]


def plain(text):
    try:
        r = refs.RefRange.parse(text)
    except refs.RefError:
        return None
    return str(r), tuple(r.start.__dict__.values()), tuple(r.end.__dict__.values())


def test_columns_parse_ranges_as_strings_do(spark):
    r = random.Random(1)
    more = ["".join(r.choice(("Q", "1", "2", "12", ":", ":3", "-", " ", "4:5")) for _ in range(r.randint(1, 7))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in SPELLED + more], "t string")
    rows = df.select("t", refs.parse_range(F.col("t")).alias("r")).select("t", refs.show_range(F.col("r")).alias("s"), "r").collect()
    for row in rows:
        got = (row.s, tuple(row.r.start), tuple(row.r.end)) if row.r else None
        assert got == (plain(row.t) if row.t is not None else None), row.t


@pytest.mark.parametrize("widths", ((1, 3, 9), (1, 64, 4096, 262_144)))
def test_members_of_many_ranges(spark, monkeypatch, widths):
    monkeypatch.setattr(spine, "WIDTHS", widths)
    r = random.Random(2)
    members = sorted(r.sample(range(1, 2000), 600))
    ranges = [(k, a, a + r.choice((-1, 0, 1, 7, 63, 64, 65, 500, 3000))) for k, a in enumerate(r.choices(range(1, 2000), k=150))] + [(900, None, 5), (901, 5, None), (902, 0, 10**6)]
    df = spark.createDataFrame(ranges, "k int, first_id long, last_id long")
    got = spine.within(df, spark.createDataFrame([(m,) for m in members], "id long"))
    assert sorted((x.k, x.id) for x in got.collect()) == sorted((k, m) for k, a, b in ranges if None not in (a, b) for m in members if a <= m <= b)
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


def test_intervals_are_few_and_apart(spark):
    df = spark.createDataFrame([(1, 300_000)], "first_id long, last_id long")
    found = [(spine.WIDTHS[x.level], x.node) for x in spine.intervals(df).collect()]
    assert len(found) <= 2 * 63 * 3 + 2
    covered = sorted((w * n, w * n + w) for w, n in found)
    assert covered[0][0] == 1 and covered[-1][1] == 300_001 and all(a[1] == b[0] for a, b in zip(covered, covered[1:], strict=False))
