import pytest
from pyspark.sql import functions as F

from strataglyph.functions import features as ft
from strataglyph.functions import refs as R

def spellings():
    """Every depth of a reference in several spellings, with what it is shown as; and texts that are none."""
    for depth, parts in enumerate(((78,), (36, 58), (18, 9, 4), (24, 35, 17, 2)), 1):
        shown = "Q" + ":".join(map(str, parts))
        bare = shown[1:]
        for text in (shown, bare, f"q{bare}", f"\t{shown} ", bare.translate(str.maketrans("0123456789", "٠١٢٣٤٥٦٧٨٩"))):
            yield text, shown, R.PARTS[depth - 1]
    for text in ("Q114:0", "114:6:0", "7:1:2:0", "0", "999:1", "Q120", "one:2", "5:", ":5", "Q", "5:+1", "1:2:3:4:", "9:1:1:1:1", "4.5", "   "):
        yield text, None, None


GOOD = {t: shown for t, shown, _ in spellings() if shown}
BAD = [t for t, shown, _ in spellings() if not shown]


def test_strings_and_columns_agree(spark):
    rows = [(t,) for t in [*GOOD, *BAD]]
    df = spark.createDataFrame(rows, "t string").withColumn("r", R.parse(F.col("t"))).select("t", R.show(F.col("r")).alias("s"), R.level(F.col("r")).alias("level"))
    for row in df.collect():
        assert row.s == GOOD.get(row.t)
        if row.t in GOOD:
            assert str(R.Ref.parse(row.t)) == row.s
            assert R.Ref.parse(row.t).level == row.level
        else:
            with pytest.raises(R.RefError):
                R.Ref.parse(row.t)


def test_ranges():
    for text, start, end in (("Q36:1-12", "Q36:1", "Q36:12"), ("9:128-10:3", "Q9:128", "Q10:3"), ("Q55-57", "Q55", "Q57"), ("Q80", "Q80", "Q80")):
        r = R.RefRange.parse(text)
        assert (str(r.start), str(r.end)) == (start, end)
        assert R.RefRange.parse(str(r)) == r
    for text in ("Q40:8-40:7", "Q12-11", "Q16:90:2-5"):  # of a word, only the surah is taken over, so the last runs back to 16:5
        with pytest.raises(R.RefError):
            R.RefRange.parse(text)
    with pytest.raises(R.RefError):
        R.Ref(6, None, 1)


def test_features(spark):
    df = spark.createDataFrame([("N|ROOT:|K:a:b|N|K:c",), ("PREF|LEM:x",), (None,), ("",)], "f string")
    f = F.col("f")
    rows = df.select(ft.feature(f, "ROOT").alias("root"), ft.feature(f, "K").alias("k"), ft.tag(f).alias("tag"), ft.pairs(f).alias("p")).collect()
    assert (rows[0].root, rows[0].k, rows[0].tag) == ("", "a:b", "N")
    assert [tuple(x) for x in rows[0].p] == [("N", ""), ("ROOT", ""), ("K", "a:b"), ("N", ""), ("K", "c")]
    assert (rows[1].root, rows[1].tag) == (None, "PREF")
    assert (rows[2].root, rows[2].p) == (None, [])
    assert rows[3].tag == ""
