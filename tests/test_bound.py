"""The bound store: what a query doesn't read is not compiled for it."""

import os

from pyspark.sql import functions as F

from strataglyph.plans import stored
from strataglyph.sources import shared, store

from .conftest import SMALL


def test_tables_are_compiled_when_they_are_read(spark):
    t = stored.Bound(spark, SMALL, shared.folder(spark))
    made = lambda: set(os.listdir(t.folder.removeprefix("file:")))
    assert t["ayah"].count() and made() == {"verse", "ayah"}
    assert t["v_ayah"].count() and made() == {"verse", "ayah", "surah"}
    assert t["ayah_text"].count() and made() == {"verse", "ayah", "surah", "text_kept", "ayah_text"}
    assert "word" in t and set(t) == {*store.TABLES, *store.VIEWED}


def test_spans_of_verses_are_those_of_their_words(spark):
    t = stored.compiled(spark, SMALL)
    spans = t["word"].groupBy(F.col("ayah_id").alias("id")).agg(F.min("id").alias("word_start"), F.max("id").alias("word_end"))
    own = t["ayah"].select("id", "word_start", "word_end")
    assert own.count() == spans.count() and own.exceptAll(spans).isEmpty()


def test_words_that_carry_their_places_are_not_joined(spark):
    t = {
        "ayah": spark.range(3).selectExpr("id", "1 AS surah", "id AS number"),
        "word": spark.range(5).selectExpr("id", "id AS ayah_id", "7 AS surah", "id AS ayah", "2 AS position"),
        "segment": spark.range(5).selectExpr("id", "id AS word_id", "7 AS surah", "id AS ayah", "2 AS word", "1 AS position"),
    }
    for name, ref in (("v_word", "Q7:4:2"), ("v_segment", "Q7:4:2:1")):
        view = store.view(t, name)
        assert "Join" not in view._jdf.queryExecution().optimizedPlan().toString()
        assert view.filter("id = 4").first().ref == ref
    plain = store.view(t | {"word": t["word"].drop("surah", "ayah")}, "v_word")
    assert plain.filter("id = 2").first().ref == "Q1:2:2"
