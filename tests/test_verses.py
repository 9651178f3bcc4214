"""What is made from whole verses equals what is made row by row, and only what is asked for is made."""

import os

from pyspark.sql import functions as F

from strataglyph.operators import align, index, morphology, search
from strataglyph.operators.api import Api
from strataglyph.plans import stored
from strataglyph.sources import shared

from .conftest import SMALL


def test_words_of_verses_equal_those_of_rows(spark):
    words = [[[("وَ", "P", "PREF|w"), ("قَالَ", "V", "STEM|ROOT:قول|LEM:قال")], [("ا", "N", "STEM")]], [[("ءا", "N", "ROOT:أ|LEM:ا"), ("ٓ", "S", "SUFF")]]]
    lines = [(100 * v + 10 * w + s, v + 1, w + 1, s + 1, *x) for v, verse in enumerate(words) for w, word in enumerate(verse) for s, x in enumerate(word)]
    wanted = morphology.compile_words(spark.createDataFrame(lines, "line int, ayah_id long, place int, part int, form string, pos string, features string"))
    verses = spark.createDataFrame([(1, words[0], 0, 0), (2, words[1], 2, 3)], "ayah_id long, words array<array<struct<form:string,pos:string,features:string>>>, before long, before_segments long")
    for got, own in zip(morphology.words_of_verses(verses), wanted, strict=False):
        assert sorted(map(str, got.select(*own.columns).collect())) == sorted(map(str, own.collect())) != []


def test_blocks_of_texts_equal_those_of_places(spark):
    rows = [(e, k * 300, None if k == 5 else " ".join(f"w{(k * e + i) % 7}" for i in range(k))) for e in (1, 2) for k in range(12)]
    texts = spark.createDataFrame([*rows, (1, 600, "w1 w2")], "e long, k long, t string").repartition(3)
    got = index.blocks_of_texts(texts, ("e",), "k", {"t": search.terms(F.col("t"))}, "level").drop("level")
    own = index.blocks(search.postings(texts, ["e", "k"], "t"), ("e",), "k")
    assert sorted(map(str, got.select(*own.columns).collect())) == sorted(map(str, own.collect())) != []


def test_tokens_are_placed_in_one_row_and_not_moved(spark):
    texts = spark.createDataFrame([(1, 1, " aa　b\n\nc", 10), (2, 1, "a b", 20), (3, 1, None, 30)], "ayah_id long, edition_id long, plain string, char_start long")
    words = spark.createDataFrame([(7, 1, 1, "aa"), (8, 1, 2, "b"), (9, 1, 3, "c"), (10, 2, 1, "a"), (11, 3, 1, "x")], "id long, ayah_id long, position int, form string")
    aligned, odd = align.align(texts, words)
    assert sorted(tuple(x) for x in aligned.collect()) == [(7, 1, "aa", 11, 13), (8, 1, "b", 14, 15), (9, 1, "c", 17, 18)]
    assert [(x.ayah_id, x.text_tokens, x.corpus_words) for x in odd.collect()] == [(2, 2, 1)]
    assert "Window" not in aligned._jdf.queryExecution().optimizedPlan().toString()


def test_a_few_words_are_found_without_a_table_of_all(spark):
    t = stored.Bound(spark, SMALL, shared.folder(spark))
    got = Api(t.live()).words_of(1, 2).select("ayah_id", "position").collect()
    assert got and {x.ayah_id for x in got} <= {1, 2}
    assert not {"word", "segment", "word_text"} & {*os.listdir(t.folder.removeprefix("file:"))}
