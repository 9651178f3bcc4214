"""The unwritten tables of the bound store: what is not asked for is not made, and what is asked for is what the written ones hold."""

import os

from pyspark.sql import functions as F

from strataglyph.operators import lexicon
from strataglyph.operators.api import Api
from strataglyph.plans import stored
from strataglyph.sources import shared

from .conftest import SMALL


def bound(spark):
    t = stored.Bound(spark, SMALL, shared.folder(spark))
    return t, lambda: {*os.listdir(t.folder.removeprefix("file:"))}


def test_live_tables_equal_the_written_ones(spark):
    t = stored.compiled(spark, SMALL)
    live = t.live()
    for name in ("word", "segment", "ayah_text", "word_text", "spine_exception", "root", "lemma"):
        columns = [c for c in t[name].columns if c in live[name].columns and c != "detail"]
        got, own = (x[name].select(*columns).selectExpr(*[f"cast({c} as string) {c}" for c in columns]) for x in (live, t))
        assert got.count() == own.count() > 0 and got.exceptAll(own).isEmpty(), name


def test_meta_compiles_no_table_of_words_or_texts(spark):
    t, made = bound(spark)
    assert Api({n: t.live()[n] if n != "variant" else spark.range(0) for n in ("surah", "ayah", "word", "segment", "root", "lemma", "variant", "ayah_text", "spine_exception", "edition", "build")}).meta()["counts"]["word"] > 0
    assert not made() & {"word", "segment", "ayah_text", "text_kept", "spine_exception", "root", "lemma"}


def test_verses_are_written_once_and_pass_no_tokens_to_python(spark):
    t, made = bound(spark)
    assert t.made.verse.count() > 0 and made() == {"verse"}
    assert "_at" in spark.read.parquet(f"{t.folder}/verse").columns  # the ranges themselves


def test_search_indexes_the_rung_and_the_edition_asked_for(spark):
    t, made = bound(spark)
    live = t.live(("rasm", 1))
    assert [tuple(r) for r in live["postings"].select("level", "edition_id").distinct().collect()] == [("rasm", 1)]
    assert not made() & {"ayah_text", "text_kept", "postings", "term"}


def test_root_is_sought_where_words_are_made(spark):
    t, made = bound(spark)
    q = t.live()["word"].first().root
    assert Api(t.live()).root(q)["root"]["word_count"] > 0
    assert not made() & {"root", "word"}


def test_roots_keep_no_strings_of_words_in_a_sort(spark):
    words = spark.createDataFrame([(1, "ab", "abc", 1), (2, "ab", "abd", 1), (3, "ab", "abc", 2), (4, None, None, 2), (5, "", "x", 1)], "id long, root string, lemma string, surah int")
    for got in (lexicon.roots(words), lexicon.lemmas(words).filter("text <> 'x'")):
        assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString().split("hashpartitioning")[-1]
    assert [r.asDict() for r in lexicon.roots(words).collect()] == [{"text": "ab", "word_count": 3, "lemma_count": 2, "surah_count": 2, "first_word_id": 1, "letters": 2}]
    assert sorted((r.text, r.root, r.word_count) for r in lexicon.lemmas(words).collect()) == [("abc", "ab", 2), ("abd", "ab", 1), ("x", "", 1)]


def test_shown_texts_do_not_pass_through_the_driver(spark):
    t, made = bound(spark)
    got = Api(t.live()).shown("Q2", ["uthmani-warsh", "uthmani-hafs"], "rasm")
    assert got.columns == ["slug", "ayah_id", "text"] and "LocalTableScan [slug" not in got._jdf.queryExecution().toString()
    assert got.groupBy("slug").agg(F.count(F.lit(1))).count() == 2 and "ayah_text" not in made()


def test_words_of_a_shape_are_sought_once(spark):
    t, made = bound(spark)
    asked = t.live()["word"].filter("ayah_id = 1").orderBy("id").first().rasm
    got = Api(t.live()).skeleton(asked)["readings"]
    assert got and all(1 <= len(r["examples"]) <= 4 for r in got) and "word" not in made()


def test_what_alignment_is_asked_for_is_not_worked_out_again(spark):
    """A filter or an explode on top of worked-out columns is not pushed into what they are made from."""
    from strataglyph.operators import variants

    rows = [(k, 2, [f"t{i}" for i in range(9)], [f"t{i}" for i in range(9) if i != k]) for k in range(5)]
    pairs = spark.createDataFrame(rows, "ayah_id long, edition_id long, a array<string>, b array<string>")
    chains = variants.aligned(pairs).filter("codes is not null")
    assert chains._jdf.queryExecution().optimizedPlan().toString().count("array_position") == 1
    assert variants.opcodes(pairs).filter("op = 'delete'").count() == 5


def test_verses_are_dealt_and_cut_once(spark):
    from strataglyph.plans import bindings

    got = bindings.verses(spark, SMALL)
    assert got.rdd.getNumPartitions() > 1 and got._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
