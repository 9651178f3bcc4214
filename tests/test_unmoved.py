"""What a verse or a document holds is worked out in its row: no table of words, texts or variants is written or moved for it."""

import os

from strataglyph.operators import export
from strataglyph.operators.api import Api
from strataglyph.plans import registry, stored
from strataglyph.sources import shared

from .conftest import SMALL


def bound(spark):
    t = stored.Bound(spark, SMALL, shared.folder(spark))
    return t, lambda: {*os.listdir(t.folder.removeprefix("file:"))}


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_documents_are_aligned_with_their_words_without_a_join(spark):
    got = registry.QUERIES["align_words"](spark, SMALL)
    assert "Join" not in plan(got) and "Aggregate" not in plan(got)


def test_exceptions_do_not_pass_through_the_driver(spark):
    t, _ = bound(spark)
    got = Api(t.live()).exceptional()
    assert got.count() == len(Api(t.live()).exceptions()["exceptions"]) > 0
    own = registry.QUERIES["payload_exceptions"](spark, SMALL)
    assert "LogicalRDD" not in plan(own) and "LocalRelation" not in plan(own)


def test_words_are_exported_from_their_verses(spark):
    t, made = bound(spark)
    got = export.word_rows(t.live())
    assert plan(got).count("Join") == plan(t.live()["word"]).count("Join") and not made() & {"word", "word_text", "ayah_text"}
    own = export.word_rows(t)
    assert got.count() == own.count() > 0 and got.selectExpr(*[f"cast({c} as string)" for c in own.columns]).exceptAll(own.selectExpr(*[f"cast({c} as string)" for c in own.columns])).isEmpty()


def test_variants_are_made_from_their_verses(spark):
    t, made = bound(spark)
    api, ids = Api(t.live()), ("block", "k", "id")
    got = api.counters(), api.apparatus(2), api.varied("Q1", True)
    assert not made() & {"variant", "ayah_text", "text_kept"}
    bare = lambda found: [{c: v for c, v in r.items() if c not in ids} for r in found]
    own = Api(t)
    assert got[0] == own.counters() and bare(got[1]["vocalic"]) == bare(own.apparatus(2)["vocalic"])
    assert bare(api.variants("Q1", True)) == bare(own.variants("Q1", True)) != []


def test_offsets_follow_each_other_over_batches_of_a_partition(spark):
    from pyspark.util import PythonEvalType

    from strataglyph.functions import tables

    tables.register(spark)
    spark.range(70).selectExpr("id", "cast(id % 5 as int) length", "id % 3 part").createOrReplaceTempView("_lengths")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        found = spark.sql("SELECT * FROM offsets_of(TABLE(SELECT id, length, part FROM _lengths) PARTITION BY part ORDER BY id)").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    at, wanted = [0, 0, 0], []
    for k in range(70):
        wanted.append((k, at[k % 3], at[k % 3] + k % 5))
        at[k % 3] += k % 5 + 1
    assert sorted(map(tuple, found)) == wanted
    assert tables.Offsets.evalType == PythonEvalType.SQL_ARROW_UDTF  # a batch at a time


def test_checks_write_no_words_segments_or_full_index(spark):
    from strataglyph.operators import checks

    t, made = bound(spark)
    whole = checks.all_checks(t.checked(), {"words": 1}, None, None).collect()
    assert {r.name for r in whole} >= {"search responds", "roots of words are listed"} and made() >= {"ayah_text", "word_text", "variant"}
    assert not made() & {"word", "segment", "segment_feature", "spine_exception", "root", "lemma", "postings", "term"}
