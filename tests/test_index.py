import random

import pytest
from pyspark.sql import functions as F

from strataglyph.operators import index, search
from strataglyph.sources.shared import kept


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(1)
    common = ["of", "the", "and"] + [f"w{i}" for i in range(40)]
    rows = [(k * 3, " ".join(r.choices(common, k=r.randint(0, 60)) + (["rare", "bird"] if k % 700 == 5 else []) + (["the"] * 4 if k % 50 == 0 else []))) for k in range(3000)]
    rows += [(5_000_000_000, "far the bird"), (7, "")]
    return kept(spark.createDataFrame(rows, "k long, rasm string").repartition(4), "texts")


@pytest.fixture(scope="module")
def held(texts):
    return kept(index.laid_out(index.blocks(search.postings(texts, "k", "rasm"), (), "k"), ()), "blocks", index.layout(4, 20_000))


@pytest.mark.parametrize("phrase", ("of the", "rare bird", "the rare", "the the", "the the the", "w1", "bird", "w1 w2 w3", "nowhere", "the nowhere", ""))
def test_phrases_equal_a_scan(texts, held, phrase):
    wanted = search.needle_terms(phrase, "rasm")
    got = index.phrase(held, index.dictionary(held, ()), wanted, (), "k")
    assert {x.k for x in got.collect()} == {x.k for x in search.phrase(texts, phrase).collect()}


def test_times(spark):
    df = spark.createDataFrame([(1, "a b a b a"), (2, "a a a")], "k long, rasm string")
    held = index.blocks(search.postings(df, "k", "rasm"), (), "k")
    of = lambda p: {x.k: x.times for x in index.phrase(held, index.dictionary(held, ()), p.split(), (), "k").collect()}
    assert of("a b") == {1: 2} and of("a") == {1: 3, 2: 3} and of("a a") == {2: 2} and of("b a b") == {1: 1}


def test_the_dictionary_counts(texts, held):
    got = {x.term: (x.units, x.positions) for x in index.dictionary(held, ()).collect()}
    for term, units, positions in search.postings(texts, "k", "rasm").groupBy("term").agg(F.countDistinct("k"), F.count("*")).collect():
        assert got[term] == (units, positions)


def scanned(df):
    """Rows that the scans of a query have given."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        else:
            if name.startswith("Scan parquet"):
                total += node.metrics().apply("numOutputRows").value()
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    return total


def test_a_lookup_reads_the_blocks_of_its_terms(held):
    everything, words = held.count(), index.dictionary(held, ())
    own = lambda *terms: held.filter(F.col("term").isin(*terms)).count()
    assert scanned(index.phrase(held, words, ["rare"], (), "k")) <= own("rare") + 20 < everything / 5
    # of a frequent term only the spans of the rare one
    assert scanned(index.phrase(held, words, ["the", "bird"], (), "k")) <= own("the", "bird") + 20 < everything / 5
