"""Roots, lemmas, skeletons: grouped views of the words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def present(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "")


def roots(words: DataFrame) -> DataFrame:
    """words: id, root, lemma, surah. Words are counted by all that is told apart first, of which there is little, so that the distinct counts are not made of words."""
    told = words.filter(present("root")).groupBy("root", "lemma", "surah").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    return told.groupBy(F.col("root").alias("text")).agg(F.sum("n").alias("word_count"), F.count_distinct("lemma").alias("lemma_count"), F.count_distinct("surah").alias("surah_count"), F.min("first").alias("first_word_id")).withColumn("letters", F.length("text"))


def lemmas(words: DataFrame) -> DataFrame:
    # a least string is not kept in a hash table of words, so roots of a lemma are told apart first
    told = words.filter(present("lemma")).groupBy("lemma", "root").agg(F.count(F.lit(1)).alias("n"))
    return told.groupBy(F.col("lemma").alias("text")).agg(F.min("root").alias("root"), F.sum("n").alias("word_count"))


def find_roots(root: DataFrame, like: str, skeleton: str, limit: int = 60) -> DataFrame:
    """Roots that contain a string (letters A-Z in either case; % and _ are wildcards) or have a skeleton, most frequent first."""
    hit = F.col("text").ilike(f"%{like}%") | (F.col("archigraphemic") == skeleton)
    return root.filter(hit).orderBy(F.desc("word_count"), "text").limit(limit)


def first_of_each(rows: DataFrame, group: str | list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group, in one window instead of a query for each parent."""
    keys = [group] if isinstance(group, str) else group
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")


def readings(words: DataFrame) -> DataFrame:
    """How often each skeleton is read as each rasm."""
    return words.groupBy("archigraphemic", "rasm").agg(F.count(F.lit(1)).alias("occurrences"))


def ambiguous(words: DataFrame) -> DataFrame:
    """Skeletons with more than one reading. The readings are counted first, so a frequent word is a single row when they are."""
    return readings(words).groupBy("archigraphemic").agg(F.count(F.lit(1)).alias("readings"), F.sum("occurrences").alias("occurrences")).filter("readings > 1")


def most_ambiguous(words: DataFrame, limit: int = 40) -> DataFrame:
    return ambiguous(words).orderBy(F.desc("readings"), F.desc("occurrences"), "archigraphemic").limit(max(0, min(int(limit), 200)))
