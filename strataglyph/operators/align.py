"""Position alignment of an edition's tokens with the words of the spine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ladder import archigraphemic_of_rasm, normalize
from .spine import spots


def align(texts: DataFrame, words: DataFrame, along: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(aligned, exceptions) of texts (ayah_id, edition_id, plain, char_start) and words (id, ayah_id, position, form).

    An ayah with as many tokens as words is aligned position by position; any
    other is one exception with both spellings, and not aligned at all. along: keys of
    the ayah (ayah_id) that aligned words keep, so that those of a few ayahs are
    found without making the others.
    """
    # what an ayah has meets in one row, both ways; tokens and words are not moved one by one
    of_ayah = words.groupBy("ayah_id").agg(F.array_sort(F.collect_list(F.struct("position", "form", "id"))).alias("w"))
    return align_rows(texts.select("ayah_id", "edition_id", "plain", "char_start").join(of_ayah, "ayah_id"), along)


def align_rows(ayahs: DataFrame, along: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """align of ayahs that hold their words in w, an array of position, form and id: nothing is moved. Texts without char_start give aligned words without places."""
    held = ayahs.withColumn("t", spots(F.col("plain")))
    same = F.size("t") == F.size("w")
    at = lambda x: F.get("t", x["position"] - 1)
    met = F.transform("w", lambda x: F.struct(x["id"].alias("word_id"), at(x)["token"].alias("form"), at(x)["start"].alias("start")))
    placed = "char_start" in ayahs.columns
    rows = held.filter(same).select("ayah_id", "edition_id", *["char_start"] * placed, F.explode(met).alias("x")).filter("x.form is not null")
    places = []
    if placed:
        start = F.col("char_start") + F.col("x.start")
        places = [start.alias("char_start"), (start + F.length("x.form")).alias("char_end")]
    aligned = rows.select("x.word_id", "edition_id", "x.form", *places, *along)
    detail = F.struct(F.transform("t", lambda x: x["token"]).alias("text"), F.transform("w", lambda x: x["form"]).alias("corpus"))
    exceptions = held.filter(~same).select("ayah_id", "edition_id", F.size("t").alias("text_tokens"), F.size("w").alias("corpus_words"), detail.alias("detail"))
    return aligned, exceptions


def spelled_as_aligned(words: DataFrame, aligned: DataFrame) -> DataFrame:
    """The words with rasm and archigraphemic taken from the edition's spelling where there is one."""
    own = aligned.select("word_id", normalize(F.col("form"), "rasm").alias("_rasm")).withColumn("_archi", archigraphemic_of_rasm(F.col("_rasm")))
    joined = words.join(own, words["id"] == own["word_id"], "left")
    return joined.select(*[F.coalesce({"rasm": "_rasm", "archigraphemic": "_archi"}[c], c).alias(c) if c in ("rasm", "archigraphemic") else words[c] for c in words.columns])
