"""Words, segments and features from morphology rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import features as ft
from ..functions.ladder import archigraphemic_of_rasm, nfc, normalize
from .spine import ids

#: Between the segments of a word where a verse is one string.
_PART = "\x1f"
_SEGMENT = ("part", "form", "pos", "features", "root", "lemma", "tag")


def compile_words(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(word, segment, segment_feature) from rows: line, ayah_id, place (of the word), part (of the segment), form, pos, features.

    Words are numbered as the file first names them, segments by their part
    within the word. A word is spelled by its segments and described by its stem.
    """
    word, parts = words_and_segments(rows)
    segment = numbered_segments(parts)
    return word, segment, segment_features(segment)


def words_and_segments(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, its segments without ids): of rows as compile_words takes them."""
    described = rows.withColumn("form", nfc(F.col("form"))).withColumn("root", ft.feature(F.col("features"), "ROOT")).withColumn("lemma", ft.feature(F.col("features"), "LEM")).withColumn("tag", ft.tag(F.col("features")))
    grouped = described.groupBy("ayah_id", "place").agg(F.min("line").alias("line"), F.array_sort(F.collect_list(F.struct(*_SEGMENT))).alias("segments"))
    numbered = ids(grouped, ["line"], "id")
    placed = numbered.withColumn("position", F.row_number().over(Window.partitionBy("ayah_id").orderBy("id")))
    told = placed.withColumn("stem", ft.stem(F.col("segments"))).withColumn("form", F.concat_ws("", F.transform("segments", lambda s: s["form"])))
    word = told.select("id", "ayah_id", "position", "form", F.col("stem.root").alias("root"), F.col("stem.lemma").alias("lemma"), F.col("stem.pos").alias("pos"), normalize(F.col("form"), "rasm").alias("rasm"), F.size("segments").alias("segment_count"), "segments")
    word = word.withColumn("archigraphemic", archigraphemic_of_rasm(F.col("rasm")))
    parts = word.select(F.col("id").alias("word_id"), F.posexplode("segments").alias("k", "s"))
    return word.drop("segments"), parts


def numbered_segments(parts: DataFrame) -> DataFrame:
    return ids(parts, ["word_id", "k"], "id").select("id", "word_id", (F.col("k") + 1).alias("position"), "s.form", "s.pos", "s.tag", "s.root", "s.lemma", "s.features")


def words_of_verses(verses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, segment) as compile_words gives them, from whole verses: ayah_id, words (in order, an array of segments each: form, pos, features), before and before_segments (words and segments of all earlier verses). Other columns go along with the words, ayah_id with the segments.

    A verse tells all places, so nothing is moved, and what needs Python is
    asked for once a verse. Forms have no white space and no control characters.
    """
    along = [c for c in verses.columns if c not in ("ayah_id", "words", "before", "before_segments")]
    joined = F.array_join(F.transform("words", lambda w: F.array_join(F.transform(w, lambda s: F.coalesce(s["form"], F.lit(""))), _PART)), "\n")
    spelled = verses.withColumn("_nfc", nfc(joined))
    rasm = spelled.withColumn("_rasm", normalize(F.replace("_nfc", F.lit(_PART), F.lit("")), "rasm"))
    told = rasm.withColumn("_archi", archigraphemic_of_rasm(F.replace("_rasm", F.lit("\n"), F.lit(" ")))).withColumns({"_n": F.split("_nfc", "\n"), "_r": F.split("_rasm", "\n"), "_a": F.split("_archi", " ")})
    each = told.select("ayah_id", "before", *along, F.posexplode(F.arrays_zip(F.col("words").alias("s"), F.col("_n").alias("n"), F.col("_r").alias("r"), F.col("_a").alias("a"))).alias("p", "x"))
    described = F.transform("x.s", lambda s: F.struct(s["pos"].alias("pos"), s["features"].alias("features"), ft.feature(s["features"], "ROOT").alias("root"), ft.feature(s["features"], "LEM").alias("lemma")))
    stems = each.withColumn("segments", described).withColumn("stem", ft.stem(F.col("segments")))
    word = stems.select((F.col("before") + F.col("p") + 1).alias("id"), "ayah_id", (F.col("p") + 1).alias("position"), F.replace("x.n", F.lit(_PART), F.lit("")).alias("form"), F.col("stem.root").alias("root"), F.col("stem.lemma").alias("lemma"), F.col("stem.pos").alias("pos"), F.col("x.r").alias("rasm"), F.size("segments").alias("segment_count"), F.col("x.a").alias("archigraphemic"), *along)
    placed = F.flatten(F.transform("words", lambda w, i: F.transform(w, lambda s, k: F.struct(i.alias("w"), k.alias("k"), s["pos"].alias("pos"), s["features"].alias("features")))))
    forms = F.split("_nfc", f"[\n{_PART}]")
    parts = spelled.select("ayah_id", "before", "before_segments", F.posexplode(F.arrays_zip(placed.alias("s"), forms.alias("form"))).alias("p", "x"))
    f = F.col("x.s.features")
    segment = parts.select((F.col("before_segments") + F.col("p") + 1).alias("id"), (F.col("before") + F.col("x.s.w") + 1).alias("word_id"), (F.col("x.s.k") + 1).alias("position"), "x.form", "x.s.pos", ft.tag(f).alias("tag"), ft.feature(f, "ROOT").alias("root"), ft.feature(f, "LEM").alias("lemma"), f.alias("features"), "ayah_id")
    return word, segment


def segment_features(segment: DataFrame) -> DataFrame:
    """Long form of the feature blobs; a pair that repeats within a segment is kept once."""
    return segment.select(F.col("id").alias("segment_id"), F.explode(ft.pairs(F.col("features"))).alias("f")).select("segment_id", "f.key", "f.value").dropDuplicates()
