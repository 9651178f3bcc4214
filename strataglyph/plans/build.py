"""Raw files to compiled store."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..functions.ladder import LEVELS, archigraphemic_of_rasm, normalize, tokens, with_levels
from ..operators import align, digest, lexicon, morphology, search, spine, variants
from ..sources import raw, store
from ..sources.shared import kept
from .canon import EXPECTED


class BuildError(ValueError):
    """Sources that don't make a complete store."""


def refuse_incomplete(surah: DataFrame, expect: dict) -> None:
    """Fails unless the chapters and their verses are as many as expected."""
    found = {r.number: r.ayah_count for r in surah.select("number", "ayah_count").collect()}  # a row a chapter
    if "surahs" in expect and len(found) != expect["surahs"]:
        raise BuildError(f"{len(found)} chapters, expected {expect['surahs']}")
    wanted = dict(enumerate(expect.get("verses", ()), 1))
    if wrong := [f"chapter {n}: {found.get(n)} verses, expected {wanted.get(n)}" for n in sorted(found | wanted) if found.get(n) != wanted.get(n)] if wanted else []:
        raise BuildError("; ".join(wrong))


def refuse_partial_editions(ayah_text: DataFrame, edition: DataFrame, ayahs: int) -> None:
    """Fails unless every edition has a text for every ayah."""
    counts = ayah_text.groupBy(F.col("edition_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    short = edition.join(counts, "id", "left").select("slug", F.coalesce("n", F.lit(0)).alias("n")).filter(F.col("n") != ayahs).orderBy("slug").collect()
    if short:
        raise BuildError("; ".join(f"edition {r.slug}: {r.n} ayahs, expected {ayahs}" for r in short))


def spine_tables(surah: DataFrame, verse: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(surah, ayah) with ids and spans."""
    ayah = spine.dense_ids(verse, "surah", ["verse"], "number", "id")
    spans = spine.spans(verse.withColumnRenamed("surah", "number"), "number", "ayah")
    return surah.join(spans, "number"), ayah.drop("verse")


def edition_texts(editions: DataFrame, ayah: DataFrame) -> DataFrame:
    """ayah_text from raw verses (edition_id, pos, surah, verse, raw); verses off the spine fail."""
    ids = ayah.select("surah", F.col("number").alias("verse"), F.col("id").alias("ayah_id"))
    placed = editions.join(ids, ["surah", "verse"], "left")
    known = placed.withColumn("ayah_id", F.coalesce("ayah_id", F.raise_error(F.concat_ws(":", F.lit("no such verse"), F.col("surah").cast("string"), F.col("verse").cast("string"))).cast("long")))
    offset = spine.offsets(with_levels(known), "edition_id", "pos")
    return offset.select("edition_id", "ayah_id", *LEVELS, "char_start", "char_end", F.size(tokens(F.col("plain"))).alias("token_count"))


def variant_pairs(ayah_text: DataFrame, edition: DataFrame) -> DataFrame:
    """Each other Arabic edition's tokens beside the reference's, ayah by ayah. Rasm goes token by token, so both keep their places."""
    info = edition.select(F.col("id").alias("edition_id"), "kind", "is_reference")
    cut = ayah_text.join(F.broadcast(info), "edition_id").filter("kind = 'quran'").withColumn("p", tokens(F.col("plain"))).withColumn("r", rasm_by_token(F.col("plain")))
    ref = cut.filter("is_reference = 1").select("ayah_id", F.col("p").alias("ref_plain"), F.col("r").alias("ref_rasm"))
    return cut.filter("is_reference <> 1").select("ayah_id", "edition_id", F.col("p").alias("var_plain"), F.col("r").alias("var_rasm")).join(ref, "ayah_id")


def rasm_by_token(plain):  # noqa: ANN001, ANN202
    """Rasm keeps white space, so splitting at every single run keeps vanished tokens as ''."""
    bare = F.regexp_replace(plain, r"(?U)^\s+|\s+$", "")
    return F.split(normalize(F.regexp_replace(bare, r"(?U)\s+", "\n"), "rasm"), "\n")


def build(spark: SparkSession, root: str, lock_path: str, plan: dict, out: str) -> dict[str, DataFrame]:
    """Compiles the files below root into the store at out.

    plan: ``info`` and ``morphology`` (keys of the lock), and ``editions``, each
    with key, slug and what else the edition table has; one has is_reference.
    ``expect`` has the numbers of a complete store (those of ``canon`` by
    default); sources that don't reach them are refused, and verify reads them
    again from the store. ``chunks`` is where the chunk digests of files lie
    that the lock has roots of. Tables are written to a version of their own,
    which is published when it is whole; a build that fails leaves the store
    at out as it was.
    """
    with store.version(spark, out) as path:
        _compile(spark, root, lock_path, plan, path)
    return store.read(spark, out)


def _compile(spark: SparkSession, root: str, lock_path: str, plan: dict, out: str) -> None:
    expect = plan.get("expect", EXPECTED)
    lock = json.loads(Path(lock_path).read_text("utf-8"))

    def checked(key: str) -> str:
        raw.verify(spark, root, key, lock, plan.get("chunks"))
        return f"{root}/{key}"

    def saved(**tables: DataFrame) -> list[DataFrame]:
        store.write(tables, out)
        return [spark.read.parquet(f"{out}/{name}") for name in tables]

    surah, ayah = spine_tables(*raw.info(raw.text_of(raw.content(spark, root, plan["info"], lock))))
    rows = [(i, e["slug"], e.get("name") or e["slug"].replace("-", " ").title(), e.get("language", "ar"), e.get("kind", "quran"), e.get("riwayah"), e.get("orthography"), int(e.get("is_reference", False)), e["key"], e.get("note")) for i, e in enumerate(plan["editions"], 1)]
    edition = spark.createDataFrame(rows, "id long, slug string, name string, language string, kind string, riwayah string, orthography string, is_reference int, source_id string, note string")
    verses = None
    for i, e in enumerate(plan["editions"], 1):
        one = raw.edition_file(spark, checked(e["key"])).drop("file").withColumn("edition_id", F.lit(i).cast("long"))
        verses = one if verses is None else verses.unionByName(one)
    surah, ayah, edition, _ = saved(surah=surah, ayah=ayah, edition=edition, source=raw.source_rows(spark, lock))
    refuse_incomplete(surah, expect)
    (ayah_text,) = saved(ayah_text=edition_texts(verses, ayah))
    refuse_partial_editions(ayah_text, edition, ayah.count())
    postings, term = search.stored_index(ayah_text)
    saved(postings=postings, term=term)
    places = ayah.select("surah", F.col("number").alias("verse"), F.col("id").alias("ayah_id"))
    found = raw.morphology_file(spark, checked(plan["morphology"])).join(places, ["surah", "verse"], "left").withColumn("ayah_id", F.coalesce("ayah_id", F.raise_error(F.lit("morphology off the spine")).cast("long")))
    word, segment, feature = morphology.compile_words(found)
    reference = edition.filter("is_reference = 1").select(F.col("id").alias("edition_id"))
    segment, feature = saved(segment=segment, segment_feature=feature)
    word = kept(word, "word")
    aligned, exceptions = align.align(ayah_text.join(F.broadcast(reference), "edition_id", "left_semi"), word)
    aligned, exceptions = saved(word_text=aligned, spine_exception=exceptions)
    (word,) = saved(word=align.spelled_as_aligned(word, aligned))
    spans = spine.child_spans(word, "ayah_id", "id", "word")
    of_ayah = ayah.join(spans, ayah["id"] == spans["ayah_id"], "left").drop("ayah_id")
    of_surah = of_ayah.groupBy(F.col("surah").alias("number")).agg(F.min("word_start").alias("word_start"), F.max("word_end").alias("word_end"))
    # both are read from the tables that they take the place of
    ayah, surah = saved(ayah=kept(of_ayah, "ayah"), surah=kept(surah.join(of_surah, "number", "left"), "surah"))
    placed = word.join(ayah.select(F.col("id").alias("ayah_id"), "surah"), "ayah_id")
    roots = lexicon.roots(placed)
    saved(root=roots.withColumn("archigraphemic", archigraphemic_of_rasm(normalize(F.col("text"), "rasm"))), lemma=lexicon.lemmas(placed), variant=variants.numbered(variants.differences(variant_pairs(ayah_text, edition))))
    store.write({name: spark.createDataFrame([], kind) for name, kind in store.EMPTY.items()}, out)
    contents = {name: spark.read.parquet(f"{out}/{name}") for name in store.TABLES if name not in digest.LEFT_OUT}
    meta = {"version": __version__, "built_at": datetime.now(UTC).isoformat(timespec="seconds"), "sources_lock": raw.sha256_file(lock_path), "content_digest": digest.content_digest(contents), "levels": ",".join(LEVELS), "expect": json.dumps(expect | {"editions": [e["slug"] for e in plan["editions"]]})}
    store.write({"build": spark.createDataFrame(list(meta.items()), "key string, value string")}, out)
