"""The six files of the static site. Rows are turned to JSON on the executors and written as they come."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ladder import MARK_CLASSES
from ..sources.store import json_rows, write_json, write_text
from . import lexicon, variants
from .api import Api, _dicts

CLUSTERS, ROOTS, EXAMPLES = 60, 60, 3


def word_rows(t: dict[str, DataFrame]) -> DataFrame:
    """Every word as it is exported: in the reference's spelling where it has one. A store that has spelled_word, words beside that spelling, needs no join for it."""
    shown = lambda words: words.select("surah", "ayah", "position", F.coalesce(F.nullif("text_form", F.lit("")), "form").alias("form"), "root", "lemma", "pos")
    if "spelled_word" in t:
        return shown(t["spelled_word"])
    reference = t["edition"].filter("is_reference = 1").select(F.col("id").alias("edition_id"))
    spelled = t["word_text"].join(F.broadcast(reference), "edition_id", "left_semi").select("word_id", F.col("form").alias("text_form"))
    return shown(t["v_word"].join(spelled, F.col("id") == F.col("word_id"), "left"))


def export(t: dict[str, DataFrame], folder: str) -> dict[str, int]:
    """Writes meta, ayahs, variants, skeletons, roots and words; returns their sizes."""
    reference = F.broadcast(t["edition"].filter("is_reference = 1").select(F.col("id").alias("edition_id"), "riwayah"))
    api = Api(t)
    meta = api.meta() | {"tree": api.tree(), "classes": MARK_CLASSES, "exceptions": api.exceptions()["exceptions"], "sources": _dicts(t["source"].select("source_set", "repo", "commit_sha", "license").distinct().orderBy("source_set", "repo"))}
    ayahs = t["ayah_text"].join(reference, "edition_id").join(t["ayah"].select(F.col("id").alias("ayah_id"), "surah", "number"), "ayah_id").orderBy("ayah_id")
    own = t["edition"].filter("is_reference = 1").select("riwayah").first()
    rows = variants.apparatus(t["variant"], t["edition"].select(F.col("id").alias("edition_id"), "slug", "riwayah"), own.riwayah if own else None)
    changed = rows.filter("same_rasm = 0").withColumn("is_orthographic", F.col("bucket") == "orthographic").orderBy("ayah_id", "edition_id", "id")
    vocalic = variants.vocalic_counts(t["variant"]).orderBy("ayah_id")
    clusters = lexicon.most_ambiguous(t["word"], CLUSTERS)
    within = t["v_word"].join(F.broadcast(clusters.select("archigraphemic")), "archigraphemic", "left_semi")
    some = lexicon.first_of_each(within, ["archigraphemic", "rasm"], ["id"], EXAMPLES).groupBy("archigraphemic", "rasm").agg(F.array_sort(F.collect_list(F.struct("id", "ref", "form"))).alias("examples"))
    read = lexicon.readings(within).join(some, ["archigraphemic", "rasm"]).groupBy("archigraphemic").agg(F.sort_array(F.collect_list(F.struct("occurrences", "rasm", "examples")), False).alias("list"))
    skeletons = clusters.join(read, "archigraphemic").orderBy(F.desc("readings"), F.desc("occurrences"), "archigraphemic")
    top = t["root"].orderBy(F.desc("word_count"), "text").limit(ROOTS)
    said = lexicon.first_of_each(t["v_word"].join(F.broadcast(top.select(F.col("text").alias("root"))), "root", "left_semi"), "root", ["id"], EXAMPLES).groupBy("root").agg(F.array_sort(F.collect_list(F.struct("id", "ref", "form"))).alias("examples"))
    roots = top.join(said, top["text"] == said["root"], "left").drop("root").orderBy(F.desc("word_count"), "text")
    words = word_rows(t).orderBy("surah", "ayah", "position")
    sizes = {"meta": write_json(meta, f"{folder}/meta.json")}
    sizes |= {name: write_text(json_rows(df), f"{folder}/{name}.json") for name, df in (("ayahs", ayahs), ("skeletons", skeletons), ("roots", roots), ("words", words))}
    sizes["variants"] = write_text(chain(['{"rows":'], json_rows(changed), [',"vocalic":'], json_rows(vocalic), ["}"]), f"{folder}/variants.json")
    if words.count() != t["word"].count():
        raise AssertionError("not every word was exported")
    return sizes


def totals(sizes: dict[str, int], most: int = 6) -> tuple[int, list[tuple[str, int]]]:
    """Bytes in all, and the largest files, largest first."""
    return sum(sizes.values()), sorted(sizes.items(), key=lambda x: (-x[1], x[0]))[:most]
