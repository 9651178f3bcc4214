"""The compiled store: one Parquet folder a table, in a folder of its version.

A build writes a version that nobody reads yet. Its manifest holds what the
tables are: files with their sizes, row counts and digests. One rename of a
pointer publishes it, so readers find the old store or the new one, whole. Who
has read the pointer keeps that version until it expires.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import digest, index
from ..operators.sql import register
from .shared import delete, file_system

TABLES = ("build", "source", "surah", "ayah", "edition", "ayah_text", "word", "segment", "segment_feature", "word_text", "spine_exception", "root", "lemma", "variant", "annotation_layer", "annotation", "postings", "term")
EMPTY = {
    "annotation_layer": "id long, slug string, title string, description string, author string, method string, created_at string",
    "annotation": "id long, layer_id long, word_start long, word_end long, edition_id long, key string, value string, confidence double, evidence string, created_at string",
}
#: Columns by which a table's files are sorted, so that point lookups skip row groups.
SORTED = {"ayah_text": ["edition_id", "ayah_id"], "word": ["archigraphemic"], "word_text": ["edition_id", "word_id"], "variant": ["ayah_id"], "segment": ["word_id"], "root": ["text"], "postings": ["term", "level", "edition_id", "span"], "term": ["level", "term"]}
#: Tables that are written at a time.
AT_ONCE = 4
#: How a table's files are written, where it matters.
LAYOUT = {"postings": index.LAYOUT}


#: What the tables hold: a compiled table that lacks a column or has one of another kind is not written.
SCHEMA = {
    "build": "key string, value string",
    "source": "id string, source_set string, repo string, commit_sha string, path string, url string, sha256 string, bytes long, license string",
    "surah": "number int, name_ar string, name_en string, name_translit string, revelation_place string, ayah_count long, ayah_start long, ayah_end long",
    "ayah": "id long, surah int, number int, juz int, manzil int, page int, ruku int, maqra int, sajda int",
    "edition": "id long, slug string, name string, language string, kind string, riwayah string, orthography string, is_reference int, source_id string, note string",
    "ayah_text": "edition_id long, ayah_id long, raw string, nfc string, plain string, unvocalized string, rasm string, archigraphemic string, char_start long, char_end long, token_count int",
    "word": "id long, ayah_id long, position int, form string, root string, lemma string, pos string, rasm string, segment_count int, archigraphemic string",
    "segment": "id long, word_id long, position int, form string, pos string, tag string, root string, lemma string, features string",
    "segment_feature": "segment_id long, key string, value string",
    "word_text": "word_id long, edition_id long, form string, char_start long, char_end long",
    "spine_exception": "ayah_id long, edition_id long, text_tokens int, corpus_words int, detail struct<text:array<string>,corpus:array<string>>",
    "root": "text string, letters int, word_count long, lemma_count long, surah_count long, first_word_id long, archigraphemic string",
    "lemma": "text string, root string, word_count long",
    "variant": "id long, ayah_id long, edition_id long, op string, ref_position int, ref_text string, var_text string, same_rasm int, same_archi int",
    "postings": "term string, level string, edition_id long, span long, size int, n int, places array<bigint>",
    "term": "term string, level string, edition_id long, units long, positions long, blocks long",
} | EMPTY


def declared(df: DataFrame, name: str) -> DataFrame:
    """df with the columns that its table declares, in their order and kinds (and any others behind them)."""
    wanted = [c.split(" ", 1) for c in re.split(r", (?![^<]*>)", SCHEMA[name])]
    if missing := [c for c, _ in wanted if c not in df.columns]:
        raise ValueError(f"{name} lacks {', '.join(missing)}")
    return df.select(*[F.col(c).cast(kind).alias(c) for c, kind in wanted], *[c for c in df.columns if c not in {w for w, _ in wanted}])


def write(tables: dict[str, DataFrame], folder: str) -> None:
    """Writes tables into a folder, a few at a time, as many of them are small."""

    def put(name: str, df: DataFrame) -> None:
        ready = declared(df, name) if name in SCHEMA else df
        ordered = ready.sortWithinPartitions(*SORTED[name]) if name in SORTED else ready
        ordered.write.options(**LAYOUT.get(name, {})).mode("overwrite").parquet(f"{folder}/{name}")

    with ThreadPoolExecutor(AT_ONCE) as pool:
        for done in [pool.submit(put, name, df) for name, df in tables.items()]:
            done.result()


#: The tables that each view is made from.
VIEWED = {"v_ayah": ("surah", "ayah"), "v_word": ("ayah", "word"), "v_segment": ("ayah", "word", "segment")}


def views(t: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """v_ayah, v_word and v_segment: rows with their references spelled out."""
    return {name: view(t, name) for name in VIEWED}


def view(t: Mapping[str, DataFrame], name: str) -> DataFrame:
    """One of the views, from the tables that VIEWED names. Words and segments that carry the places of their verses (surah and ayah; word) need no join for them."""
    q = lambda *cs: F.concat(F.lit("Q"), F.concat_ws(":", *[F.col(c).cast("string") for c in cs]))
    if name == "v_ayah":
        surah = t["surah"].select(F.col("number").alias("_s"), "name_en", "name_ar")
        return t["ayah"].join(F.broadcast(surah), F.col("surah") == F.col("_s")).drop("_s").withColumn("ref", q("surah", "number"))
    if name == "v_segment" and {"surah", "ayah", "word"} <= {*t["segment"].columns}:
        return t["segment"].withColumn("ref", q("surah", "ayah", "word", "position"))
    word = t["word"]
    if not {"surah", "ayah"} <= {*word.columns}:
        place = t["ayah"].select(F.col("id").alias("_a"), "surah", F.col("number").alias("ayah"))
        word = word.join(place, F.col("ayah_id") == F.col("_a")).drop("_a")
    word = word.withColumn("ref", q("surah", "ayah", "position"))
    if name == "v_word":
        return word
    spot = word.select(F.col("id").alias("_w"), "surah", "ayah", F.col("position").alias("word"))
    return t["segment"].join(spot, F.col("word_id") == F.col("_w")).drop("_w").withColumn("ref", q("surah", "ayah", "word", "position"))


POINTER, MANIFEST = "_current", "_manifest.json"


class StoreError(ValueError):
    """A store that is not there, or not what its manifest says."""


def _put(spark: SparkSession, path: str, text: str) -> None:
    files, where = file_system(spark, path)
    out = files.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def _text(spark: SparkSession, path: str) -> str | None:
    files, where = file_system(spark, path)
    if not files.exists(where):
        return None
    stream = files.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def current(spark: SparkSession, folder: str) -> str:
    """Where the published version lies; a folder without a pointer is a version of itself."""
    version = _text(spark, f"{folder}/{POINTER}")
    return f"{folder}/{version}" if version else folder


def manifest(spark: SparkSession, path: str, tables: dict[str, DataFrame] | None = None) -> dict:
    """What a version's tables are: rows, digest, and files with their bytes."""
    held = tables or {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
    out = {r["name"]: {"rows": r["rows"], "digest": r["digest"], "files": _files(spark, f"{path}/{r['name']}")} for r in digest.content_digests(held, left_out=()).collect()}
    return {"made_at": datetime.now(UTC).isoformat(timespec="seconds"), "tables": out}


def _files(spark: SparkSession, path: str) -> dict[str, int]:
    files, where = file_system(spark, path)
    return {f.getPath().getName(): f.getLen() for f in files.listStatus(where) if not f.getPath().getName().startswith(("_", "."))}


@contextmanager
def version(spark: SparkSession, folder: str) -> Iterator[str]:
    """A new version's folder. It is published when the block ends; if it fails, all that was written goes and the store is as it was."""
    name = f"v-{datetime.now(UTC):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
    try:
        yield f"{folder}/{name}"
        _put(spark, f"{folder}/{name}/{MANIFEST}", json.dumps(manifest(spark, f"{folder}/{name}")))
        publish(spark, folder, name)
    except BaseException:
        delete(spark, f"{folder}/{name}")
        raise


def publish(spark: SparkSession, folder: str, name: str) -> None:
    """Points the store at a version, with one rename over the old pointer; a version without a manifest is none."""
    if name not in versions(spark, folder):
        raise StoreError(f"{folder} has no whole version {name}")
    _put(spark, (part := f"{folder}/{POINTER}.{uuid.uuid4().hex}"), name)
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    path = jvm.org.apache.hadoop.fs.Path
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(file_system(spark, folder)[0].getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(path(part), path(f"{folder}/{POINTER}"), over)


def versions(spark: SparkSession, folder: str) -> list[str]:
    """Names of the versions that are whole, oldest first."""
    files, where = file_system(spark, folder)
    names = [f.getPath().getName() for f in files.listStatus(where) if f.isDirectory() and f.getPath().getName().startswith("v-")]
    return sorted(n for n in names if files.exists(file_system(spark, f"{folder}/{n}/{MANIFEST}")[1]))


def expire(spark: SparkSession, folder: str, keep: int = 2) -> list[str]:
    """Deletes all but the last versions, never the published one; gives the names of those that went."""
    now = current(spark, folder).rsplit("/", 1)[-1]
    old = [n for n in versions(spark, folder)[: -keep or None] if n != now]
    for n in old:
        delete(spark, f"{folder}/{n}")
    return old


def damaged(spark: SparkSession, folder: str, deep: bool = False) -> list[str]:
    """What a published version lacks of its manifest: files that are gone or have another size; deep also reads the rows again."""
    path = current(spark, folder)
    told = _text(spark, f"{path}/{MANIFEST}")
    if told is None:
        raise StoreError(f"{folder} has no published version")
    wanted = json.loads(told)["tables"]
    wrong = [f"{name}/{f}" for name, t in wanted.items() for f, size in t["files"].items() if _files(spark, f"{path}/{name}").get(f) != size]
    if deep and not wrong:
        found = manifest(spark, path)["tables"]
        wrong = [name for name, t in wanted.items() if (found[name]["rows"], found[name]["digest"]) != (t["rows"], t["digest"])]
    return wrong


def read(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All tables and views of the published version, registered under their names for SQL. What is published later does not change them."""
    path = current(spark, folder)
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
    tables |= views(tables)
    register(tables)
    return tables


def write_json(payload: object, path: str) -> int:
    """Compact JSON with its characters as they are; returns the size in bytes."""
    return write_text(iter([json.dumps(payload, ensure_ascii=False, separators=(",", ":"), default=str)]), path)


def write_text(parts: Iterator[str], path: str) -> int:
    size = 0
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "wb") as f:
        for part in parts:
            size += f.write(part.encode())
    return size


def write_lines(df: DataFrame, folder: str) -> str:
    """df as JSON, a line a row, in as many files as it has partitions; gives the folder."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(folder)
    return folder


def json_rows(df: DataFrame) -> Iterator[str]:
    """A JSON list of df's rows, made on the executors; the driver holds one partition at a time."""
    yield "["
    for k, row in enumerate(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("r")).toLocalIterator()):
        yield ("," if k else "") + row.r
    yield "]"
