"""Raw files: declarations, lock, verified reads, and the three upstream formats."""

from __future__ import annotations

import hashlib
import json
import shutil
import tomllib
import urllib.request
from datetime import UTC, datetime
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import splits
from .shared import file_system, kept

#: Upstream names of the places of revelation.
PLACES = {"Mecca": "meccan", "Madina": "medinan", "Medina": "medinan"}
INFO = "chapters array<struct<chapter:bigint,name:string,englishname:string,arabicname:string,revelation:string,verses:array<struct<verse:bigint,juz:int,manzil:int,page:int,ruku:int,maqra:int,sajda:string>>>>"
VERSE = "chapter bigint, verse bigint, text string"
EDITION = "quran array<struct<chapter:bigint,verse:bigint,text:string>>"


class SourceError(ValueError):
    """A raw file that is undeclared, missing or not what was locked."""


def declarations(spark: SparkSession, toml_path: str) -> DataFrame:
    """One row a declared file: key, source, kind, repo, commit, path, license, url, local."""
    rows = []
    for s in tomllib.loads(Path(toml_path).read_text("utf-8"))["source"]:
        if s["kind"] != "github-raw":
            raise SourceError(f"source {s['id']}: unknown kind {s['kind']}")
        for path in s["files"]:
            url = f"https://raw.githubusercontent.com/{s['repo']}/{s['commit']}/{path}"
            rows.append((f"{s['id']}/{path}", s["id"], s["kind"], s["repo"], s["commit"], path, s.get("license"), url, f"{s['id']}/{path}"))
    return spark.createDataFrame(rows, "key string, source string, kind string, repo string, commit string, path string, license string, url string, local string")


def digests(spark: SparkSession, root: str) -> DataFrame:
    """(local, sha256, bytes) of every file below root."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = F.regexp_replace(F.col("path"), "^[a-z]+:/+", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    return found.select(F.replace(prefix, F.lit(base), F.lit("")).alias("local"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def compare(declared: DataFrame, found: DataFrame, lock: DataFrame) -> DataFrame:
    """What is wrong, all of it at once: key and problem (missing, unlocked, changed, undeclared). lock: key, sha256."""
    joined = declared.join(found, "local", "left").join(lock.select("key", F.col("sha256").alias("locked")), "key", "full_outer")
    problem = F.when(F.col("local").isNull(), "undeclared").when(F.col("sha256").isNull(), "missing").when(F.col("locked").isNull(), "unlocked").when(F.col("sha256") != F.col("locked"), "changed")
    return joined.select("key", problem.alias("problem")).filter("problem is not null")


def write_lock(declared: DataFrame, found: DataFrame, path: str) -> dict:
    """Locks what is there; the time changes only with the files."""
    files = {r.key: {k: r[k] for k in ("source", "repo", "commit", "path", "url", "sha256", "bytes", "license")} for r in declared.join(found, "local").orderBy("key").collect()}
    old = json.loads(Path(path).read_text("utf-8")) if Path(path).exists() else {}
    stamp = old["generated_at"] if old.get("files") == files else datetime.now(UTC).isoformat(timespec="seconds")
    lock = {"generated_at": stamp, "files": files}
    Path(path).write_text(json.dumps(lock, ensure_ascii=False, indent=1), "utf-8")
    return lock


def download(url: str, path: Path, seconds: float = 120) -> None:
    """Fetches a file; it takes its place only when it is whole."""
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".part")
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "strataglyph"}), timeout=seconds) as answer, part.open("wb") as out:
            shutil.copyfileobj(answer, out)
    except OSError as error:
        part.unlink(missing_ok=True)
        raise SourceError(f"{url}: {error}") from error
    part.replace(path)


def fetch(spark: SparkSession, declared: DataFrame, root: str, lock_path: str, force: bool = False, relock: bool = False) -> dict:
    """Fetches declared files that are missing (with force, all), compares them with the lock and gives it; with relock, or without a lock, they are locked anew."""
    for r in declared.orderBy("key").collect():
        path = Path(root, r.local)
        if force:
            path.unlink(missing_ok=True)
        if not path.exists():
            download(r.url, path)
    found = digests(spark, root)
    if relock or not Path(lock_path).exists():
        return write_lock(declared, found, lock_path)
    lock = json.loads(Path(lock_path).read_text("utf-8"))
    known = spark.createDataFrame([(k, f["sha256"]) for k, f in lock["files"].items()], "key string, sha256 string")
    if wrong := compare(declared, found, known).filter("problem = 'changed'").orderBy("key").collect():
        raise SourceError("not what was locked: " + ", ".join(r.key for r in wrong))
    return write_lock(declared, found, lock_path) if set(lock["files"]) != {r.key for r in declared.collect()} else lock


def lock_chunks(spark: SparkSession, root: str, keys: list[str], where: str) -> dict[str, str]:
    """Writes the chunk digests of files below root to where (file, chunk, records, digest), and gives each one's root; with it, files of any size are verified in tasks of their own."""
    found = reduce(DataFrame.unionByName, [_chunks(spark, root, key) for key in keys])
    found.write.mode("overwrite").parquet(where)
    held = spark.read.parquet(where)
    return {r.file: r.root for r in splits.roots(held, _sizes(spark, root, keys)).collect()}


def _chunks(spark: SparkSession, root: str, key: str) -> DataFrame:
    rows = splits.numbered(splits.records(spark, f"{root}/{key}", splits.separator(key)))
    return splits.chunks(rows.withColumn("file", F.lit(key)))


def _sizes(spark: SparkSession, root: str, keys: list[str]) -> DataFrame:
    sizes = []
    for key in keys:
        files, path = file_system(spark, f"{root}/{key}")
        sizes.append((key, files.getFileStatus(path).getLen()))
    return spark.createDataFrame(sizes, "file string, bytes long")


def verify(spark: SparkSession, root: str, key: str, lock: dict, where: str | None = None) -> None:
    """Fails unless a file is what was locked. With a ``merkle`` root in the lock it is read in splits, and the chunks of where that differ are told; else by its SHA-256."""
    if key not in lock["files"]:
        raise SourceError(f"{key} is not in the lock")
    files, path = file_system(spark, f"{root}/{key}")  # root may lie in any store that Spark reads
    if not files.exists(path):
        raise SourceError(f"{key} is not there")
    entry = lock["files"][key]
    if "merkle" not in entry:
        row = spark.read.format("binaryFile").load(f"{root}/{key}").select(F.sha2("content", 256).alias("sha256")).first()
        if row.sha256 != entry["sha256"]:
            raise SourceError(f"{key} is not what was locked")
        return
    found = kept(_chunks(spark, root, key), "chunks")
    told = splits.roots(found, _sizes(spark, root, [key])).first()
    if told is not None and told.root == entry["merkle"]:
        return
    detail = ""
    if where:
        wrong = splits.changed(found, spark.read.parquet(where).filter(F.col("file") == key)).orderBy("chunk").limit(20).collect()
        detail = ": " + ", ".join(f"chunk {r.chunk} {r.problem}" for r in wrong) if wrong else ": its end"
    raise SourceError(f"{key} is not what was locked{detail}")


def source_rows(spark: SparkSession, lock: dict) -> DataFrame:
    rows = [(key, f["source"], f["repo"], f["commit"], f["path"], f["url"], f["sha256"], f["bytes"], f.get("license")) for key, f in lock["files"].items()]
    return spark.createDataFrame(rows, "id string, source_set string, repo string, commit_sha string, path string, url string, sha256 string, bytes long, license string")


def content(spark: SparkSession, root: str, key: str, lock: dict) -> DataFrame:
    """One row with the file's content; it fails as it is read if the bytes are not the locked ones."""
    if key not in lock["files"]:
        raise SourceError(f"{key} is not in the lock")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{key}")  # root may lie in any store that Spark reads
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        raise SourceError(f"{key} is not there")
    same = F.assert_true(F.sha2("content", 256) == lock["files"][key]["sha256"], F.lit(f"{key} is not what was locked"))
    return spark.read.format("binaryFile").load(f"{root}/{key}").withColumn("_ok", same).select(F.decode(F.col("content"), "UTF-8").alias("text"), "_ok")


def text_of(rows: DataFrame) -> DataFrame:
    """The text alone, checked (the check is part of the projection, so it can't be pruned)."""
    return rows.select(F.when(F.col("_ok").isNull(), F.col("text")).alias("text"))


def sha256_file(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def info(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chapters, verses) of an info.json; an unknown place of revelation fails."""
    chapters = texts.select(F.explode(F.from_json("text", INFO)["chapters"]).alias("c"))
    known = F.create_map(*[F.lit(x) for pair in PLACES.items() for x in pair])
    place = F.coalesce(F.try_element_at(known, F.col("c.revelation")), F.raise_error(F.concat(F.lit("unknown place of revelation: "), F.coalesce(F.col("c.revelation"), F.lit("null")))).cast("string"))
    surah = chapters.select(F.col("c.chapter").cast("int").alias("number"), F.col("c.arabicname").alias("name_ar"), F.col("c.englishname").alias("name_en"), F.col("c.name").alias("name_translit"), place.alias("revelation_place"))
    verse = chapters.select(F.col("c.chapter").cast("int").alias("surah"), F.explode("c.verses").alias("v")).select("surah", F.col("v.verse").cast("int").alias("verse"), *[f"v.{c}" for c in ("juz", "manzil", "page", "ruku", "maqra")], truthy(F.col("v.sajda")).cast("int").alias("sajda"))
    return surah, verse


def truthy(c: Column) -> Column:
    """JSON truth of a value that was read as a string."""
    return ~F.coalesce(F.trim(c), F.lit("")).isin("", "false", "0", "null", "{}", "[]")


def edition_file(spark: SparkSession, path: str) -> DataFrame:
    """file, pos (the order in the file), surah, verse and raw of editions, read in splits; an object that is no verse fails."""
    rows = splits.elements(spark, path, "quran").withColumn("v", F.from_json("json", VERSE))
    bad = F.raise_error(F.concat(F.lit("edition, element "), F.col("pos").cast("string"), F.lit(": "), F.col("json")))
    text = F.coalesce(F.col("v.text"), bad.cast("string"))
    return rows.select("file", "pos", F.col("v.chapter").cast("int").alias("surah"), F.col("v.verse").cast("int").alias("verse"), text.alias("raw"))


def edition(texts: DataFrame) -> DataFrame:
    """pos (the order in the file), chapter, verse, raw of editions that are a row each."""
    return texts.select(F.posexplode(F.from_json("text", EDITION)["quran"]).alias("pos", "v")).select("pos", F.col("v.chapter").cast("int").alias("surah"), F.col("v.verse").cast("int").alias("verse"), F.col("v.text").alias("raw"))


def morphology_file(spark: SparkSession, path: str, as_one: bool = False) -> DataFrame:
    """The rows of a TSV (as_one: of a folder's files in order) that is read in splits."""
    return morphology_lines(splits.lines(spark, path, as_one))


def morphology(texts: DataFrame) -> DataFrame:
    """The rows of TSV texts that are a row each."""
    return morphology_lines(texts.select(F.posexplode(F.split("text", r"\r?\n")).alias("line", "value")))


def morphology_lines(lines: DataFrame) -> DataFrame:
    """line, surah, verse, place, part, form, pos, features of lines (line, value); blank ones count, but have no row, and those that aren't four fields at a four-part place fail."""
    cut = lines.filter(F.trim("value") != "").withColumn("f", F.split("value", "\t"))
    bad = F.raise_error(F.concat(F.lit("morphology, line "), (F.col("line") + 1).cast("string"), F.lit(": "), F.col("value")))
    spot = F.split(F.get("f", 0), ":")
    good = (F.size("f") == 4) & (F.size(spot) == 4) & F.forall(spot, lambda x: x.rlike("^[0-9]+$"))
    at = F.transform(F.when(good, spot).otherwise(bad.cast("array<string>")), lambda x: x.cast("int"))
    placed = cut.withColumn("at", at)
    return placed.select("line", *[F.get("at", i).alias(n) for i, n in enumerate(("surah", "verse", "place", "part"))], *[F.get("f", i).alias(n) for i, n in ((1, "form"), (2, "pos"), (3, "features"))])
