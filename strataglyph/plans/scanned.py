"""Queries over files that Spark wrote from general tables and reads in splits, and over indexes of them, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index, search
from ..sources import raw, shared, splits
from . import bindings as b

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Records of a chunk here, so that small tables have several.
CHUNK = 500


def query(sql: str):  # noqa: ANN201
    def put(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql.strip()
        return f

    return put


# Lines ---------------------------------------------------------------------------------------
_FIELDS = ("l_orderkey", "l_linenumber", "l_partkey % 100 + 1", "l_suppkey % 5 + 1", "l_linestatus", "l_returnflag")
_ORDERED = f"told AS (SELECT row_number() OVER (ORDER BY {', '.join(_FIELDS)}) - 1 AS line, l_orderkey, l_linenumber, l_partkey % 100 + 1 AS place, l_suppkey % 5 + 1 AS part, l_linestatus, l_returnflag FROM lineitem), lines AS (SELECT *, l_orderkey || ':' || l_linenumber || ':' || place || ':' || part || chr(9) || l_linestatus || chr(9) || l_returnflag || chr(9) || 'ROOT:' || l_linestatus AS value FROM told)"


def _written(spark: SparkSession, sf_dir: str, change: str = "false") -> str:
    """A folder of text files, ranges of lineitem in order, a line each; lines that change holds for differ."""
    order = [F.expr(f).alias(f"k{i}") for i, f in enumerate(_FIELDS)]
    line = F.expr(f"concat_ws('\\t', concat_ws(':', {', '.join(_FIELDS[:4])}), l_linestatus, l_returnflag, concat('ROOT:', l_linestatus, if({change}, '!', '')))")
    rows = b.read(spark, sf_dir, "lineitem").select(*order, line.alias("value"))
    keys = [f"k{i}" for i in range(len(order))]
    path = shared.folder(spark, "lines")
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("value").write.text(path)
    return path


@query(f"WITH {_ORDERED} SELECT line, l_orderkey::INTEGER AS surah, l_linenumber::INTEGER AS verse, place::INTEGER AS place, part::INTEGER AS part, l_linestatus AS form, l_returnflag AS pos, 'ROOT:' || l_linestatus AS features FROM lines")
def morphology_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines numbered over all files of a folder, whichever task reads which part of which."""
    return raw.morphology_file(spark, _written(spark, sf_dir), as_one=True)


def _chunked(spark: SparkSession, path: str) -> DataFrame:
    return splits.chunks(splits.numbered(splits.records(spark, path), as_one=True), CHUNK).drop("file")


_CHUNKS = f"{_ORDERED}, c AS (SELECT line // {CHUNK} AS chunk, count(*) AS records, sha256(string_agg(sha256(value), '' ORDER BY line)) AS digest FROM lines GROUP BY 1)"


@query(f"WITH {_CHUNKS} SELECT chunk, records, digest FROM c")
def chunk_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunked(spark, _written(spark, sf_dir))


@query(f"WITH {_ORDERED} SELECT DISTINCT line // {CHUNK} AS chunk, 'changed' AS problem FROM lines WHERE l_orderkey % 997 = 3")
def changed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file beside one with other bytes in a few lines: the chunks that tell."""
    locked, found = (_chunked(spark, _written(spark, sf_dir, change)).withColumn("file", F.lit("lines")) for change in ("false", "l_orderkey % 997 = 3"))
    return splits.changed(found, locked).select("chunk", "problem")


@query(f"WITH {_CHUNKS}, top AS (SELECT sha256(string_agg(digest, '' ORDER BY chunk)) AS d FROM (SELECT chunk // {splits.FAN} AS k, sha256(string_agg(digest, '' ORDER BY chunk)) AS digest, min(chunk) AS chunk FROM c GROUP BY 1)) SELECT CASE WHEN (SELECT count(*) FROM c) > {splits.FAN} THEN top.d ELSE (SELECT sha256(string_agg(digest, '' ORDER BY chunk)) FROM c) END AS root FROM top")
def chunk_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.roots(_chunked(spark, _written(spark, sf_dir)).withColumn("file", F.lit("lines"))).select("root")


# Elements of an array ------------------------------------------------------------------------
#: Braces, quotes and backslashes in every text, where a scanner may stumble.
_TEXT = "text || ' {a\"b}\\c} ' || doc_id"


@query(f"SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, (doc_id % 114 + 1)::INTEGER AS surah, (doc_id % 286 + 1)::INTEGER AS verse, {_TEXT} AS raw FROM documents WHERE source IS NOT NULL AND text IS NOT NULL")
def edition_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's documents as one JSON file, whose array is read in splits."""
    docs = b.read(spark, sf_dir, "documents").filter("source is not null and text is not null").select("source", "doc_id", F.concat("text", F.lit(' {a"b}\\c} '), "doc_id").alias("text"))
    ends = docs.groupBy("source").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    verse = F.to_json(F.struct((F.col("doc_id") % 114 + 1).alias("chapter"), (F.col("doc_id") % 286 + 1).alias("verse"), "text"))
    head, tail = F.when(F.col("doc_id") == F.col("first"), '{"quran":[').otherwise(","), F.when(F.col("doc_id") == F.col("last"), "]}").otherwise("")
    rows = docs.join(shared.small(ends), "source").select("source", "doc_id", F.concat(head, verse, tail).alias("value"))
    path = shared.folder(spark, "editions")
    rows.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "value").write.partitionBy("source").text(path)
    found = raw.edition_file(spark, path)
    return found.select(F.url_decode(F.regexp_extract("file", "source=([^/]*)/", 1)).alias("source"), "pos", "surah", "verse", "raw")


# The index -----------------------------------------------------------------------------------
@query(f"WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(strip_accents(text)), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')) AS term FROM documents) SELECT term, count(DISTINCT doc_id)::BIGINT AS units, count(*) AS positions, count(DISTINCT doc_id // {index.SPAN}) AS blocks FROM t GROUP BY term")
def index_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = search.postings(b.read(spark, sf_dir, "documents"), "doc_id", "text")
    return index.dictionary(index.blocks(places, (), "doc_id"), ())
