"""Queries over a store that is bound to general tables, through the functions that users of a store call, and DuckDB SQL for the same rows."""

from __future__ import annotations

import atexit
import hashlib
import json
import tempfile
import uuid
from collections import ChainMap
from collections.abc import Iterator, Mapping
from functools import lru_cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ladder, refs, tables
from ..operators import checks, display, distance, export, lexicon, spine, variants
from ..operators.api import Api
from ..operators.sql import first_rows, read_only, register
from ..sources import raw, shared, store
from . import bindings as b

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
EDITION = "uthmani-hafs"


def query(sql: str):  # noqa: ANN201
    def put(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql.strip()
        return f

    return put


class Bound(Mapping):
    """The bound store in a folder that driver and executors share (a temporary one only in local mode). A table is compiled and written when it is first read; what a query doesn't read is not made for it."""

    def __init__(self, spark: SparkSession, sf_dir: str, shared: str | None) -> None:
        self.spark = spark
        self.folder = f"{shared.rstrip('/')}/strataglyph-store-{uuid.uuid4().hex}" if shared else "file://" + tempfile.mkdtemp(prefix="strataglyph-store-")
        self.made = b.Store(spark, sf_dir, self._keep, self._held)
        self.read: dict[str, DataFrame] = {}

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def _held(self, name: str) -> DataFrame:
        """A table that others are made from. Words come straight from the verses unless they are written already: one pass over the columns that are asked for costs less than writing all."""
        return store.declared(self.made.word, name) if name == "word" and name not in self.read else self[name]

    def live(self, indexed: tuple[str, int] | None = None) -> Mapping:
        """The store with its words, segments, texts, aligned words, exceptions, roots, lemmas and variants as they come from the verses, unwritten, for queries that ask for a few verses or columns: those are sought in the verses, and nothing is made of the others. indexed: the rung and the edition that the index is of, where one is asked for."""
        made = self.made.live | (self.made.index_of(*indexed) if indexed else {})
        return ChainMap({name: store.view(ChainMap(made, self), name) for name in ("v_word", "v_segment")}, made, self)

    def checked(self) -> Mapping:
        """The store to be checked: tables that hold ids and places of all rows (texts, aligned words, variants) are compiled, the others come from the verses, unwritten."""
        return ChainMap(self.made.checked, self)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.read:
            if name in store.VIEWED:
                self.read[name] = store.view(self, name)
            elif name in store.TABLES:
                store.write({name: self.made.table(name)}, self.folder)
                self.read[name] = self.spark.read.parquet(f"{self.folder}/{name}")
            else:
                raise KeyError(name)
        return self.read[name]

    def __iter__(self) -> Iterator[str]:
        return iter([*store.TABLES, *store.VIEWED])

    def __len__(self) -> int:
        return len(store.TABLES) + len(store.VIEWED)

    def __contains__(self, name: object) -> bool:
        return name in store.TABLES or name in store.VIEWED


_bound: list[Bound] = []


@lru_cache(maxsize=4)
def _store(spark: SparkSession, application: str, sf_dir: str, shared: str | None) -> Bound:
    if not _bound:
        atexit.register(_clean, spark)
    _bound.append(Bound(spark, sf_dir, shared))
    return _bound[-1]


def compiled(spark: SparkSession, sf_dir: str, *named: str) -> Bound:
    """The bound store of a session, a table of which is compiled once. Those that are named get their names in SQL."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    t = _store(spark, spark.sparkContext.applicationId, sf_dir, shared)
    register({name: t[name] for name in named})
    return t


def _clean(spark: SparkSession) -> None:
    try:
        for bound in _bound:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(bound.folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may already be gone at exit
        pass


def rows(spark: SparkSession, found: list[dict], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in found], schema)


def _archi(token: str) -> str:
    t = f"translate({token}, '{''.join(ladder._EVEN)}', '{''.join(ladder._EVEN.values())}')"
    return f"regexp_replace(left({t}, length({t}) - 1), '[نيى]', 'ٮ', 'g') || translate(right({t}, 1), 'ني', 'ںى')"


#: The store's tables in SQL. Texts are bare letters, but for one vowel in the second edition, so its rungs are simple.
_RASM = f"translate({{}}, '{''.join(ladder._FOLD)}', '{''.join(ladder._FOLD.values())}')"
_STORE = f"""WITH clean AS (SELECT doc_id, source, coalesce(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), '') AS plain FROM documents),
cut AS (SELECT doc_id, source, string_split(translate(plain, '{b.LATIN}', '{b.ARABIC}'), ' ') AS t FROM clean WHERE plain <> ''),
verse AS (SELECT doc_id, source, unnest(range(0, (len(t) - 1) // {b.VERSE} + 1)) AS k, t FROM cut),
ayah0 AS (SELECT dense_rank() OVER (ORDER BY source) AS surah, row_number() OVER (PARTITION BY source ORDER BY doc_id, k) AS number, row_number() OVER (ORDER BY source, doc_id, k) AS id, source, list_slice(t, k * {b.VERSE} + 1, k * {b.VERSE} + {b.VERSE}) AS tokens FROM verse),
word0 AS (SELECT id AS ayah_id, surah, number AS ayah, unnest(tokens) AS form, generate_subscripts(tokens, 1) AS position FROM ayah0),
word AS (SELECT row_number() OVER (ORDER BY ayah_id, position) AS id, *, left(form, 2) AS root, left(form, 3) AS lemma, {_RASM.format('form')} AS rasm, {_archi(_RASM.format('form'))} AS archigraphemic FROM word0),
ayah AS (SELECT a.id, a.surah, a.number, a.source, w.word_start, w.word_end FROM ayah0 a LEFT JOIN (SELECT ayah_id, min(id) AS word_start, max(id) AS word_end FROM word GROUP BY 1) w ON w.ayah_id = a.id),
surah AS (SELECT surah AS number, source AS name_en, count(*) AS ayah_count, min(id) AS ayah_start, max(id) AS ayah_end FROM ayah GROUP BY 1, 2),
one AS (SELECT id AS ayah_id, array_to_string(tokens, ' ') AS one FROM ayah0),
text0 AS (SELECT 1 AS edition_id, ayah_id, one AS raw, one AS bare FROM one UNION ALL SELECT 2, ayah_id, CASE WHEN ayah_id % 2 = 0 THEN replace(one, 'م', 'مَ') ELSE replace(one, 'ب', 'ت') END, CASE WHEN ayah_id % 2 = 0 THEN one ELSE replace(one, 'ب', 'ت') END FROM one),
ayah_text AS (SELECT edition_id, ayah_id, raw, raw AS nfc, raw AS plain, bare AS unvocalized, {_RASM.format('bare')} AS rasm, array_to_string(list_transform(string_split({_RASM.format('bare')}, ' '), lambda w: {_archi('w')}), ' ') AS archigraphemic, (coalesce(sum(length(raw) + 1) OVER (PARTITION BY edition_id ORDER BY ayah_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS char_start, len(string_split(raw, ' ')) AS token_count FROM text0),
edition AS (SELECT 1 AS id, 'uthmani-hafs' AS slug, 'hafs' AS riwayah UNION ALL SELECT 2, 'uthmani-warsh', 'warsh'),
exception AS (SELECT ayah_id, len(string_split(one, ' '))::INTEGER AS text_tokens, (len(string_split(one, ' ')) - 1)::INTEGER AS corpus_words FROM one WHERE ayah_id % 29 = 0 AND len(string_split(one, ' ')) > 1),
word_text AS (SELECT w.id AS word_id, form FROM word w WHERE ayah_id % 29 <> 0),
vowel AS (SELECT ayah_id, position AS ref_position, form AS ref_text, replace(form, 'م', 'مَ') AS var_text FROM word WHERE ayah_id % 2 = 0 AND contains(form, 'م'))"""
_WORDREF = "'Q' || w.surah || ':' || w.ayah || ':' || w.position"


# Views and references ------------------------------------------------------------------------
@query(f"{_STORE} SELECT id, 'Q' || surah || ':' || number AS ref, name_en FROM ayah JOIN surah s ON s.number = ayah.surah".replace("|| number AS ref", "|| ayah.number AS ref"))
def view_ayah(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.views(b.spelled(spark, sf_dir))["v_ayah"].select("id", "ref", "name_en")


@query(f"{_STORE} SELECT id, {_WORDREF} AS ref, rasm, archigraphemic FROM word w")
def view_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.views(b.spelled(spark, sf_dir))["v_word"].select("id", "ref", "rasm", "archigraphemic")


@query(f"{_STORE} SELECT id, {_WORDREF} || ':1' AS ref, form, 'N' AS tag, root, lemma FROM word w")
def view_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.views(b.spelled(spark, sf_dir))["v_segment"].select("id", "ref", "form", "tag", "root", "lemma")


@query(f"{_STORE} SELECT id, 'Q' || w.surah || ':' || w.ayah AS ref FROM word w")
def word_to_ayah_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.views(b.spelled(spark, sf_dir))["v_word"].select("id", display.ayah_of(F.col("ref")).alias("ref"))


# Payloads ------------------------------------------------------------------------------------
@query(f"{_STORE} SELECT 'surah' AS name, count(*) AS n FROM surah UNION ALL SELECT 'ayah', count(*) FROM ayah UNION ALL SELECT 'word', count(*) FROM word UNION ALL SELECT 'segment', count(*) FROM word UNION ALL SELECT 'root', count(DISTINCT root) FROM word UNION ALL SELECT 'lemma', count(DISTINCT lemma) FROM word UNION ALL SELECT 'ayah_text', count(*) FROM ayah_text UNION ALL SELECT 'spine_exception', count(*) FROM exception")
def payload_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = Api(ChainMap({"variant": spark.createDataFrame([], store.SCHEMA["variant"])}, compiled(spark, sf_dir).live())).meta()["counts"]
    return spark.createDataFrame([(n, c) for n, c in counts.items() if n != "variant"], "name string, n long")


@query(f"{_STORE} SELECT ayah_id, 'Q' || a.surah || ':' || a.number AS ref, raw, nfc, plain, unvocalized, rasm, archigraphemic FROM ayah_text t JOIN ayah a ON a.id = t.ayah_id JOIN edition e ON e.id = t.edition_id WHERE slug = '{EDITION}' AND a.id BETWEEN (SELECT ayah_start FROM surah WHERE number = 1) AND (SELECT least(ayah_end, ayah_start + 49) FROM surah WHERE number = 1)")
def payload_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, Api(compiled(spark, sf_dir).live()).ladder("Q1", EDITION)["ayahs"], "ayah_id long, ref string, raw string, nfc string, plain string, unvocalized string, rasm string, archigraphemic string")


@query(f"{_STORE} SELECT slug, ayah_id, rasm AS text FROM ayah_text t JOIN edition e ON e.id = t.edition_id WHERE ayah_id BETWEEN (SELECT ayah_start FROM surah WHERE number = 2) AND (SELECT ayah_end FROM surah WHERE number = 2)")
def payload_show(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Api(compiled(spark, sf_dir).live()).shown("Q2", ["uthmani-warsh", EDITION], "rasm")


@query(f"{_STORE} SELECT w.ayah_id, w.position::INTEGER AS position, x.form AS text_form, w.form, w.root, w.lemma, 'N' AS pos, 1 AS segments FROM word w LEFT JOIN word_text x ON x.word_id = w.id WHERE w.surah = 1")
def payload_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    api = Api(compiled(spark, sf_dir).live())
    return api.words_of(*api.span("Q1", None)).select("ayah_id", "position", "text_form", "form", "root", "lemma", "pos", F.size("segments").alias("segments"))


@query(f"{_STORE} SELECT ayah_id, 'uthmani-warsh' AS slug, 'replace' AS op, ref_position::INTEGER AS ref_position, ref_text, var_text, 'same rasm' AS flag FROM vowel JOIN ayah a ON a.id = ayah_id WHERE a.surah = 1")
def payload_vocalic_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Api(compiled(spark, sf_dir).live()).varied("Q1", True).filter("same_rasm = 1")
    return found.select("ayah_id", "slug", "op", "ref_position", "ref_text", "var_text", "flag")


@query(f"{_STORE} SELECT e.id::BIGINT AS edition_id, slug, (SELECT count(*) FROM ayah)::BIGINT AS ayahs, CASE e.id WHEN 2 THEN (SELECT count(*) FROM vowel) ELSE 0 END::BIGINT AS vocalic FROM edition e")
def edition_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, Api(compiled(spark, sf_dir).live()).counters(), "edition_id long, slug string, ayahs long, vocalic long")


@query(f"{_STORE}, asked AS (SELECT archigraphemic AS shape FROM word ORDER BY id LIMIT 1) SELECT rasm, count(*) AS occurrences FROM word, asked WHERE archigraphemic = shape GROUP BY rasm")
def payload_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = compiled(spark, sf_dir).live()
    asked = t["word"].filter("ayah_id = 1").orderBy("id").first().rasm  # every verse has a word, and words are numbered as verses are
    return rows(spark, Api(t).skeleton(asked)["readings"], "rasm string, occurrences long")


_PHRASE = "phrase AS (SELECT string_agg(form, ' ' ORDER BY position) AS p FROM word WHERE ayah_id = 1 AND position IN (2, 3)), hit AS (SELECT t.* FROM ayah_text t, phrase WHERE edition_id = 1 AND contains(' ' || rasm || ' ', ' ' || " + _RASM.format("p") + " || ' '))"


@query(f"{_STORE}, {_PHRASE} SELECT ayah_id, 'Q' || a.surah || ':' || a.number AS ref, raw, rasm AS text, (SELECT count(*) FROM hit)::BIGINT AS total FROM hit JOIN ayah a ON a.id = ayah_id ORDER BY ayah_id LIMIT 60")
def payload_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = compiled(spark, sf_dir).live(("rasm", 1))
    asked = " ".join(r.form for r in t["word"].filter("ayah_id = 1 and position in (2, 3)").orderBy("position").collect())
    got = Api(t).search(asked, "rasm", EDITION)
    return rows(spark, [h | {"total": got["total"]} for h in got["hits"]], "ayah_id long, ref string, raw string, text string, total long")


@query(f"{_STORE}, r AS (SELECT root AS text, count(*) AS word_count FROM word GROUP BY 1) SELECT text, word_count FROM r ORDER BY word_count DESC, text LIMIT 60")
def payload_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, Api(compiled(spark, sf_dir).live()).roots()["roots"], "text string, word_count long")


@query(f"{_STORE}, asked AS (SELECT root AS r FROM word ORDER BY id LIMIT 1) SELECT w.id, {_WORDREF} AS ref, form, lemma, 'N' AS pos FROM word w, asked WHERE root = r ORDER BY w.id LIMIT 300")
def payload_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = compiled(spark, sf_dir).live()
    return rows(spark, Api(t).root(t["word"].filter("ayah_id = 1").orderBy("id").first().root)["words"], "id long, ref string, form string, lemma string, pos string")


@query(f"{_STORE} SELECT ayah_id, 'Q' || a.surah || ':' || a.number AS ref, text_tokens, corpus_words FROM exception JOIN ayah a ON a.id = ayah_id")
def payload_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Api(compiled(spark, sf_dir).live()).exceptional().select("ayah_id", "ref", "text_tokens", "corpus_words")


@query(f"{_STORE}, apart AS (SELECT count(*) AS n FROM ayah_text x JOIN ayah_text y ON x.ayah_id = y.ayah_id AND x.edition_id = 1 AND y.edition_id = 2 WHERE x.rasm <> y.rasm) SELECT p AS pair, (CASE WHEN same THEN 0 ELSE n END)::BIGINT AS distance, CASE WHEN n > 0 THEN CASE WHEN same THEN 1.0 ELSE 0.0 END END::DOUBLE AS intensity FROM apart, (VALUES ('uthmani-hafs|uthmani-hafs', true), ('uthmani-hafs|uthmani-warsh', false), ('uthmani-warsh|uthmani-hafs', false), ('uthmani-warsh|uthmani-warsh', true)) AS v(p, same)")
def payload_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = Api(compiled(spark, sf_dir).live()).tree()
    return spark.createDataFrame([(p, d, got["intensity"][p]) for p, d in got["distance"].items()], "pair string, distance long, intensity double")


@query(f"{_STORE}, v AS (SELECT ref_position, ref_text, var_text, row_number() OVER (ORDER BY ref_position) AS r FROM vowel WHERE ayah_id = 2) SELECT ref_position::INTEGER AS ref_position, ref_text, var_text, 'vocalic' AS bucket FROM v")
def payload_apparatus(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = Api(compiled(spark, sf_dir).live()).apparatus(2)
    return rows(spark, got["consonantal"] + got["vocalic"], "ref_position int, ref_text string, var_text string, bucket string")


# Checks --------------------------------------------------------------------------------------
_NONE = (
    ["verse counts by surah", "ayah ids have no gaps", "declared editions are there", "no empty text", "every ayah has words", "words lie within their ayah", "words follow the order of ayahs", "word offsets lie within their text", "roots of words are listed", "root counts add up", "stored rungs equal their recomputation", "rungs are stable", "every character is classified", "no invisible characters at plain", "every text has tokens", "every edition names a source", "build metadata is there", "one reference edition", "edition is complete: uthmani-hafs", "edition is complete: uthmani-warsh"]
    + [f"{c}.{k} leads to {p}.{q}" for c, k, p, q in checks.FOREIGN_KEYS]
    + [f"{n} has each {', '.join(k)} once" for n, k in [*checks.PRIMARY_KEYS.items(), *checks.UNIQUE]]
    + [f"{n}: {rule}" for n, rule in checks.DOMAINS]
)
_FACTS = f"""SELECT 'number of surahs' AS name, (SELECT count(*) FROM surah) = 20 AS ok UNION ALL SELECT 'number of ayahs', (SELECT count(*) FROM ayah) = 6236 UNION ALL SELECT 'number of words', (SELECT count(*) FROM word) = 77429
UNION ALL SELECT 'number of segments', (SELECT count(*) FROM word) = 130030 UNION ALL SELECT 'number of exceptions', (SELECT count(*) FROM exception) = 12
UNION ALL SELECT 'share of aligned words', 100.0 * (SELECT count(*) FROM word_text) / (SELECT count(*) FROM word) >= 95
UNION ALL SELECT 'search responds', (SELECT count(*) FROM ayah_text WHERE contains(' ' || rasm || ' ', ' الله ')) > 0"""


@query(f"{_STORE} {_FACTS} UNION ALL SELECT unnest([{', '.join("'" + n.replace("'", "''") + "'" for n in _NONE)}]), true")
def checks_of_a_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = compiled(spark, sf_dir).checked()
    declared = [r.ayah_count for r in t["surah"].orderBy("number").collect()]
    wanted = {"surahs": 20, "ayahs": 6236, "words": 77429, "segments": 130030, "exceptions": 12, "aligned_percent": 95}
    return checks.all_checks(t, wanted, declared, [EDITION, "uthmani-warsh"]).select("name", "ok")


_GAPS = "kept AS (SELECT id FROM ayah WHERE id % 7 <> 3)"


@query(f"{_STORE}, {_GAPS} SELECT id FROM kept k WHERE id > (SELECT min(id) FROM kept) AND NOT EXISTS (SELECT 1 FROM kept b WHERE b.id = k.id - 1)")
def check_gap_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.gaps(compiled(spark, sf_dir)["ayah"].filter("id % 7 <> 3")).select(F.col("_id").alias("id"))


# Export and display --------------------------------------------------------------------------
@query(f"{_STORE} SELECT w.surah::INTEGER AS surah, w.ayah::INTEGER AS ayah, w.position::INTEGER AS position, coalesce(nullif(x.form, ''), w.form) AS form, root, lemma FROM word w LEFT JOIN word_text x ON x.word_id = w.id")
def export_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.word_rows(compiled(spark, sf_dir).live()).select("surah", "ayah", "position", "form", "root", "lemma")


@query(f"{_STORE}, v AS (SELECT ayah_id, raw, (length(raw) - length(replace(raw, 'َ', ''))) AS vowels FROM ayah_text WHERE edition_id = 2) SELECT ayah_id, vowels::BIGINT AS vowels, (2 * vowels + CASE WHEN raw LIKE '%َ' THEN 0 ELSE 1 END)::BIGINT AS runs FROM v")
def tinted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = compiled(spark, sf_dir)["ayah_text"].filter("edition_id = 2").select("ayah_id", display.tinted(F.col("raw")).alias("r"))
    return runs.select("ayah_id", F.size(F.filter("r", lambda x: x["class"] == "vowel")).cast("long").alias("vowels"), F.size("r").cast("long").alias("runs"))


@query("WITH d AS (SELECT a.n_regionkey AS a, c.n_regionkey AS b, sum(abs(a.n_nationkey - c.n_nationkey))::BIGINT AS distance FROM nation a JOIN nation c ON true GROUP BY 1, 2) SELECT a, b, distance, 1 - distance / (SELECT max(distance) FROM d)::DOUBLE AS intensity FROM d")
def colour_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = b.read(spark, sf_dir, "nation")
    pairs = n.select(F.col("n_regionkey").alias("a"), F.col("n_nationkey").alias("x")).crossJoin(n.select(F.col("n_regionkey").alias("b"), F.col("n_nationkey").alias("y")))
    return distance.intensity(pairs.groupBy("a", "b").agg(F.sum(F.abs(F.col("x") - F.col("y"))).cast("long").alias("distance")))


_DIFF = f"{_STORE}, pair AS (SELECT x.ayah_id, string_split(x.rasm, ' ') AS a, string_split(y.rasm, ' ') AS b FROM ayah_text x JOIN ayah_text y ON x.ayah_id = y.ayah_id AND x.edition_id = 1 AND y.edition_id = 2), spot AS (SELECT *, list_position(list_transform(list_zip(a, b), lambda p: p[1] IS DISTINCT FROM p[2]), true) AS place FROM pair) SELECT ayah_id, place::BIGINT AS position, array_to_string(list_slice(a, greatest(place - 1, 1), place + 2), ' ') AS ref, array_to_string(list_slice(b, greatest(place - 1, 1), place + 2), ' ') AS var FROM spot WHERE place > 0"


@query(_DIFF)
def first_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = compiled(spark, sf_dir)["ayah_text"]
    cut = lambda e, c: t.filter(F.col("edition_id") == e).select("ayah_id", F.split("rasm", " ").alias(c))
    found = cut(1, "a").join(cut(2, "b"), "ayah_id").withColumn("d", variants.first_difference(F.col("a"), F.col("b"))).filter("d is not null")
    return found.select("ayah_id", F.col("d.position").cast("long").alias("position"), F.array_join("d.ref", " ").alias("ref"), F.array_join("d.var", " ").alias("var"))


# Files ---------------------------------------------------------------------------------------
@query("SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::INTEGER AS pos, (n_regionkey + 1)::INTEGER AS surah, (n_nationkey + 1)::INTEGER AS verse, n_name AS raw FROM nation")
def edition_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    verse = F.struct((F.col("n_regionkey") + 1).alias("chapter"), (F.col("n_nationkey") + 1).alias("verse"), F.col("n_name").alias("text"))
    one = b.read(spark, sf_dir, "nation").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", verse.alias("v")))).alias("l"))
    return raw.edition(one.select(F.to_json(F.struct(F.transform("l", lambda x: x["v"]).alias("quran"))).alias("text")))


def _info(spark: SparkSession, sf_dir: str) -> DataFrame:
    verse = F.struct((F.col("n_nationkey") + 1).alias("verse"), *[(F.col("n_nationkey") % k + 1).alias(c) for k, c in ((30, "juz"), (7, "manzil"), (60, "page"), (55, "ruku"), (24, "maqra"))], (F.col("n_nationkey") % 3 == 0).alias("sajda"))
    chapters = b.read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(verse)).alias("verses")).join(b.read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    one = F.struct((F.col("r_regionkey") + 1).alias("chapter"), F.col("r_name").alias("name"), F.lower("r_name").alias("englishname"), F.upper("r_name").alias("arabicname"), F.when(F.col("r_regionkey") % 2 == 0, "Mecca").otherwise("Madina").alias("revelation"), "verses")
    return chapters.agg(F.array_sort(F.collect_list(one)).alias("chapters")).select(F.to_json(F.struct("chapters")).alias("text"))


@query("SELECT (r_regionkey + 1)::INTEGER AS number, upper(r_name) AS name_ar, lower(r_name) AS name_en, r_name AS name_translit, CASE WHEN r_regionkey % 2 = 0 THEN 'meccan' ELSE 'medinan' END AS revelation_place FROM region")
def info_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw.info(_info(spark, sf_dir))[0]


@query("SELECT (n_regionkey + 1)::INTEGER AS surah, (n_nationkey + 1)::INTEGER AS verse, (n_nationkey % 30 + 1)::INTEGER AS juz, (n_nationkey % 7 + 1)::INTEGER AS manzil, (n_nationkey % 60 + 1)::INTEGER AS page, (n_nationkey % 55 + 1)::INTEGER AS ruku, (n_nationkey % 24 + 1)::INTEGER AS maqra, (n_nationkey % 3 = 0)::INTEGER AS sajda FROM nation")
def info_verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw.info(_info(spark, sf_dir))[1]


@query("SELECT l_orderkey::INTEGER AS surah, l_linenumber::INTEGER AS verse, (l_partkey % 100 + 1)::INTEGER AS place, (l_suppkey % 5 + 1)::INTEGER AS part, l_linestatus AS form, l_returnflag AS pos, 'ROOT:' || l_linestatus AS features FROM lineitem")
def morphology_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = b.read(spark, sf_dir, "lineitem").select("l_orderkey", F.expr("concat_ws('\\t', concat_ws(':', l_orderkey, l_linenumber, l_partkey % 100 + 1, l_suppkey % 5 + 1), l_linestatus, l_returnflag, concat('ROOT:', l_linestatus))").alias("line"))
    return raw.morphology(lines.groupBy("l_orderkey").agg(F.array_join(F.collect_list("line"), "\n").alias("text"))).drop("line")


@query("WITH k AS (SELECT p_partkey, p_brand, p_size FROM part), d AS (SELECT p_brand || '/' || p_partkey AS key, p_partkey % 4 AS fate FROM k) SELECT key, CASE fate WHEN 1 THEN 'missing' WHEN 2 THEN 'unlocked' WHEN 3 THEN 'changed' END AS problem FROM d WHERE fate <> 0")
def lock_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = b.read(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", "p_partkey").alias("key"), (F.col("p_partkey") % 4).alias("fate")).withColumn("local", F.col("key"))
    found = d.filter("fate <> 1").select("local", F.sha2("key", 256).alias("sha256"))
    lock = d.filter("fate <> 2").select("key", F.when(F.col("fate") == 3, "other").otherwise(F.sha2("key", 256)).alias("sha256"))
    return raw.compare(d.select("key", "local"), found, lock)


_RANGES = "r AS (SELECT id, surah, number AS f, number + id % 5 AS l FROM ayah0 WHERE surah <= 114)"


@query(f"{_STORE}, {_RANGES} SELECT id, 'Q' || surah || ':' || f || CASE WHEN l = f THEN '' ELSE '-' || surah || ':' || l END AS shown, 'ayah' AS level FROM r")
def range_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelled = F.concat_ws(":", F.concat(F.lit("Q"), "surah"), "number"), F.concat_ws(":", "surah", (F.col("number") + F.col("id") % 5).cast("int"))
    told = compiled(spark, sf_dir)["ayah"].select("id", refs.parse_range(F.concat_ws("-", *spelled)).alias("r")).filter("r is not null")
    return told.select("id", refs.show_range(F.col("r")).alias("shown"), refs.level(F.col("r")["start"]).alias("level"))


#: A range for each order: a few verses, or for some a whole chapter; beyond a chapter's end it leads nowhere.
_ASKED = "asked AS (SELECT o_orderkey, o_custkey % 20 + 1 AS s, CASE WHEN o_orderkey % 499 = 0 THEN NULL ELSE o_orderkey % 53 + 1 END AS f, o_orderkey % 53 + 1 + o_orderkey % 37 AS l FROM orders)"


@query(f"{_STORE}, {_ASKED}, span AS (SELECT o_orderkey, CASE WHEN f IS NULL THEN u.ayah_start ELSE x.id END AS first_id, CASE WHEN f IS NULL THEN u.ayah_end ELSE y.id END AS last_id FROM asked JOIN surah u ON u.number = s LEFT JOIN ayah x ON x.surah = s AND x.number = f LEFT JOIN ayah y ON y.surah = s AND y.number = l) SELECT o_orderkey, a.id FROM span JOIN ayah a ON a.id BETWEEN first_id AND last_id")
def range_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verses of every order's range, by the interval join."""
    t = compiled(spark, sf_dir)
    key, chapter = F.col("o_orderkey"), (F.col("o_custkey") % 20 + 1).cast("string")
    spelled = F.when(key % 499 == 0, F.concat(F.lit("q"), chapter)).otherwise(F.concat(F.lit(" Q"), chapter, F.lit(":"), (key % 53 + 1).cast("string"), F.lit("-"), (key % 53 + 1 + key % 37).cast("string")))
    asked = b.read(spark, sf_dir, "orders").select("o_orderkey", refs.parse_range(spelled).alias("r")).select("o_orderkey", F.col("r.start").alias("start"), F.col("r.end").alias("end"))
    found = spine.resolve(asked, t["surah"], t["ayah"]).select("o_orderkey", "first_id", "last_id")
    return spine.within(found, t["ayah"].select("id")).select("o_orderkey", "id")


def _files(spark: SparkSession, sf_dir: str, texts: dict[str, str]) -> str:
    """A folder that driver and executors share, with a file of each name."""
    root = shared.folder(spark, "files")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name, text in texts.items():
        out = files.create(path(f"{root}/{name}"), True)
        out.write(bytearray(text.encode()))
        out.close()
    return root


@query("SELECT lower(replace(r_name, ' ', '-')) || '/' || n_name || '.json' AS key, 'https://raw.githubusercontent.com/org/' || lower(replace(r_name, ' ', '-')) || '/c' || r_regionkey || '/' || n_name || '.json' AS url, lower(replace(r_name, ' ', '-')) || '/' || n_name || '.json' AS local, 'free' AS license FROM nation JOIN region ON n_regionkey = r_regionkey")
def declared_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = b.read(spark, sf_dir, "nation").join(b.read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey", "r_name").agg(F.sort_array(F.collect_list(F.concat("n_name", F.lit(".json")))).alias("files")).collect()
    declared = "".join(f'[[source]]\nid = "{r.r_name.lower().replace(" ", "-")}"\nkind = "github-raw"\nrepo = "org/{r.r_name.lower().replace(" ", "-")}"\ncommit = "c{r.r_regionkey}"\nlicense = "free"\nfiles = {json.dumps(list(r.files))}\n' for r in named)
    with tempfile.NamedTemporaryFile("w", suffix=".toml") as f:  # the driver alone reads it
        f.write(declared)
        f.flush()
        return raw.declarations(spark, f.name).select("key", "url", "local", "license")


@query("SELECT n_nationkey || '.txt' AS local, sha256(n_name) AS sha256, length(n_name)::BIGINT AS bytes FROM nation")
def file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = {f"{r.n_nationkey}.txt": r.n_name for r in b.read(spark, sf_dir, "nation").collect()}
    return raw.digests(spark, _files(spark, sf_dir, texts))


def _lock(texts: dict[str, str]) -> dict:
    return {"files": {k: {"source": "s", "repo": "r", "commit": "c", "path": k, "url": f"u/{k}", "sha256": hashlib.sha256(t.encode()).hexdigest(), "bytes": len(t.encode()), "license": None} for k, t in texts.items()}}


@query("SELECT r_name AS text FROM region")
def verified_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = {f"{r.r_regionkey}.txt": r.r_name for r in b.read(spark, sf_dir, "region").collect()}
    root, lock = _files(spark, sf_dir, texts), _lock(texts)
    return reduce(DataFrame.unionByName, [raw.text_of(raw.content(spark, root, key, lock)) for key in texts])


@query("SELECT r_regionkey || '.txt' AS id, 's' AS source_set, 'u/' || r_regionkey || '.txt' AS url, sha256(r_name) AS sha256, length(r_name)::BIGINT AS bytes FROM region")
def locked_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw.source_rows(spark, _lock({f"{r.r_regionkey}.txt": r.r_name for r in b.read(spark, sf_dir, "region").collect()})).select("id", "source_set", "url", "sha256", "bytes")


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is written as JSON lines, by the tasks that hold the rows, read again."""
    rows_ = b.read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    return spark.read.schema(rows_.schema).json(store.write_lines(rows_, shared.folder(spark, "json")))


_READINGS = "readings AS (SELECT archigraphemic, count(DISTINCT rasm) AS readings, count(*) AS occurrences FROM word GROUP BY 1 HAVING count(DISTINCT rasm) > 1)"


@query(f"{_STORE}, {_READINGS} SELECT archigraphemic, readings, occurrences::BIGINT AS occurrences, (SELECT count(*) FROM readings)::BIGINT AS total FROM readings ORDER BY readings.readings DESC, occurrences DESC, archigraphemic LIMIT 24")
def shown_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    few, total = display.shown(lexicon.ambiguous(compiled(spark, sf_dir)["word"]), "clusters", F.desc("readings"), F.desc("occurrences"), "archigraphemic")
    return few.select("archigraphemic", "readings", "occurrences", F.lit(total).cast("long").alias("total"))


@query("SELECT o_orderkey, o_custkey, true AS more FROM orders ORDER BY o_orderkey LIMIT 50")
def first_rows_and_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    register({"orders": b.read(spark, sf_dir, "orders")})
    few, more = first_rows(read_only(spark, "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey"), 50)
    return spark.createDataFrame([(r.o_orderkey, r.o_custkey, more) for r in few], "o_orderkey long, o_custkey long, more boolean")


@query(f"{_STORE}, r AS (SELECT root, count(*) AS n FROM word GROUP BY 1) SELECT root AS text, n AS word_count, length(root)::INTEGER AS letters FROM r")
def sql_over_a_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    compiled(spark, sf_dir, "root")
    return read_only(spark, "SELECT text, word_count, letters FROM root")


@query(f"{_STORE} SELECT ayah_id, rasm FROM ayah_text WHERE edition_id = 2")
def rung_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    compiled(spark, sf_dir, "ayah_text")
    ladder.register(spark)
    return read_only(spark, "SELECT ayah_id, rung(raw, 'rasm') AS rasm FROM ayah_text WHERE edition_id = 2")


_SPOKEN = "spoken AS (SELECT ayah_id, position, form, coalesce(sum(length(form) + 1) OVER (PARTITION BY ayah_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM word)"


@query(f"{_STORE}, {_SPOKEN} SELECT ayah_id, position::INTEGER AS position, form AS token, start::BIGINT AS start, (start + length(form))::BIGINT AS stop FROM spoken")
def tokens_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    compiled(spark, sf_dir, "ayah_text")
    tables.register(spark)
    return read_only(spark, "SELECT t.ayah_id, x.* FROM ayah_text t, LATERAL tokens_of(t.plain) x WHERE t.edition_id = 1")


@query(f"{_STORE}, {_SPOKEN} SELECT w.id, s.start::BIGINT AS start, (s.start + length(s.form))::BIGINT AS stop FROM word w JOIN spoken s USING (ayah_id, position)")
def offsets_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partition's rows in order, one after the other."""
    register({"word": compiled(spark, sf_dir).live()["word"]})
    tables.register(spark)
    return read_only(spark, "SELECT * FROM offsets_of(TABLE(SELECT id, length(form) AS length, ayah_id FROM word) PARTITION BY ayah_id ORDER BY id)")


@query(f"{_STORE}, first AS (SELECT a.id, a.number, count(*) OVER (PARTITION BY a.surah) AS n, a.surah FROM ayah a) SELECT surah::INTEGER AS surah, id FROM first WHERE number BETWEEN 2 AND 9 AND n >= 9")
def ranges_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second to ninth verse of every chapter that has as many, from ranges spelled out."""
    compiled(spark, sf_dir, "surah")
    tables.register(spark)
    return read_only(spark, "SELECT s.number AS surah, m.id FROM surah s, LATERAL range_of(concat('Q', s.number, ':2-9')) r, LATERAL members_of(s.ayah_start + r.first_ayah - 1, s.ayah_start + r.last_ayah - 1) m WHERE s.ayah_count >= r.last_ayah")
