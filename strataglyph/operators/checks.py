"""Data invariants: every check is one row (name, ok, detail), and none raises."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ladder import CLASSIFIED, INVISIBLE, LEVELS, audited, nfc
from ..sources.shared import kept
from . import search

#: child table, its column, parent table, its column
FOREIGN_KEYS = (
    ("ayah", "surah", "surah", "number"), ("edition", "source_id", "source", "id"),
    ("ayah_text", "edition_id", "edition", "id"), ("ayah_text", "ayah_id", "ayah", "id"),
    ("word", "ayah_id", "ayah", "id"), ("segment", "word_id", "word", "id"), ("segment_feature", "segment_id", "segment", "id"),
    ("word_text", "word_id", "word", "id"), ("word_text", "edition_id", "edition", "id"),
    ("spine_exception", "ayah_id", "ayah", "id"), ("spine_exception", "edition_id", "edition", "id"),
    ("root", "first_word_id", "word", "id"), ("lemma", "root", "root", "text"),
    ("variant", "ayah_id", "ayah", "id"), ("variant", "edition_id", "edition", "id"),
    ("annotation", "layer_id", "annotation_layer", "id"), ("annotation", "word_start", "word", "id"),
    ("annotation", "word_end", "word", "id"), ("annotation", "edition_id", "edition", "id"),
)
PRIMARY_KEYS = {
    "build": ["key"], "source": ["id"], "surah": ["number"], "ayah": ["id"], "edition": ["id"], "ayah_text": ["edition_id", "ayah_id"],
    "word": ["id"], "segment": ["id"], "segment_feature": ["segment_id", "key", "value"], "word_text": ["word_id", "edition_id"],
    "spine_exception": ["ayah_id", "edition_id"], "root": ["text"], "lemma": ["text"], "variant": ["id"], "annotation_layer": ["id"], "annotation": ["id"],
}
UNIQUE = (("ayah", ["surah", "number"]), ("edition", ["slug"]), ("word", ["ayah_id", "position"]), ("segment", ["word_id", "position"]), ("annotation_layer", ["slug"]))
DOMAINS = (
    ("surah", "revelation_place in ('meccan', 'medinan')"), ("edition", "kind in ('quran', 'translation')"), ("variant", "op in ('replace', 'insert', 'delete')"),
    ("annotation", "word_end >= word_start"), ("annotation", "confidence is null or confidence between 0 and 1"),
)
METADATA = ("version", "built_at", "sources_lock")


def dangling(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose reference leads nowhere."""
    return child.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias("_k")), F.col(column) == F.col("_k"), "left_anti")


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def gaps(ids: DataFrame, column: str = "id") -> DataFrame:
    """Ids above the least without the one before them."""
    have = ids.select(F.col(column).alias("_id"))
    least = have.agg(F.min("_id").alias("least"))
    return have.join(F.broadcast(least)).filter("_id > least").join(have.select((F.col("_id") + 1).alias("_next")), F.col("_id") == F.col("_next"), "left_anti")


def backwards(rows: DataFrame, order: str, first: str, last: str) -> DataFrame:
    """Neighbouring rows whose spans don't follow each other; neighbours are joined by their dense order, not lagged in one partition."""
    a = rows.select((F.col(order) + 1).alias("_o"), F.col(last).alias("_last"))
    return rows.join(a, F.col(order) == F.col("_o")).filter(F.col("_last") >= F.col(first))


def outside_span(children: DataFrame, parents: DataFrame, parent: str) -> DataFrame:
    span = parents.select(F.col("id").alias("_p"), "word_start", "word_end")
    return children.join(span, F.col(parent) == F.col("_p")).filter((F.col("id") < F.col("word_start")) | (F.col("id") > F.col("word_end")))


def offsets_outside(aligned: DataFrame, words: DataFrame, texts: DataFrame) -> DataFrame:
    """Word offsets beyond those of their unit. The word is joined first, so that no subquery stands in a join's condition."""
    unit = aligned.join(words.select(F.col("id").alias("word_id"), "ayah_id"), "word_id")
    span = texts.select("edition_id", "ayah_id", F.col("char_start").alias("_from"), F.col("char_end").alias("_to"))
    return unit.join(span, ["edition_id", "ayah_id"]).filter((F.col("char_start") < F.col("_from")) | (F.col("char_end") > F.col("_to")))


def missing_pairs(left: DataFrame, right: DataFrame, have: DataFrame) -> DataFrame:
    """Combinations of an edition (few, declared) and a unit that have no row."""
    return right.crossJoin(F.broadcast(left)).join(have, [*left.columns, *right.columns], "left_anti")


def unclassified_characters(texts: DataFrame, column: str = "raw") -> DataFrame:
    """(char, n) of what no class of the ladder holds, after NFC."""
    rest = texts.select(F.explode(F.split(F.translate(nfc(F.col(column)), CLASSIFIED, ""), "")).alias("char")).filter("char <> ''")
    return rest.groupBy("char").agg(F.count(F.lit(1)).alias("n"))


def _key(columns: list[str]) -> Column:
    return F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit("\x02")) for c in columns])


def _space(table: str, columns: list[str]) -> str:
    return f"{table}.{','.join(columns)}"


def _note(space: str, key: Column, role: str, low: Column | None = None, high: Column | None = None, when: Column | None = None) -> Column:
    """What one row says about a key: in what role it names it, and up to two numbers."""
    number = lambda c: (F.lit(None) if c is None else c).cast("long")
    note = F.struct(F.lit(space).alias("space"), key.cast("string").alias("key"), F.lit(role).alias("role"), number(low).alias("low"), number(high).alias("high"))
    return F.when(key.isNotNull() if when is None else key.isNotNull() & when, note)


def _fact(name: str, of: Column | None = None) -> Column:
    """A row that counts for a fact (all do, if of is None)."""
    return _note("", F.lit(""), name, when=None if of is None else F.coalesce(of, F.lit(False)))


def _notes(t: dict[str, DataFrame], declared: list[int] | None, reference: list[int], written: list[int]) -> dict[str, list[Column]]:
    """By table: all that its rows are asked, so that one scan answers it."""
    out: dict[str, list[Column]] = {name: [_fact(f"rows:{name}")] for name in t}
    for name, keys in [*PRIMARY_KEYS.items(), *UNIQUE]:
        if name in t:
            own = {"ayah": ("word_start", "word_end"), "word": ("ayah_id", None), "ayah_text": ("char_start", "char_end")}.get(name, (None, None)) if keys == PRIMARY_KEYS.get(name) else (None, None)
            out[name].append(_note(_space(name, keys), _key(keys), "self", *[None if c is None else F.col(c) for c in own]))
    for child, column, parent, key in FOREIGN_KEYS:
        if child in t and parent in t:
            span = F.col("id") if (child, column) == ("word", "ayah_id") else None
            out[child].append(_note(_space(parent, [key]), F.col(column), f"{child}.{column}", span, span))
    for name, rule in DOMAINS:
        if name in t:
            out[name].append(_fact(f"{name}: {rule}", F.expr(f"not ({rule})")))
    out["ayah"] += [_note("ayah.id", F.col("id") + 1, "next", high=F.col("word_end")), _fact("ayah without words", F.col("word_start").isNull() | F.col("word_end").isNull())]
    out["edition"] += [_fact("reference", F.col("is_reference") == 1), _fact("edition without source", F.col("source_id").isNull())]
    # ladders are recomputed where they are wanted only
    ladder = audited(F.when(F.col("edition_id").isin(*reference, *written), F.struct(*LEVELS)))
    of = lambda ids, name: F.col("edition_id").isin(*ids) & ladder[name]
    out["ayah_text"] += [_fact("empty text", F.trim("plain") == ""), _fact("invisible", F.col("plain").rlike(f"[{INVISIBLE}]")), _fact("no tokens", F.col("token_count").isNull() | (F.col("token_count") < 1))]
    out["ayah_text"] += [_fact("drifted", of(reference, "drifted")), _fact("unstable", of(reference, "unstable")), _fact("unclassified", of(written, "unclassified"))]
    out["word"] += [_note("root.text", F.col("root"), "word.root", when=F.col("root") != ""), _fact("rooted", F.col("root") != "")]
    out["word_text"].append(_note("word.id", F.col("word_id"), "at", F.col("char_start"), F.col("char_end")))
    out["root"].append(F.when(F.lit(True), F.struct(F.lit("").alias("space"), F.lit("").alias("key"), F.lit("root words").alias("role"), F.col("word_count").cast("long").alias("low"), F.lit(None).cast("long").alias("high"))))
    if declared is not None:
        out["surah"].append(_fact("other verse counts", ~F.col("ayah_count").eqNullSafe(F.get(F.array(*[F.lit(n).cast("long") for n in declared]), (F.col("number") - 1).cast("int")))))
    if "build" in t:
        out["build"] += [_fact(f"has {k}", F.col("key") == k) for k in METADATA]
    return out


def facts(t: dict[str, DataFrame], declared: list[int] | None, reference: list[int], written: list[int]) -> DataFrame:
    """(fact, n): every number that the checks need, from one scan of each table.

    Rows say what they know of the keys they hold or name. What is said of one
    key meets in one group, summed by role before it is moved, so no key is
    more than a few rows. That table is written once; word offsets, which are
    known by word and bounded by text, meet in a second, smaller grouping.
    """
    asked = _notes(t, declared, reference, written)
    said = [t[name].select(F.explode(F.filter(F.array(*notes), lambda x: x.isNotNull())).alias("x")).select("x.*") for name, notes in asked.items()]
    every = reduce(DataFrame.unionByName, said).groupBy("space", "key", "role").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("low").alias("total"))
    held = kept(every, "said")
    plain = held.filter("space = ''").select(F.col("role").alias("fact"), F.when(F.col("role") == "root words", F.col("total")).otherwise(F.col("n")).alias("n"))
    own = F.max(F.when(F.col("role") == "self", F.struct("n", "low", "high")))
    keyed = held.filter("space <> ''").groupBy("space", "key").agg(own.alias("own"), F.collect_list(F.struct("role", "n", "low", "high")).alias("said"))
    of = lambda role: F.get(F.filter("said", lambda x: x["role"] == role), 0)
    is_ayah, there = F.col("space") == "ayah.id", F.col("own").isNotNull()
    one = lambda name, when: F.when(when, F.struct(F.lit(name).alias("fact"), F.lit(1).cast("long").alias("n")))
    lost = F.when(~there, F.transform(F.filter("said", lambda x: ~x["role"].isin("self", "next", "at")), lambda x: F.struct(F.concat(F.lit("lost:"), x["role"]).alias("fact"), x["n"].alias("n"))))
    texts = F.when((F.col("space") == "edition.id") & of("ayah_text.edition_id").isNotNull(), F.struct(F.concat(F.lit("texts:"), "key").alias("fact"), of("ayah_text.edition_id")["n"].alias("n")))
    word = of("word.ayah_id")
    about = F.array(
        F.when(F.col("own.n") > 1, F.struct(F.concat(F.lit("repeated:"), "space").alias("fact"), F.lit(1).cast("long").alias("n"))), texts,
        one("surahs known", there & (F.col("space") == "surah.number")),
        one("first ids", is_ayah & there & of("next").isNull()),
        one("backwards", is_ayah & there & (of("next")["high"] >= F.col("own.low"))),
        one("outside", is_ayah & there & ((word["low"] < F.col("own.low")) | (word["high"] > F.col("own.high")))),
    )
    listed = F.concat(F.filter(about, lambda x: x.isNotNull()), F.coalesce(lost, F.array().cast("array<struct<fact:string,n:bigint>>")))
    of_keys = keyed.select(F.explode(listed).alias("f")).select("f.fact", "f.n")
    # word_text names its word; which text that is, the word says
    spots = t["word_text"].sparkSession
    placed = held.filter("space = 'word.id' and role in ('self', 'at')").groupBy("key").agg(F.max(F.when(F.col("role") == "self", F.col("low"))).alias("ayah"), F.min(F.when(F.col("role") == "at", F.col("low"))).alias("low"), F.max(F.when(F.col("role") == "at", F.col("high"))).alias("high")).filter("low is not null and ayah is not null")
    aligned = spots.createDataFrame([(e,) for e in reference], "edition_id long")  # words are aligned to the reference edition
    at = placed.crossJoin(F.broadcast(aligned)).select(_key(["edition_id", "ayah"]).alias("key"), "low", "high")
    span = held.filter(F.col("space") == _space("ayah_text", PRIMARY_KEYS["ayah_text"])).select("key", F.col("low").alias("first"), F.col("high").alias("last"))
    offset = at.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high")).join(span, "key").filter("low < first or high > last").agg(F.count(F.lit(1)).alias("n")).select(F.lit("offsets").alias("fact"), "n")
    return reduce(DataFrame.unionByName, [plain, of_keys, offset]).groupBy("fact").agg(F.sum("n").alias("n"))


def all_checks(t: dict[str, DataFrame], wanted: dict[str, int], counts_by_surah: list[int] | None = None, editions: list[str] | None = None, needle: str = "الله") -> DataFrame:
    """All checks of a compiled store: name, ok, detail. wanted: expected numbers (surahs, ayahs, words, segments, exceptions, aligned_percent), any of which may be missing.

    Every table is scanned once. Editions are declared, so few; their rows are
    read before, as what is asked of texts depends on them.
    """
    spark = t["ayah"].sparkSession
    declared = t["edition"].collect()
    tables = {name: t[name] for name in PRIMARY_KEYS if name in t} | {"edition": spark.createDataFrame(declared, t["edition"].schema)}
    reference, written = sorted({r.id for r in declared if r.is_reference == 1}), sorted({r.id for r in declared if r.kind == "quran"})
    told = {r.fact: r.n for r in facts(tables, counts_by_surah, reference, written).collect()}  # a row a fact, of which the schema bounds the number
    n = lambda fact: told.get(fact) or 0
    out: list[tuple[str, bool, str]] = []

    def check(name: str, ok: bool, detail: object) -> None:
        out.append((name, bool(ok), str(detail)))

    def none(name: str, fact: str) -> None:
        check(name, n(fact) == 0, f"{n(fact)} against it")

    def equal(name: str, fact: str, number: int) -> None:
        check(name, n(fact) == number, f"{n(fact)}, expected {number}")

    for name, table in (("surahs", "surah"), ("ayahs", "ayah"), ("words", "word"), ("segments", "segment"), ("exceptions", "spine_exception")):
        if name in wanted:
            equal(f"number of {name}", f"rows:{table}", wanted[name])
    if counts_by_surah is not None:
        check("verse counts by surah", n("other verse counts") == 0 and n("surahs known") == len(counts_by_surah), f"{n('other verse counts')} against it")
    check("ayah ids have no gaps", n("first ids") <= 1, f"{n('first ids')} ids begin a run")
    for r in declared:
        check(f"edition is complete: {r.slug}", n(f"texts:{r.id}") == n("rows:ayah"), f"{n(f'texts:{r.id}')} texts")
    equal("one reference edition", "reference", 1)
    if editions is not None:
        missing = sorted(set(editions) - {r.slug for r in declared})
        check("declared editions are there", not missing, ", ".join(missing))
    none("no empty text", "empty text")
    none("every ayah has words", "ayah without words")
    none("words lie within their ayah", "outside")
    none("words follow the order of ayahs", "backwards")
    if "aligned_percent" in wanted:
        a, w = n("rows:word_text"), n("rows:word")
        check("share of aligned words", w and 100 * a / w >= wanted["aligned_percent"], f"{a} of {w}")
    none("word offsets lie within their text", "offsets")
    none("roots of words are listed", "lost:word.root")
    check("root counts add up", n("root words") == n("rooted"), f"{n('root words')} against {n('rooted')}")
    for name, fact in (("stored rungs equal their recomputation", "drifted"), ("rungs are stable", "unstable"), ("every character is classified", "unclassified"), ("no invisible characters at plain", "invisible"), ("every text has tokens", "no tokens")):
        none(name, fact)
    for child, column, parent, key in FOREIGN_KEYS:
        if child in t and parent in t:
            none(f"{child}.{column} leads to {parent}.{key}", f"lost:{child}.{column}")
    for name, keys in [*PRIMARY_KEYS.items(), *UNIQUE]:
        if name in t:
            none(f"{name} has each {', '.join(keys)} once", f"repeated:{_space(name, keys)}")
    for name, rule in DOMAINS:
        if name in t:
            none(f"{name}: {rule}", f"{name}: {rule}")
    none("every edition names a source", "edition without source")
    if "build" in t:
        lacking = [k for k in METADATA if not n(f"has {k}")]
        check("build metadata is there", not lacking, ", ".join(lacking))
    hits = (search.indexed(t, needle, "rasm") if "postings" in t else search.phrase(t["ayah_text"], needle, "rasm")).count()
    check("search responds", hits, f"{hits} hits")
    return spark.createDataFrame(out, "name string, ok boolean, detail string")
