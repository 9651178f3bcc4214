"""Payloads over a compiled store, each from set-based queries, none from a query a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ladder import LEVELS, known_level, text_at
from ..functions.refs import RefRange
from ..sources.shared import kept
from . import distance, lexicon, search, variants

MOST_AYAHS, MOST_HITS, MOST_ROOTS, MOST_WORDS, EXAMPLES = 50, 60, 60, 300, 4


def _dicts(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


class Api:
    """Methods take plain values and return what JSON can hold."""

    ROUTES = ("meta", "ladder", "words", "apparatus", "skeleton", "ambiguous", "search", "roots", "root", "exceptions", "tree")

    def __init__(self, tables: dict[str, DataFrame]) -> None:
        self.t = tables

    def _edition(self, slug: str) -> DataFrame:
        return self.t["edition"].filter(F.col("slug") == slug)

    def _texts(self, slug: str) -> DataFrame:
        one = self._edition(slug).select(F.col("id").alias("edition_id"), "slug")
        return self.t["ayah_text"].join(F.broadcast(one), "edition_id")

    def span(self, ref: str, most: int | None = MOST_AYAHS) -> tuple[int, int]:
        """First and last ayah id of a reference; unknown ones fail."""
        wanted = RefRange.parse(ref)
        ids = []
        for end, column in ((wanted.start, "ayah_start"), (wanted.end, "ayah_end")):
            if end.ayah is None:
                row = self.t["surah"].filter(F.col("number") == end.surah).select(F.col(column).alias("id")).first()
            else:
                row = self.t["ayah"].filter((F.col("surah") == end.surah) & (F.col("number") == end.ayah)).select("id").first()
            if row is None:
                raise LookupError(f"{end} is not in the store")
            ids.append(row.id)
        return ids[0], ids[1] if most is None else min(ids[1], ids[0] + most - 1)

    def meta(self) -> dict:
        counts = {n: self.t[n].count() for n in ("surah", "ayah", "word", "segment", "root", "lemma", "variant", "ayah_text", "spine_exception")}
        return {"levels": list(LEVELS), "editions": _dicts(self.t["edition"].orderBy("id")), "surahs": _dicts(self.t["surah"].orderBy("number")), "build": {r.key: r.value for r in self.t["build"].collect()}, "counts": counts}

    def ladder(self, ref: str = "Q1:1", edition: str = "uthmani-hafs") -> dict:
        first, last = self.span(ref)
        rows = self._texts(edition).filter(F.col("ayah_id").between(first, last)).join(self.t["v_ayah"].select(F.col("id").alias("ayah_id"), "ref"), "ayah_id")
        return {"ref": ref, "edition": edition, "ayahs": _dicts(rows.select("ayah_id", "ref", *LEVELS).orderBy("ayah_id"))}

    def words_of(self, first: int, last: int) -> DataFrame:
        """The words of a span of ayahs, with the reference's spelling and their segments."""
        own = self.t["word"].filter(F.col("ayah_id").between(int(first), int(last)))
        reference = self.t["edition"].filter("is_reference = 1").select(F.col("id").alias("edition_id"))
        texts = self.t["word_text"]
        texts = texts.filter(F.col("ayah_id").between(int(first), int(last))) if "ayah_id" in texts.columns else texts
        spelled = texts.join(F.broadcast(reference), "edition_id", "left_semi").select("word_id", F.col("form").alias("text_form"))
        segment = self.t["segment"]
        segment = segment.filter(F.col("ayah_id").between(int(first), int(last))) if "ayah_id" in segment.columns else segment
        mine = segment.join(own.select(F.col("id").alias("word_id")), "word_id", "left_semi")
        parts = mine.groupBy("word_id").agg(F.array_sort(F.collect_list(F.struct("position", "form", "pos", "tag", "root", "lemma", "features"))).alias("segments"))
        rows = own.join(spelled, own["id"] == spelled["word_id"], "left").drop("word_id").join(parts, own["id"] == parts["word_id"], "left").drop("word_id")
        return rows.orderBy("ayah_id", "position")

    def words(self, ayah_id: int = 1) -> dict:
        return {"ayah_id": int(ayah_id), "words": _dicts(self.words_of(ayah_id, ayah_id))}

    def apparatus(self, ayah_id: int = 1) -> dict:
        editions = self.t["edition"].select(F.col("id").alias("edition_id"), "slug", "riwayah")
        reference = self.t["edition"].filter("is_reference = 1").select("riwayah").first()
        rows = _dicts(variants.apparatus(self.t["variant"].filter(F.col("ayah_id") == int(ayah_id)), editions, reference.riwayah if reference else None).orderBy("edition_id", "ref_position", *self._placed()))
        of = lambda b: [r for r in rows if r["bucket"] == b]
        return {"ayah_id": int(ayah_id), "consonantal": of("consonantal"), "vocalic": of("vocalic"), "orthographic": of("orthographic"), "orthographic_vocalic_count": len(of("orthographic_vocalic"))}

    def skeleton(self, q: str = "") -> dict:
        shape = text_at(q.strip(), "archigraphemic")
        if not shape:
            return {"q": q, "skeleton": "", "readings": []}
        # the words of one shape are sought once, and read twice
        words = kept(self.t["v_word"].filter(F.col("archigraphemic") == shape).select("id", "ref", "form", "rasm", "archigraphemic"), "shape")
        some = lexicon.first_of_each(words, "rasm", ["id"], EXAMPLES).groupBy("rasm").agg(F.array_sort(F.collect_list(F.struct("id", "ref", "form"))).alias("examples"))
        rows = lexicon.readings(words).join(some, "rasm").select("rasm", "occurrences", "examples").orderBy(F.desc("occurrences"), "rasm")
        return {"q": q, "skeleton": shape, "readings": _dicts(rows)}

    def ambiguous(self, limit: int = 40) -> dict:
        return {"clusters": _dicts(lexicon.most_ambiguous(self.t["word"], limit))}

    def search(self, q: str = "", level: str = "rasm", edition: str = "uthmani-hafs") -> dict:
        if level not in search.SEARCHED or not q.strip():
            return {"q": q, "level": level, "total": 0, "hits": []}
        texts = self._texts(edition).join(search.indexed(self.t, q, level), ["edition_id", "ayah_id"], "left_semi")
        hits = texts.join(self.t["v_ayah"].select(F.col("id").alias("ayah_id"), "ref"), "ayah_id")
        return {"q": q, "level": level, "total": hits.count(), "hits": _dicts(hits.select("ayah_id", "ref", "raw", F.col(level).alias("text")).orderBy("ayah_id").limit(MOST_HITS))}

    def roots(self, q: str = "") -> dict:
        found = lexicon.find_roots(self.t["root"], q, text_at(q, "archigraphemic"), MOST_ROOTS) if q else self.t["root"].orderBy(F.desc("word_count"), "text").limit(MOST_ROOTS)
        return {"q": q, "roots": _dicts(found)}

    def root(self, q: str) -> dict:
        known = _dicts(self.t["root"].filter(F.col("text") == q))
        words = self.t["v_word"].filter(F.col("root") == q).orderBy("id").limit(MOST_WORDS)
        near = [] if known else _dicts(self.t["root"].filter(F.col("archigraphemic") == text_at(q, "archigraphemic")).orderBy(F.desc("word_count"), "text").limit(5))
        return {"root": known[0] if known else None, "words": _dicts(words.select("id", "ref", "form", "lemma", "pos")), "like": near}

    def exceptional(self) -> DataFrame:
        """The exceptions with their references, in no order."""
        return self.t["spine_exception"].join(self.t["v_ayah"].select(F.col("id").alias("ayah_id"), "ref"), "ayah_id")

    def exceptions(self) -> dict:
        return {"exceptions": _dicts(self.exceptional().orderBy("ayah_id"))}

    def tree(self) -> dict:
        readings = self.t["edition"].filter("kind = 'quran' and orthography = 'uthmani'").select(F.col("id").alias("edition_id"), "slug", "riwayah")
        texts = self.t["ayah_text"].join(F.broadcast(readings), "edition_id").select(F.col("edition_id").alias("edition"), F.col("ayah_id").alias("unit"), "rasm")
        far = _dicts(distance.intensity(distance.matrix(texts)))  # at most a row a pair of declared editions
        slugs = {r.edition_id: r for r in readings.orderBy("edition_id").collect()}
        name = lambda i: slugs[i].slug
        near = {a: min((r["distance"], r["b"]) for r in far if r["a"] == a and r["b"] != a) for a in slugs if any(r["a"] == a != r["b"] for r in far)}
        return {
            "editions": [{"slug": r.slug, "riwayah": r.riwayah} for r in slugs.values()],
            "distance": {f"{name(r['a'])}|{name(r['b'])}": r["distance"] for r in far},
            "intensity": {f"{name(r['a'])}|{name(r['b'])}": r["intensity"] for r in far},
            "nearest": {name(a): {"slug": name(b), "distance": d} for a, (d, b) in near.items()},
            "pairs": sorted({tuple(sorted((name(a), name(b)))) for a, (_, b) in near.items()}),
        }

    def _placed(self) -> list[str]:
        """What variants of an ayah are ordered by: ids, or the blocks and places that ids are made from."""
        return ["id"] if "id" in self.t["variant"].columns else ["block", "k"]

    def varied(self, ref: str, every: bool = False) -> DataFrame:
        """The variants of a span of ayahs, in no order."""
        first, last = self.span(ref, None)
        rows = self.t["variant"].filter(F.col("ayah_id").between(first, last))
        rows = rows if every else rows.filter("same_rasm = 0")
        flag = F.when(F.col("same_rasm") == 1, "same rasm").when(F.col("same_archi") == 1, "same undotted").otherwise("different")
        return rows.join(F.broadcast(self.t["edition"].select(F.col("id").alias("edition_id"), "slug", "riwayah")), "edition_id").withColumn("flag", flag)

    def variants(self, ref: str, every: bool = False) -> list[dict]:
        return _dicts(self.varied(ref, every).orderBy("ayah_id", "edition_id", *self._placed()))

    def shown(self, ref: str, editions: list[str], level: str = "raw") -> DataFrame:
        """slug, ayah_id and text of a span in some editions, in no order."""
        known_level(level)
        first, last = self.span(ref, None)
        wanted = self.t["edition"].filter(F.col("slug").isin(*editions)).select(F.col("id").alias("edition_id"), "slug")
        rows = self.t["ayah_text"].filter(F.col("ayah_id").between(first, last)).join(F.broadcast(wanted), "edition_id")
        return rows.select("slug", "ayah_id", F.col(level).alias("text"))

    def show(self, ref: str, editions: list[str], level: str = "raw") -> list[dict]:
        return sorted(_dicts(self.shown(ref, editions, level)), key=lambda r: (editions.index(r["slug"]), r["ayah_id"]))

    def counters(self) -> list[dict]:
        """Texts, and consonantal and vocalic variants, of every edition."""
        editions = self.t["edition"].select(F.col("id").alias("edition_id"), "slug")
        texts = self.t["ayah_text"].groupBy("edition_id").agg(F.count(F.lit(1)).alias("ayahs"))
        return _dicts(variants.counters(self.t["variant"], editions).join(texts, "edition_id", "left").orderBy("edition_id"))

    def stats(self) -> dict[str, int]:
        return {n: self.t[n].count() for n in ("surah", "ayah", "edition", "ayah_text", "word", "segment", "segment_feature", "word_text", "spine_exception", "root", "lemma", "variant")}

    def call(self, route: str, query: dict[str, str]) -> dict:
        """A route of the whitelist with its parameters; errors come back as {"error": ...}."""
        if route not in self.ROUTES:
            raise LookupError(route)
        try:
            return getattr(self, route)(**query)
        except (ValueError, LookupError, TypeError) as error:
            return {"error": str(error)}
