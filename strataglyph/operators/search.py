"""Phrase search over whole tokens of a rung."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ladder import text_at
from ..sources.shared import kept
from . import index

#: Rungs that are searched.
SEARCHED = ("unvocalized", "rasm", "archigraphemic")


def _latin_fold() -> tuple[str, str]:
    """Accented Latin letters and what is left of them without their marks."""
    pairs = []
    for c in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(c))
        if len(base) > 1 and base[0].isascii():
            pairs.append((chr(c), base[0]))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


_FROM, _TO = _latin_fold()


def terms(c: Column) -> Column:
    """Search tokens: runs of letters, numbers and private-use characters, in lower case and without Latin accents. Marks separate."""
    return F.regexp_extract_all(F.lower(F.translate(c, _FROM, _TO)), F.lit(r"([\p{L}\p{N}\p{Co}]+)"), 1)


def needle_terms(text: str, level: str) -> list[str]:
    folded = text_at(text, level).translate(str.maketrans(_FROM, _TO)).lower()
    out = re.split("|".join(("[^\\w]", "_")), folded)
    kept = "".join(ch if unicodedata.category(ch)[0] in "LN" or unicodedata.category(ch) == "Co" else " " for ch in " ".join(out))
    return kept.split()


def phrase(texts: DataFrame, text: str, level: str = "rasm", column: str | None = None) -> DataFrame:
    """Rows whose column (by default the rung of that name) has the phrase's tokens side by side. A phrase without tokens, or an unknown rung, matches nothing."""
    if level not in SEARCHED:
        return texts.filter(F.lit(False))
    wanted = needle_terms(text, level)
    if not wanted:
        return texts.filter(F.lit(False))
    hay = F.concat(F.lit(" "), F.array_join(terms(F.col(column or level)), " "), F.lit(" "))
    return texts.filter(F.contains(hay, F.lit(f" {' '.join(wanted)} ")))


def postings(texts: DataFrame, key: str | list[str], column: str) -> DataFrame:
    """(term, key, pos): an inverted index, for stores that are searched often."""
    keys = [key] if isinstance(key, str) else key
    return texts.select(*keys, F.posexplode(terms(F.col(column))).alias("pos", "term")).select("term", *keys, "pos")


def stored_index(ayah_text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, term): blocks of every rung that is searched, and their dictionary, by level and edition."""
    held, words = index_of(ayah_text, SEARCHED)
    return index.laid_out(held, ("level", "edition_id")), words


def index_of(ayah_text: DataFrame, levels: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(postings, term) of some rungs, as stored_index gives them, but as they were made: in no order."""
    held = kept(index.blocks_of_texts(ayah_text.select("edition_id", "ayah_id", *levels), ("edition_id",), "ayah_id", {level: terms(F.col(level)) for level in levels}, "level"), "postings")
    return held, index.dictionary(held, ("level", "edition_id"))


def indexed(t: dict[str, DataFrame], text: str, level: str) -> DataFrame:
    """(edition_id, ayah_id) that have the phrase, by the stored index; an unknown rung has none."""
    wanted = needle_terms(text, level) if level in SEARCHED else []
    of_level = lambda name: t[name].filter(F.col("level") == level)
    return index.phrase(of_level("postings"), of_level("term"), wanted, ("edition_id",), "ayah_id").select("edition_id", "ayah_id")


def phrase_by_postings(places: DataFrame, wanted: list[str], key: str) -> DataFrame:
    """Keys (integers) that hold the tokens side by side, by an index of rows (term, key, pos) that is made for it."""
    held = kept(index.laid_out(index.blocks(places, (), key), ()), "postings", index.LAYOUT)
    return index.phrase(held, index.dictionary(held, ()), wanted, (), key).select(key)
