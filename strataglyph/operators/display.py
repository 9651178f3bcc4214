"""What pages show of texts and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ladder import ORTHOGRAPHIC_MARKS, QURANIC_MARKS, VOWEL_MARKS

#: Classes of characters that a page tints.
TINTS = {"vowel": VOWEL_MARKS + ORTHOGRAPHIC_MARKS, "apparatus": QURANIC_MARKS}


def tinted(c: Column) -> Column:
    """Runs of characters of one class, in order: an array of (class, text); class is null beyond the tinted ones."""
    classes = "|".join(f"[{chars}]+" for chars in TINTS.values())
    runs = F.regexp_extract_all(c, F.lit(f"({classes}|[^{''.join(TINTS.values())}]+)"), 1)
    kind = lambda run: [run.rlike(f"^[{chars}]") for chars in TINTS.values()]

    def named(run: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, hit in zip(TINTS, kind(run), strict=True):
            out = F.when(hit, F.lit(name)).otherwise(out)
        return F.struct(out.alias("class"), run.alias("text"))

    return F.transform(runs, named)


def ayah_of(ref: Column) -> Column:
    """The reference of the ayah that a reference to a word or segment lies in."""
    return F.substring_index(ref, ":", 2)


#: How many rows a page shows of each list.
SHOWN = {"vocalic": 40, "clusters": 24, "occurrences": 36}


def shown(rows: DataFrame, what: str, *order: Column | str) -> tuple[DataFrame, int]:
    """The rows that a page shows of a list, in order, and how many there are in all."""
    return rows.orderBy(*order).limit(SHOWN[what]), rows.count()
