"""Morphological feature blobs: 'FLAG|KEY:VALUE|...'."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Flags of segments that are no stem.
AFFIXES = ("PREF", "SUFF")


def items(blob: Column) -> Column:
    return F.split(blob, r"\|")


def pairs(blob: Column) -> Column:
    """An array of (key, value), split at the first colon; a flag has the value ''. Keys may repeat."""
    kept = F.filter(items(F.coalesce(blob, F.lit(""))), lambda x: x != "")
    key = lambda x: F.substring_index(x, ":", 1)
    return F.transform(kept, lambda x: F.struct(key(x).alias("key"), F.when(F.contains(x, F.lit(":")), F.substring(x, F.length(key(x)) + 2, F.length(x))).otherwise(F.lit("")).alias("value")))


def feature(blob: Column, key: str) -> Column:
    """The value of the first ``key:`` item, which may be ''; null where there is none."""
    head = f"{key}:"
    return F.get(F.transform(F.filter(items(blob), lambda x: x.startswith(head)), lambda x: F.substring(x, len(head) + 1, 1 << 30)), 0)


def tag(blob: Column) -> Column:
    """The first item if it is a flag."""
    first = F.get(items(blob), 0)
    return F.when(~F.contains(first, F.lit(":")), first)


def stem(segments: Column) -> Column:
    """The stem among a word's segments (structs in order, with root and features): the first with a root, else the first that is no affix, else the first."""
    rooted = F.filter(segments, lambda s: F.coalesce(s["root"], F.lit("")) != "")
    free = F.filter(segments, lambda s: ~F.arrays_overlap(items(s["features"]), F.array(*map(F.lit, AFFIXES))))
    return F.coalesce(F.get(rooted, 0), F.get(free, 0), F.get(segments, 0))
