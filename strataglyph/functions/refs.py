"""References such as Q2:255:1 and ranges of them, for one string or a column."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = ("surah", "ayah", "word", "segment")
LAST_SURAH = 114


class RefError(ValueError):
    """A string that is no reference."""


@dataclass(frozen=True, order=True)
class Ref:
    surah: int
    ayah: int | None = None
    word: int | None = None
    segment: int | None = None

    def __post_init__(self) -> None:
        values = [getattr(self, p) for p in PARTS]
        given = [v for v in values if v is not None]
        if values[: len(given)] != given:
            raise RefError(f"a part is missing before another one: {values}")
        if not 1 <= self.surah <= LAST_SURAH:
            raise RefError(f"no surah {self.surah}; they run from 1 to {LAST_SURAH}")
        if min(given) < 1:
            raise RefError("parts count from 1")

    @property
    def level(self) -> str:
        return PARTS[sum(getattr(self, p) is not None for p in PARTS) - 1]

    @staticmethod
    def parse(text: str) -> Ref:
        found = re.fullmatch(r"[Qq]?(\d+(?::\d+){0,3})", text.strip())
        if not found:
            raise RefError(f"not a reference: {text!r}")
        return Ref(*map(int, found[1].split(":")))

    def __str__(self) -> str:
        return "Q" + ":".join(str(v) for p in PARTS if (v := getattr(self, p)) is not None)


@dataclass(frozen=True)
class RefRange:
    start: Ref
    end: Ref

    def __post_init__(self) -> None:
        place = lambda r: (r.surah, r.ayah or 0)
        if place(self.end) < place(self.start):
            raise RefError(f"runs backwards: {self.start} to {self.end}")

    @staticmethod
    def parse(text: str) -> RefRange:
        left, dash, right = text.strip().partition("-")
        start = Ref.parse(left)
        if not dash:
            return RefRange(start, start)
        # an end with fewer parts than the start takes over the surah, and nothing else
        if right.count(":") < left.count(":"):
            right = f"{start.surah}:{right.strip()}"
        return RefRange(start, Ref.parse(right))

    def __str__(self) -> str:
        return str(self.start) if self.start == self.end else f"{self.start}-{str(self.end)[1:]}"


def parse(c: Column) -> Column:
    """A struct of the four parts, null where the string is no valid reference."""
    return _checked(_parts(c))


def _parts(c: Column) -> Column:
    match = r"(?U)^\s*[Qq]?(\d+)(?::(\d+))?(?::(\d+))?(?::(\d+))?\s*$"
    part = lambda k: _number(F.nullif(F.regexp_extract(c, match, k), F.lit("")))
    return F.struct(*[part(k + 1).alias(p) for k, p in enumerate(PARTS)])


def _checked(raw: Column) -> Column:
    good = raw["surah"].between(1, LAST_SURAH)
    for p in PARTS[1:]:
        good = good & (raw[p].isNull() | (raw[p] >= 1))
    return F.when(good, raw)


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def _number(c: Column) -> Column:
    """An int from digits; Arabic-Indic digits of both kinds count."""
    return F.translate(c, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789").try_cast("int")


def level(ref: Column) -> Column:
    out = F.when(ref["surah"].isNotNull(), F.lit(PARTS[0]))
    for p in PARTS[1:]:
        out = F.when(ref[p].isNotNull(), F.lit(p)).otherwise(out)
    return out


def show(ref: Column) -> Column:
    return F.when(ref["surah"].isNotNull(), F.concat(F.lit("Q"), F.concat_ws(":", *[ref[p].cast("string") for p in PARTS])))


def parse_range(c: Column) -> Column:
    """A struct of start and end, null where the string is no valid range or runs backwards; a single reference is a range of itself."""
    cut = lambda k: F.regexp_extract(c, r"(?Us)^\s*([^-]*?)\s*(?:(-)\s*([^-]*?)\s*)?$", k)
    colons = lambda x: F.length(x) - F.length(F.translate(x, ":", ""))
    # an end with fewer parts than the start takes over the surah, and nothing else
    told = lambda x: F.when(colons(x["right"]) < colons(x["left"]), F.concat(x["start"]["surah"].cast("string"), F.lit(":"), x["right"])).otherwise(x["right"])
    place = lambda r: F.struct(r["surah"], F.coalesce(r["ayah"], F.lit(0)).alias("ayah"))
    ordered = lambda x: F.when(x["start"].isNotNull() & x["end"].isNotNull() & (place(x["end"]) >= place(x["start"])), x)
    ends = lambda x: F.when(x["dash"] == "", x["start"]).otherwise(_with(_parts(told(x)), _checked))
    both = lambda x: _with(F.struct(x["start"].alias("start"), ends(x).alias("end")), ordered)
    sides = lambda x: _with(F.struct(_with(_parts(x["left"]), _checked).alias("start"), x["left"], x["dash"], x["right"]), both)
    return F.when(c.isNotNull(), _with(F.struct(cut(1).alias("left"), cut(2).alias("dash"), cut(3).alias("right")), sides))


def show_range(r: Column) -> Column:
    first, last = show(r["start"]), show(r["end"])
    return F.when(first == last, first).otherwise(F.concat(first, F.lit("-"), F.substr(last, F.lit(2))))
