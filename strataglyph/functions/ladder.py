"""The six-rung normalization ladder, as Column builders and for plain strings.

Each rung is made from the one before it, and each ends in NFC, which needs
Python (the JVM's Unicode tables are older than Python's). So a row's rungs are
made in one Arrow call, however many are wanted; text that has no combining
marks needs none.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

LEVELS = ("raw", "nfc", "plain", "unvocalized", "rasm", "archigraphemic")


# Character classes by code point -------------------------------------
TATWEEL = "\u0640"
INVISIBLE = "\u200b\u200c\u200d\u200e\u200f\u061c\u2066\u2067\u2068\u2069\ufeff"
QURANIC_MARKS = (
    "\u0614\u0615\u0616\u0617\u06d6\u06d7\u06d8\u06d9\u06da\u06db\u06dc\u06dd"
    "\u06de\u06e2\u06e3\u06e8\u06e9\u06ea\u06eb\u06ec\u06ed\u08d4\u08d5\u08d6"
    "\u08d7\u08d8\u08d9\u08da\u08db\u08dc\u08dd\u08de\u08df\u08e0\u08e1\u08e2"
)
VOWEL_MARKS = (
    "\u064b\u064c\u064d\u064e\u064f\u0650\u0651\u0652\u0656\u0657\u0658\u0659"
    "\u065a\u065b\u065c\u065d\u065e\u065f\u0670\u0618\u0619\u061a\u06e1\u06df"
    "\u06e0\u06e5\u06e6\u06e7\u08f0\u08f1\u08f2"
)
TANWIN = "\u064b\u064c\u064d\u08f0\u08f1\u08f2"
ORTHOGRAPHIC_MARKS = "\u0653\u0654\u0655\u06e4"
BARE_HAMZA = "\u0621\u0674"
LETTER_VARIANTS = {
    "\u06d2": "\u064a",  # yeh barree
    "\u06d3": "\u064a",  # yeh barree with hamza above
    "\u06cc": "\u064a",  # farsi yeh
    "\u06a9": "\u0643",  # keheh
}
HAMZA_CARRIERS = {
    "\u0622": "\u0627",  # alef with madda above
    "\u0623": "\u0627",  # alef with hamza above
    "\u0625": "\u0627",  # alef with hamza below
    "\u0671": "\u0627",  # alef wasla
    "\u0672": "\u0627",  # alef with wavy hamza above
    "\u0673": "\u0627",  # alef with wavy hamza below
    "\u0675": "\u0627",  # high hamza alef
    "\u0624": "\u0648",  # waw with hamza above
    "\u0626": "\u064a",  # yeh with hamza above
    "\u0649": "\u0649",  # alef maksura
}
ARCHI_ANY = {
    "\u062c": "\u062d",  # jeem
    "\u062e": "\u062d",  # khah
    "\u0630": "\u062f",  # thal
    "\u0632": "\u0631",  # zain
    "\u0634": "\u0633",  # sheen
    "\u0636": "\u0635",  # dad
    "\u0638": "\u0637",  # zah
    "\u063a": "\u0639",  # ghain
    "\u0641": "\u06a1",  # feh
    "\u0642": "\u06a1",  # qaf
    "\u0629": "\u0647",  # teh marbuta
}
ARCHI_NONFINAL = {
    "\u0628": "\u066e",  # beh
    "\u062a": "\u066e",  # teh
    "\u062b": "\u066e",  # theh
    "\u0646": "\u066e",  # noon
    "\u064a": "\u066e",  # yeh
    "\u0649": "\u066e",  # alef maksura
}
ARCHI_FINAL = {
    "\u0628": "\u066e",  # beh
    "\u062a": "\u066e",  # teh
    "\u062b": "\u066e",  # theh
    "\u0646": "\u06ba",  # noon
    "\u064a": "\u0649",  # yeh
    "\u0649": "\u0649",  # alef maksura
}
BASE_LETTERS = "\u0627\u0644\u0645\u0647\u0648\u0643\u062f\u0631\u0633\u0635\u0637\u0639\u062d\u066e\u06ba\u0649\u06a1" " "
ALIFS = "\u0627\u0649"
# ------------------------------------------------------------------------------------

MARK_CLASSES = {"tatweel": TATWEEL, "invisible": INVISIBLE, "apparatus": QURANIC_MARKS, "vowel": VOWEL_MARKS, "orthographic": ORTHOGRAPHIC_MARKS}
CLASSIFIED = "".join(sorted({*"".join(MARK_CLASSES.values()), *BARE_HAMZA, *LETTER_VARIANTS, *HAMZA_CARRIERS, *ARCHI_ANY, *ARCHI_NONFINAL, *BASE_LETTERS}))

_PLAIN_DROP = QURANIC_MARKS + INVISIBLE + TATWEEL
_RASM_DROP = ORTHOGRAPHIC_MARKS + BARE_HAMZA
_FOLD = {**HAMZA_CARRIERS, **{k: HAMZA_CARRIERS.get(v, v) for k, v in LETTER_VARIANTS.items()}}
# letters whose final and other forms merge alike can be folded with those of any position
_EVEN = {**ARCHI_ANY, **{c: x for c, x in ARCHI_NONFINAL.items() if ARCHI_FINAL[c] == x}}
_UNEVEN = "".join(c for c in ARCHI_NONFINAL if c not in _EVEN)
_SHAPE = ARCHI_NONFINAL[_UNEVEN[0]]


def _combining() -> str:
    """A regex class body of every character with a combining class."""
    spans: list[list[int]] = []
    for c in range(0x300, 0x110000):
        if unicodedata.combining(chr(c)):
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in spans)


_HEAL = f"([{TANWIN}][{_combining()}]*) ([{ALIFS}])(?= |%s)"


def _nfc_text(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFC", text)


def _without(chars: str) -> Callable[[str], str]:
    return partial(re.compile(f"[{chars}]+").sub, "")


def _replaced(text: str, pairs: dict[str, str]) -> str:
    for old, new in pairs.items():  # each a search for one character, far faster than a table
        if old in text:
            text = text.replace(old, new)
    return text


_drop_apparatus, _drop_vowels, _drop_signs = map(_without, (_PLAIN_DROP, VOWEL_MARKS, _RASM_DROP))
_heal_text = partial(re.compile(_HEAL % r"\Z").sub, r"\1\2")
_inner = partial(re.compile(f"[{_UNEVEN}](?=[^ ])").sub, _SHAPE)
_OUTER = {x: ARCHI_FINAL[x] for x in _UNEVEN}

#: How a rung is made from the one below it.
TEXT_STEPS: dict[str, Callable[[str], str]] = {
    "nfc": _nfc_text,
    "plain": lambda t: _nfc_text(_heal_text(_drop_apparatus(t))),
    "unvocalized": lambda t: _nfc_text(_drop_vowels(t)),
    "rasm": lambda t: _nfc_text(_replaced(_drop_signs(t), _FOLD)),
    "archigraphemic": lambda t: _nfc_text(_replaced(_inner(_replaced(t, _EVEN)), _OUTER)),
}


def _climb(text: str | None, steps: Sequence[str]) -> list[str | None]:
    """The rungs that the steps make one after the other."""
    out = []
    for step in steps:
        text = None if text is None else TEXT_STEPS[step](text)
        out.append(text)
    return out


def _last_of(steps: Sequence[str]) -> Callable[[Column], Column]:
    @F.pandas_udf(StringType())
    def climb(texts: pd.Series) -> pd.Series:
        # words repeat, so each text of a batch is climbed once
        made = {t: _climb(t, steps)[-1] for t in set(texts) if t is not None}
        return pd.Series([made.get(t) for t in texts], dtype=object)

    return climb


def climbed(c: Column, first: str = "nfc") -> Column:
    """A struct of the rungs from ``first`` on; c is at the rung below it."""
    steps = LEVELS[LEVELS.index(first) :]

    @F.pandas_udf(StructType([StructField(s, StringType()) for s in steps]))
    def climb(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_climb(t, steps) for t in texts], columns=list(steps), dtype=object)

    return climb(c)


STEPS: dict[str, Callable[[Column], Column]] = {step: _last_of((step,)) for step in TEXT_STEPS}


def nfc(c: Column) -> Column:
    return STEPS["nfc"](c)


def archigraphemic_of_rasm(c: Column) -> Column:
    return STEPS["archigraphemic"](c)


def _table(c: Column, pairs: dict[str, str]) -> Column:
    return F.translate(c, "".join(pairs), "".join(pairs.values()))


def _heal(c: Column) -> Column:
    return F.regexp_replace(c, _HEAL % r"\z", "$1$2")


def letters_skeleton(c: Column) -> Column:
    """The archigraphemic rung of text that is at ``rasm`` and has no combining marks: no Python at all."""
    return _table(F.regexp_replace(_table(c, _EVEN), f"[{_UNEVEN}](?=[^ ])", _SHAPE), _OUTER)


def known_level(level: str) -> str:
    if level not in LEVELS:
        raise ValueError(f"unknown normalization level {level!r}; one of {', '.join(LEVELS)}")
    return level


def normalize(c: Column, level: str) -> Column:
    """A text at a rung, in one call."""
    steps = LEVELS[1 : LEVELS.index(known_level(level)) + 1]
    return _last_of(steps)(c) if steps else c


#: Characters whose rungs are made and handed on at a time.
AT_A_TIME = 1 << 20


def _in_parts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches of few enough rows, with the rungs above column beside the others."""
    steps = LEVELS[1:]
    for batch in batches:
        texts, lo = batch.column(batch.schema.get_field_index(column)), 0
        while lo < len(batch):
            rungs, size, hi = [], 0, lo
            while hi < len(batch) and size < AT_A_TIME:
                text = texts[hi].as_py()
                rungs.append(_climb(text, steps))
                size, hi = size + len(text or ""), hi + 1
            made = [pa.array([r[k] for r in rungs], pa.string()) for k in range(len(steps))]
            yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, *made], names=[*batch.schema.names, *steps])
            lo = hi


def with_levels(df, column: str = "raw"):  # noqa: ANN001, ANN201
    """df with all rungs above ``column`` as columns. They are handed on a few rows at a time, as the rungs of long texts are many times their size."""
    return df.mapInArrow(lambda batches: _in_parts(batches, column), StructType([*df.schema.fields, *[StructField(level, StringType()) for level in LEVELS[1:]]]))


def audited(rungs: Column) -> Column:
    """What is wrong with a struct of stored rungs (of LEVELS): whether one differs from its recomputation from the rung below (drifted), whether its own step changes one once more (unstable), and whether the text has characters of no class (unclassified). One call a row; null for a null struct."""
    names = ("drifted", "unstable", "unclassified")
    odd = re.compile(f"[^{re.escape(CLASSIFIED)}]")

    def told(stored: list[str | None]) -> tuple[bool, ...]:
        step = lambda level, text: None if text is None else TEXT_STEPS[level](text)
        pairs = list(zip(LEVELS[1:], stored, stored[1:], strict=False))
        return any(step(level, below) != own for level, below, own in pairs), any(step(level, own) != own for level, _, own in pairs), bool(stored[0] and odd.search(_nfc_text(stored[0])))

    @F.pandas_udf(StructType([StructField(n, BooleanType()) for n in names]))
    def audit(rows: pd.DataFrame) -> pd.DataFrame:
        columns = [[None if pd.isna(x) else x for x in rows[level]] for level in LEVELS]
        return pd.DataFrame([told(list(r)) for r in zip(*columns, strict=True)], columns=list(names))

    return audit(rungs)


def register(spark, name: str = "rung") -> None:  # noqa: ANN001
    """Makes rung(text, level) callable from SQL; an unknown level fails."""

    @F.pandas_udf(StringType())
    def rung(texts: pd.Series, levels: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or v is None else text_at(t, v) for t, v in zip(texts, levels, strict=True)], dtype=object)

    spark.udf.register(name, rung)


def tokens(c: Column) -> Column:
    """Runs of anything but white space, in the Unicode sense."""
    return F.regexp_extract_all(c, F.lit(r"(?U)(\S+)"), 1)


def tokenize(c: Column, level: str = "plain") -> Column:
    if known_level(level) in ("raw", "nfc"):
        raise ValueError(f"no word boundaries at level {level!r}: tokenize at 'plain' or beyond")
    return tokens(normalize(c, level))


def unclassified(c: Column) -> Column:
    """The characters that no class holds."""
    return F.translate(c, CLASSIFIED, "")


# The same rungs for a query's own words ----------------------------------------------


def text_at(text: str, level: str) -> str:
    """A plain string at a rung; equal to the Column form."""
    return [text, *_climb(text, LEVELS[1 : LEVELS.index(known_level(level)) + 1])][-1]


def all_levels(text: str) -> dict[str, str]:
    return dict(zip(LEVELS, [text, *_climb(text, LEVELS[1:])], strict=True))


def tokenize_text(text: str, level: str = "plain") -> list[str]:
    if known_level(level) in ("raw", "nfc"):
        raise ValueError(f"no word boundaries at level {level!r}: tokenize at 'plain' or beyond")
    return text_at(text, level).split()


def classified(char: str) -> bool:
    return char in CLASSIFIED
