"""The claim ledger: recorded queries with their expected answers, run again at will."""

from __future__ import annotations

import tomllib
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from .sql import read_only

REQUIRED = ("id", "statement", "query", "expect")


class ClaimError(ValueError):
    """A ledger that can't be read."""


@dataclass(frozen=True)
class Claim:
    id: str
    statement: str
    query: str
    expect: Any
    level: str = "n/a"
    author: str = "unattributed"
    date: str | None = None
    note: str | None = None


@dataclass(frozen=True)
class Result:
    claim: Claim
    ok: bool
    actual: Any
    error: str | None = None


def from_dicts(entries: Iterable[dict]) -> list[Claim]:
    out = []
    for entry in entries:
        if missing := [k for k in REQUIRED if k not in entry]:
            raise ClaimError(f"claim {entry.get('id', '?')}: missing {', '.join(missing)}")
        known = {k: entry[k] for k in Claim.__dataclass_fields__ if entry.get(k) is not None}
        out.append(Claim(**known))
    if twice := [i for i, n in Counter(c.id for c in out).items() if n > 1]:
        raise ClaimError(f"claims recorded twice: {', '.join(twice)}")
    return out


def load(folder: str) -> list[Claim]:
    return from_dicts(tomllib.loads(p.read_text("utf-8"))["claim"] for p in sorted(Path(folder).glob("*.toml")))


def shaped(rows: list) -> Any:
    """No row: []; one cell: itself; one row or one column: a flat list; else a list of lists."""
    cells = [list(r) for r in rows]
    if not cells:
        return []
    if len(cells) == 1:
        return cells[0][0] if len(cells[0]) == 1 else cells[0]
    return [r[0] for r in cells] if len(cells[0]) == 1 else cells


def check(spark: SparkSession, claim: Claim) -> Result:
    try:
        # as many rows as were expected, and one more to tell that there are more
        most = max(1, len(claim.expect)) if isinstance(claim.expect, list) else 1
        actual = shaped(read_only(spark, claim.query).limit(most + 1).collect())
    except (PySparkException, ValueError) as error:
        return Result(claim, False, None, str(error).splitlines()[0])
    return Result(claim, actual == claim.expect, actual)


def run(spark: SparkSession, claims: Iterable[Claim]) -> list[Result]:
    return [check(spark, c) for c in claims]


def as_table(spark: SparkSession, results: list[Result]) -> DataFrame:
    import json

    rows = [(r.claim.id, r.claim.statement, r.ok, json.dumps(r.claim.expect, ensure_ascii=False, default=str), json.dumps(r.actual, ensure_ascii=False, default=str), r.error) for r in results]
    return spark.createDataFrame(rows, "id string, statement string, ok boolean, expected string, actual string, error string")
