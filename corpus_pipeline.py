"""The document pipeline: quality rules, near-duplicates, secrets, mixing, packing.

Each stage takes any table with the columns of documents (doc_id, text, lang,
source, n_chars), of any order and with others besides, whose names may be
anything. An empty table gives an empty one. Texts of any length are taken
whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataglyph.llm import mixing, neardup, packing, quality, secrets
from strataglyph.llm.workspace import Workspace, scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null and empty texts among them, rows that repeat alike. Null lang and source are groups like others."""
    return quality.keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of least doc_id; of rows that repeat it, one. Rows without doc_id count; texts without words all stay."""
    return neardup.keep_first(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts, and n_chars follows; no document goes. Null texts stay null."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources have their target weights; rows that share source and doc_id alike. A null source is a source."""
    return mixing.mix(docs, mixing.TARGETS, weight_of_others=mixing.OTHERS, names=None)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences; null and empty texts are one piece of the end id, and rows that repeat are packed again."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("secret_scans", secret_stage),
    ("poisson_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

ORACLE_SQL = None  # the stages' statistics, forests and token ids are beyond SQL; tests hold run() against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written as Parquet and read again by the next, and what it wrote besides is deleted."""
    space = Workspace(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark):
            docs = space.save(stage(spark, docs, sf_dir), name)
        if before:
            space.drop(before)
        before = name
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
