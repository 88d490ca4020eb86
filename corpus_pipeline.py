"""Documents to training tokens: quality rules, exact dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before has kept, and
gives a DataFrame that is written as Parquet and read again for the next. All but the last
keep the columns of ``documents``; the last gives doc_id, lang, source, ids, n_tokens and the
digests of ids and decoded text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaleaf.llm import bpe, exact_dedup, mixing, quality, simhash
from glossaleaf.llm.common import table
from glossaleaf.llm.queries import PATTERN, RANKS
from glossaleaf.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or read unlike the trusted ones go."""
    return quality.kept_rows(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.kept_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near fingerprints the one with the smallest doc_id stays."""
    return simhash.kept_rows(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes; a document taken twice comes twice."""
    mixed = mixing.mixed_rows(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else mixed


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, RANKS, PATTERN, keep=[c for c in ("lang", "source") if c in docs.columns]).drop("decoded")


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("exact dedup", exact),
    ("simhash near-dedup", near),
    ("source mixing", mix),
    ("byte-level bpe", encode),
]

# SQL has neither the stages' hashes nor the merges; tests hold run() against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
