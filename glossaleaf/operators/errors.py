"""Grammar errors: from responses to validated records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaleaf.functions import responses
from glossaleaf.functions.rows import explode_rows
from glossaleaf.languages import Languages
from glossaleaf.schemas import ERROR_CATEGORIES

RECORD = [
    "primary_id_DiaryEntry", "model_id_embedding", "language_diary_text", "language_annotation_text",
    "error_rule", "example_phrase", "correction", "category",
]


def error_rows(df: DataFrame, skip_first: bool = True) -> DataFrame:
    """One row per error block of ``response``; ``error_no`` counts from 1 per response."""
    others = [c for c in df.columns if c != "response"]
    blocks = responses.error_blocks(F.col("response"), skip_first)
    return explode_rows(df, others, blocks, "_pos", "_error").select(*others, (F.col("_pos") + 1).alias("error_no"), "_error.*")


def with_validity(errors: DataFrame, languages: Languages) -> DataFrame:
    """Adds ``reject_reason``: null for a record that may be stored."""
    flagged = languages.flag(errors, "language_annotation_text", "_annotation_ok")
    flagged = languages.flag(flagged, "language_diary_text", "_diary_ok")
    reason = (
        F.when(~F.coalesce(F.col("category").isin(ERROR_CATEGORIES), F.lit(False)), F.lit("category"))
        .when(~F.col("_annotation_ok"), F.lit("language_annotation"))
        .when(~F.col("_diary_ok"), F.lit("language_diary"))
    )
    return flagged.withColumn("reject_reason", reason).drop("_annotation_ok", "_diary_ok")


def valid(checked: DataFrame) -> DataFrame:
    return checked.filter("reject_reason is null").drop("reject_reason")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter("reject_reason is not null")


def without_noops(errors: DataFrame) -> DataFrame:
    """Drops corrections that repeat the phrase."""
    return errors.filter("example_phrase <> correction")
