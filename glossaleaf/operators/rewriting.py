"""Rewriting attempts: status of each and the one that counts per entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaleaf.functions import responses
from glossaleaf.operators import langid

MAX_TRIES = 5


def with_detected_language(
    attempts: DataFrame, entry: str, profile: langid.Profile, max_tries: int = MAX_TRIES
) -> DataFrame:
    """Adds detected_language of each attempt's rewritten text; null without one.

    ``entry`` and ``attempt`` together must be unique. Attempts past the last try are not looked
    at; ``max_tries`` must be that of ``chosen_attempts``.
    """
    texts = attempts.select(entry, "attempt", responses.last_rewriting(F.col("response")).alias("_text"))
    looked_at = texts.filter(F.col("attempt") <= max_tries)
    found = langid.detect(looked_at, [entry, "attempt"], "_text", profile)
    return attempts.join(found, [entry, "attempt"], "left")


def classify_attempts(attempts: DataFrame) -> DataFrame:
    """Needs response, finish_reason, detected_language, language_source."""
    return attempts.withColumn(
        "status",
        responses.rewrite_status(
            F.col("response"), F.col("finish_reason"), F.col("detected_language"), F.col("language_source")
        ),
    ).withColumn("rewriting", responses.rewriting_text(F.col("response"), F.col("status")))


def chosen_attempts(classified: DataFrame, entry: str, max_tries: int = MAX_TRIES) -> DataFrame:
    """Per entry the first accepted attempt, else the last one made, within the tries.

    One aggregate with map-side combining, so a key with very many attempts is no problem.
    """
    stops = F.col("status").isin("success", "insufficient_length")
    # accepted attempts sort before all others, by number; the others by number downwards
    rank = F.when(stops, F.col("attempt") - max_tries - 1).otherwise(-F.col("attempt") + max_tries)
    return (
        classified.filter(F.col("attempt") <= max_tries)
        .groupBy(entry)
        .agg(F.min_by(F.struct("attempt", "status", "rewriting"), rank).alias("_best"))
        .select(entry, "_best.*")
    )
