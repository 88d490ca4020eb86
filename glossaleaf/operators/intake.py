"""Submissions: validation, keys, settings, budgets, language codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaleaf.functions import keys, prompts, text
from glossaleaf.languages import Languages
from glossaleaf.schemas import CEFR_LEVELS, TASKS

ALWAYS_RUN = ["translator", "archivist"]
# Fixed value: what a submission without a draft is told.
EMPTY_DRAFT = "Please enter some text."


def checked(submissions: DataFrame, languages: Languages) -> DataFrame:
    """Adds ``reject_reason``, null for a submission that may run.

    All five fields must be there (a blank language or title is fine, a missing one is
    not), the draft must not be empty, the level must be a CEFR level, and language codes
    must be known when both are given. A blank code asks for detection.
    """
    given = (F.col("lang_diary_body") != "") & (F.col("lang_annotation") != "")
    fields = ["draft_text", "lang_diary_body", "lang_annotation", "level_rewriting", "title_diary"]
    missing = F.lit(False)
    for name in fields:
        missing = missing | F.col(name).isNull()
    flagged = languages.flag(submissions, text.strip(F.col("lang_diary_body")), "_body_ok")
    flagged = languages.flag(flagged, text.strip(F.col("lang_annotation")), "_annotation_ok")
    reason = (
        F.when(missing, F.lit("missing field"))
        .when(F.col("draft_text") == "", F.lit(EMPTY_DRAFT))
        .when(~F.col("level_rewriting").isin(CEFR_LEVELS), F.lit("invalid level"))
        .when(given & ~(F.col("_body_ok") & F.col("_annotation_ok")), F.lit("unknown language"))
    )
    return flagged.withColumn("reject_reason", reason).drop("_body_ok", "_annotation_ok")


def valid(checked_rows: DataFrame) -> DataFrame:
    return checked_rows.filter("reject_reason is null").drop("reject_reason")


def rejected(checked_rows: DataFrame) -> DataFrame:
    return checked_rows.filter("reject_reason is not null")


def jobs(rejected_rows: DataFrame) -> DataFrame:
    """Rejected submissions that were jobs: one without a draft never became any."""
    return rejected_rows.filter(F.col("reject_reason") != EMPTY_DRAFT)


def failure_status(keyed_rejected: DataFrame) -> DataFrame:
    """The status record in which a rejected job ends."""
    return jobs(keyed_rejected).select(
        "job_id",
        F.col("primary_id").alias("diary_id"),
        F.col("submitted_at").alias("ts"),
        F.lit("error").alias("status"),
        F.col("reject_reason").alias("message"),
    )


def with_codes(submissions: DataFrame) -> DataFrame:
    """Trimmed codes; null where detection has to decide (either one blank)."""
    given = (F.col("lang_diary_body") != "") & (F.col("lang_annotation") != "")
    return submissions.withColumns(
        {
            "language_source": F.when(given, text.strip(F.col("lang_diary_body"))),
            "language_annotation": F.when(given, text.strip(F.col("lang_annotation"))),
        }
    )


def with_keys(submissions: DataFrame, separator: str = "_") -> DataFrame:
    """Adds created_at, date_diary and primary_id; title never null.

    A submitted date_diary or primary_id stays; what is missing follows from the
    submission time.
    """

    def given_or(name: str, made: Column) -> Column:
        return F.coalesce(name, made) if name in submissions.columns else made

    day = given_or("date_diary", F.to_date("submitted_at"))
    return submissions.withColumns(
        {
            "created_at": F.col("submitted_at"),
            "date_diary": day,
            "primary_id": given_or("primary_id", keys.entry_key(day, F.col("submitted_at"), separator)),
            "title_diary": F.coalesce("title_diary", F.lit("")),
        }
    )


def initial_status(keyed: DataFrame) -> DataFrame:
    """The status record a job starts with."""
    return keyed.select(
        "job_id",
        F.col("primary_id").alias("diary_id"),
        F.col("submitted_at").alias("ts"),
        F.lit("processing").alias("status"),
        F.lit("").alias("message"),
    )


def with_settings(submissions: DataFrame, draft: str = "draft_text") -> DataFrame:
    """Adds one settings struct per task. Flags come from optional columns such as
    ``rewriter_is_execute``; the token budget follows from the draft."""
    have = set(submissions.columns)

    def given(name: str):
        return F.col(name) if name in have else None

    out = {}
    for task in TASKS:
        thinking = prompts.with_default(given(f"{task}_enable_thinking"), False)
        out[f"config_{task}"] = prompts.task_settings(
            given(f"{task}_is_execute"), prompts.token_budget(F.col(draft), thinking), thinking, task in ALWAYS_RUN
        )
    return submissions.withColumns(out)


def gate(success: Column, is_execute: Column, value: Column) -> Column:
    """A later step's text: empty unless translation went well and the step is on."""
    return F.when(success & is_execute, value).otherwise(F.lit(""))


def entry_rows(
    submissions: DataFrame, model_id: str, replaced: Column | None = None, rewritten: Column | None = None
) -> DataFrame:
    """Diary entries; without result texts, as they are first stored, before any model ran."""
    unknown = F.lit("Unknown")
    return submissions.select(
        "primary_id",
        "created_at",
        "date_diary",
        F.coalesce("language_source", unknown).alias("language_source"),
        F.coalesce("language_annotation", unknown).alias("language_annotation"),
        F.col("draft_text").alias("diary_original"),
        (F.lit("") if replaced is None else replaced).alias("diary_replaced"),
        (F.lit("") if rewritten is None else rewritten).alias("diary_rewritten"),
        "level_rewriting",
        F.lit(model_id).alias("model_id_tutor"),
        "title_diary",
        F.lit(0).alias("current_version"),
        F.lit(True).alias("is_show"),
    )
