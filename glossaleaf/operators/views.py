"""Read views over the diary store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaleaf.functions import keys
from glossaleaf.operators import store

# What the list shows for a job state.
STATUS_MARKS = {"completed": "✅", "error": "❌", "processing": "⏳"}
NO_STATUS = "❓"


def entries(
    table: DataFrame,
    language_source: str | None = None,
    language_annotation: str | None = None,
    primary_id: str | None = None,
    visible_only: bool = True,
) -> DataFrame:
    """Entries that meet every given condition; each one reaches the scan."""
    wanted = {
        "language_source": language_source,
        "language_annotation": language_annotation,
        "primary_id": primary_id,
        "is_show": True if visible_only else None,
    }
    conditions = [F.col(name) == value for name, value in wanted.items() if value is not None]
    return table.filter(reduce(lambda a, b: a & b, conditions)) if conditions else table


def as_records(table: DataFrame) -> DataFrame:
    """Entries as the record form shows them: date as ISO text, no null version."""
    return table.withColumns(
        {
            "date_diary": keys.iso_date(F.col("date_diary")),
            "current_version": F.coalesce("current_version", F.lit(0)),
        }
    )


def expressions(table: DataFrame, entry_id: str | None = None) -> DataFrame:
    return table if entry_id is None else table.filter(F.col("primary_id_DiaryEntry") == entry_id)


def vocabulary(table: DataFrame) -> DataFrame:
    """All expressions of all entries, hidden entries too."""
    return table.select("language_annotation", "expression", "expression_translation", "language_source")


def errors_of(errors: DataFrame, entry_ids: list[str] | DataFrame) -> DataFrame:
    """Errors of the given entries: a short list filters, a table joins."""
    if isinstance(entry_ids, list):
        return errors.filter(F.col("primary_id_DiaryEntry").isin(entry_ids))
    wanted = entry_ids.select(F.col("primary_id").alias("_id")).distinct()
    return errors.join(wanted, errors["primary_id_DiaryEntry"] == wanted["_id"], "left_semi")


def errors_by_language(errors: DataFrame, selected: list[str] | None = None) -> DataFrame:
    return errors if selected is None else errors.filter(F.col("language_diary_text").isin(selected))


def error_languages(errors: DataFrame) -> DataFrame:
    return errors.select("language_diary_text").distinct()


def entries_with_errors(
    table: DataFrame,
    errors: DataFrame,
    language_source: str | None = None,
    language_annotation: str | None = None,
) -> DataFrame:
    """Visible entries joined with their errors, one row per error.

    The errors are the streamed side; an entry with very many errors is split by the
    adaptive skew join.
    """
    shown = as_records(entries(table, language_source, language_annotation))
    return errors.withColumnRenamed("primary_id_DiaryEntry", "primary_id").join(shown, "primary_id")


def current_status(events: DataFrame, job: str = "job_id", order: list[str] | None = None) -> DataFrame:
    """The latest status record of each job."""
    return store.latest_per_key(events, job, order or ["ts"])


def status_mark(status) -> F.Column:
    marks = F.create_map(*[F.lit(x) for pair in STATUS_MARKS.items() for x in pair])
    return F.coalesce(F.try_element_at(marks, status), F.lit(NO_STATUS))


def diary_list(table: DataFrame, events: DataFrame) -> DataFrame:
    """The list page: visible entries with the mark of their job.

    An entry counts by the job that was submitted first for it, in that job's current state.
    """
    jobs = events.groupBy("diary_id", "job_id").agg(
        F.min("ts").alias("_first"), F.max_by("status", "ts").alias("status")
    )
    per_entry = jobs.groupBy(F.col("diary_id").alias("_id")).agg(
        F.min_by("status", F.struct("_first", "job_id")).alias("status")
    )
    shown = entries(table)
    return shown.join(per_entry, shown["primary_id"] == per_entry["_id"], "left").select(
        status_mark(F.col("status")).alias("status"),
        "primary_id",
        keys.iso_date(F.col("date_diary")).alias("date_diary"),
        "created_at",
        "title_diary",
        "language_source",
        "language_annotation",
    )


def diary_detail(table: DataFrame, expression_table: DataFrame, errors: DataFrame) -> DataFrame:
    """The detail page for all visible entries, as rows: the entry itself, then one row per
    expression and one per error, each with all its columns. ``kind`` says which; an
    expression's own key is ``item_id``, and columns that a kind does not have are null.

    Rows and not nested lists, so that an entry with any number of expressions stays
    spread over tasks; each item table is only checked for existence of its entry.
    """
    shown = entries(table)
    ids = shown.select(F.col("primary_id").alias("_id"))

    def of_shown(items: DataFrame) -> DataFrame:
        return items.join(ids, items["primary_id_DiaryEntry"] == ids["_id"], "left_semi")

    def rows(items: DataFrame, kind: str, entry: str, **renamed: str) -> DataFrame:
        """All columns of the items; those of other kinds are added as null by the union."""
        named = items.withColumnsRenamed({old: new for old, new in renamed.items()})
        return named.withColumnsRenamed({entry: "primary_id"}).withColumn("kind", F.lit(kind))

    return (
        rows(as_records(shown), "entry", "primary_id")
        .unionByName(rows(of_shown(expression_table), "expression", "primary_id_DiaryEntry", primary_id="item_id"), True)
        .unionByName(rows(of_shown(errors), "error", "primary_id_DiaryEntry"), True)
    )
