"""Record keys, timestamps as text, spans as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_timestamp(ts: Column) -> Column:
    """ISO text with microseconds, which are left out when they are zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, ".SSSSSS")
    return F.when(micros == ".000000", whole).otherwise(F.concat(whole, micros))


def iso_date(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def entry_key(date: Column, created_at: Column, separator: str = "_") -> Column:
    return F.concat(iso_date(date), F.lit(separator), iso_timestamp(created_at))


def expression_key(
    entry: Column, expression: Column, created_at: Column, occurrence: Column | None = None
) -> Column:
    """Hash key of an expression. A repeat within the entry adds its occurrence number,
    so that it does not collide with the first one."""
    text = F.concat_ws("_", entry, expression, iso_timestamp(created_at))
    if occurrence is not None:
        text = F.concat(text, F.when(occurrence > 1, F.concat(F.lit("_"), occurrence)).otherwise(F.lit("")))
    return F.sha2(text, 256)


def history_key(entry: Column, version_to: Column) -> Column:
    """A repeatable key for a version record: a retried task writes the same one."""
    return F.sha2(F.concat_ws("_", entry, version_to), 256)


def span_from_text(text: Column) -> Column:
    """``[start, end]`` text to a span struct; null when it is not two whole numbers."""
    pair = F.from_json(text, "array<int>")
    whole = (F.size(pair) == 2) & ~F.exists(pair, lambda n: n.isNull())
    return F.when(
        whole,
        F.struct(F.try_element_at(pair, F.lit(1)).alias("start"), F.try_element_at(pair, F.lit(2)).alias("end")),
    )


def span_to_text(span: Column) -> Column:
    return F.concat(F.lit("["), span["start"], F.lit(", "), span["end"], F.lit("]"))


def by_hand() -> Column:
    """The span of an expression that was added by hand."""
    return F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"))


def error_text(category: Column, rule: Column, phrase: Column, correction: Column) -> Column:
    """The text of an error record that gets embedded."""
    return F.concat(
        category, F.lit(" Error: "), rule, F.lit(". Example: '"), phrase, F.lit("' -> '"), correction, F.lit("'")
    )
