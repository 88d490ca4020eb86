"""What the operators share: tables, words and row keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: what counts as white space between words, and as a word
WHITE = "\x20\t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. The plain ``lower`` does the same to a text of ASCII alone."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )


def words_of(text: Column) -> Column:
    """The words of a text as an array; empty if there is none."""
    trimmed = F.trim(text, F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def packed(docs: DataFrame) -> Column:
    """The whole row as one column, so that names made on the way cannot clash with its own."""
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns])


def id_key(doc_id: str = "doc_id") -> Column:
    """The id as a text, null as empty: a key that joins, windows and shuffles treat alike."""
    return F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
