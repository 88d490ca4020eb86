"""Keyed tables: append with key check, updates, deletes.

Parquet has no row-level changes, so every operator returns the new snapshot as a
DataFrame; write it to a new folder, never over the one it was read from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossaleaf.session import materialize


def latest_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key; combines before the shuffle."""
    others = [c for c in df.columns if c != key]
    return (
        df.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_row")).select(key, "_row.*")
    )


def append_new(new: DataFrame, existing: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused): a row is refused if its key is stored already, came earlier in
    ``new``, or is null. A null in an ``order`` column comes before all values. Of rows with one key
    and equal ``order`` the one whose other columns hash lowest counts as the earlier, so one row of
    a key is accepted at most.

    Only keys, order columns and that hash are compared. The rows themselves are then
    matched on all of them, which spreads the rows of a hot key. The outcome is written
    once and read by both results.
    """
    rest = [c for c in new.columns if c != key and c not in order]
    tie = F.xxhash64(*rest) if rest else F.lit(0).cast("long")
    place = [*order, "_tie"]
    rows = new.withColumn("_tie", tie)
    first = rows.groupBy(key).agg(F.min(F.struct(*place)).alias("_first")).select(key, "_first.*")
    free = first.join(existing.select(key), key, "left_anti")
    names = [key, *place]
    winners = free.select(*[F.col(c).alias(f"_w{i}") for i, c in enumerate(names)], F.lit(True).alias("_won"))
    # rows alike in every column are told apart by number
    alike = Window.partitionBy(key, *place).orderBy(F.lit(1))
    numbered = rows.withColumn("_nth", F.row_number().over(alike))
    # equal or both null, but for the key
    same = [F.col(c).eqNullSafe(F.col(f"_w{i}")) if i else F.col(c) == F.col("_w0") for i, c in enumerate(names)]
    matched = numbered.join(winners, same, "left").select(*new.columns, "_nth", "_won")
    outcome = materialize(matched, "append-outcome")
    is_new = F.coalesce(F.col("_won") & (F.col("_nth") == 1), F.lit(False))
    return outcome.filter(is_new).select(*new.columns), outcome.filter(~is_new).select(*new.columns)


def apply_updates(base: DataFrame, changes: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """``base`` with ``columns`` set to the latest non-null value given for a key.

    Changes are reduced to one row per key before they meet the table.
    """
    position: Column = F.struct(*order)
    latest = changes.groupBy(F.col(key).alias("_key")).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), position)).alias(f"_new_{c}") for c in columns]
    )
    joined = base.join(latest, base[key] == latest["_key"], "left")
    return joined.select(
        *[
            F.coalesce(F.col(f"_new_{c}"), base[c]).alias(c) if c in columns else base[c]
            for c in base.columns
        ]
    )


def soft_delete(entries: DataFrame, hidden: DataFrame, key: str = "primary_id") -> DataFrame:
    """Marks the entries named in ``hidden`` as not shown."""
    marks = hidden.select(F.col(key).alias("_key")).distinct()
    joined = entries.join(marks, entries[key] == marks["_key"], "left")
    shown = F.col("is_show") & F.col("_key").isNull()
    return joined.withColumn("is_show", shown).drop("_key")


def delete_rows(table: DataFrame, removed: DataFrame, key: str = "primary_id") -> DataFrame:
    return table.join(removed.select(key).distinct(), key, "left_anti").select(*table.columns)


def repeated_keys(table: DataFrame, key: str) -> DataFrame:
    """Keys that break the one-row-per-key rule, with their row count."""
    return table.groupBy(key).agg(F.count("*").alias("n")).filter("n <> 1")
