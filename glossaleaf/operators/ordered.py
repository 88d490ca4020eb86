"""Row number and previous value per key, when one key may hold a large share of all rows.

A window over a key puts that key's rows into one task. The rows are therefore
range-partitioned on (key, order), so a large key spreads over many partitions; each partition
numbers its own rows and only one summary row per (partition, key) is needed to join the
parts up. ``spread=False`` asks for the plain window, for keys known to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossaleaf.session import materialize


def with_previous(
    df: DataFrame,
    key: str,
    order: list[str],
    number: str,
    previous: dict[str, str] | None = None,
    spread: bool = True,
    total: str | None = None,
    changes: dict[str, str] | None = None,
) -> DataFrame:
    """Adds ``number`` (1, 2, ... per key in order), for each ``{column: name}`` in
    ``previous`` the column's value in the row before, under the name ``total`` the
    key's row count, and for each ``{column: name}`` in ``changes``, whose column must be in
    ``previous``, how often its value has changed up to the row. A step from or to null is no
    change. ``order`` must be unique per key."""
    previous, changes = previous or {}, changes or {}
    if spread:
        return _with_previous_spread(df, key, order, number, previous, total, changes)
    window = Window.partitionBy(key).orderBy(*order)
    out = {number: F.row_number().over(window)}
    out |= {name: F.lag(column).over(window) for column, name in previous.items()}
    if total:
        out[total] = F.count("*").over(Window.partitionBy(key))
    added = df.withColumns(out)
    steps = {name: F.sum(_changed(previous[column], column)).over(window).cast("int") for column, name in changes.items()}
    return added.withColumns(steps) if steps else added


def _changed(before: str, now: str) -> Column:
    return F.coalesce(F.col(before) != F.col(now), F.lit(False)).cast("int")


def ranged(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    return df.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id())


def _with_previous_spread(
    df: DataFrame, key: str, order: list[str], number: str, previous: dict[str, str], total: str | None,
    changes: dict[str, str],
) -> DataFrame:
    # written once: the part a row belongs to must not change if a task runs again
    rows = materialize(ranged(df, key, order), "ordered")

    local = Window.partitionBy(key, "_part").orderBy(*order)
    numbered = rows.withColumns(
        {"_local": F.row_number().over(local)}
        | {f"_lag_{name}": F.lag(column).over(local) for column, name in previous.items()}
    )
    if changes:
        # a part's first row has no lag here; the summary counts the step into it
        steps = {f"_step_{name}": _changed(f"_lag_{previous[column]}", column) for column, name in changes.items()}
        numbered = numbered.withColumns(steps)
    position: Column = F.struct(*order)
    summary = (numbered if changes else rows).groupBy(key, "_part").agg(
        F.count("*").alias("_rows"),
        *[F.max_by(column, position).alias(f"_last_{name}") for column, name in previous.items()],
        *[F.min_by(column, position).alias(f"_first_{name}") for column, name in changes.items()],
        *[F.sum(f"_step_{name}").alias(f"_steps_{name}") for name in changes.values()],
    )
    # one row per part of a key: as many as there are partitions, not rows
    parts = Window.partitionBy(key).orderBy("_part")
    before = F.sum("_rows").over(parts.rowsBetween(Window.unboundedPreceding, -1))
    joins = summary.select(
        key,
        "_part",
        F.coalesce(before, F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy(key)).alias("_total"),
        *[F.lag(f"_last_{name}").over(parts).alias(f"_carry_{name}") for name in previous.values()],
        *[f"_{part}_{name}" for name in changes.values() for part in ("first", "steps")],
    )
    for column, name in changes.items():
        # the step into a part's first row counts from that row on
        into = _changed(f"_carry_{previous[column]}", f"_first_{name}")
        joins = joins.withColumn(f"_into_{name}", into)
        earlier = F.sum(F.col(f"_steps_{name}") + F.col(f"_into_{name}")).over(parts.rowsBetween(Window.unboundedPreceding, -1))
        joins = joins.withColumn(f"_base_{name}", F.coalesce(earlier, F.lit(0)) + F.col(f"_into_{name}"))
        joins = joins.drop(f"_first_{name}", f"_steps_{name}", f"_into_{name}")
    if changes:
        numbered = numbered.withColumns({f"_done_{name}": F.sum(f"_step_{name}").over(local) for name in changes.values()})
    joined = numbered.join(joins, [key, "_part"])
    return joined.select(
        *[joined[column] for column in df.columns],
        (F.col("_local") + F.col("_before")).cast("int").alias(number),
        *[
            F.when(F.col("_local") == 1, F.col(f"_carry_{name}"))
            .otherwise(F.col(f"_lag_{name}"))
            .alias(name)
            for name in previous.values()
        ],
        *([F.col("_total").alias(total)] if total else []),
        *[(F.col(f"_done_{name}") + F.col(f"_base_{name}")).cast("int").alias(name) for name in changes.values()],
    )
