"""Turning array columns into rows without computing the array twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, keep: list[str | Column], items: str | Column, position: str, item: str) -> DataFrame:
    """One row per array item, with its position from 0; rows without items go.

    An inner explode makes the optimizer add ``size(items) > 0`` as a filter and push it
    below the projections that build the array, with all their expressions written into
    it. The outer form with a filter on the position has the same rows and no such copy.
    """
    exploded = df.select(*keep, F.posexplode_outer(items).alias(position, item))
    return exploded.filter(F.col(position).isNotNull())


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later filters cannot be pushed through.

    A pushed filter is computed from scratch below the projections it passes. For cheap
    columns that is what one wants; for columns that cost a pass over a text it is not.
    """
    made = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*[c for c in df.columns if c not in columns], F.inline_outer(F.array(made)))
