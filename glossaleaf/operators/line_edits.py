"""Line edits with positions: which lines of an old text went, which lines of a new one came, and where.

Lines that occur once in both texts of a pair are candidates for anchors; the longest chain of
them that rises in both texts holds (a longest increasing subsequence). Between two anchors
equal lines are matched from the front, then from the back. What is left is deleted or
inserted. The edits of a pair turn its old text into its new one (:func:`replay`).

Lines are rows, so anchors, gaps and matches are aggregates and windows within a pair. Only
the chain is found in Python, over the positions of a pair's anchors.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossaleaf.functions.rows import explode_rows


def _longest_rise(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence, in order."""
    tails, places, before = [], [], []
    for place, value in enumerate(values):
        k = bisect_left(tails, value)
        before.append(places[k - 1] if k else -1)
        tails[k: k + 1] = [value]
        places[k: k + 1] = [place]
    chain, place = [], places[-1] if places else -1
    while place >= 0:
        chain.append(place)
        place = before[place]
    return chain[::-1]


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def rising(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Places in each array of its longest strictly increasing subsequence."""
    for batch in batches:
        yield pd.Series([_longest_rise(list(values)) for values in batch], dtype=object)


def _lines(pairs: DataFrame, keys: list[str], old: str, new: str) -> DataFrame:
    """(keys..., _new, _at, _line) for each line of both texts; a null text has no lines."""
    sides = F.array(
        F.struct(F.lit(False).alias("_new"), F.split(old, "\n").alias("_lines")),
        F.struct(F.lit(True).alias("_new"), F.split(new, "\n").alias("_lines")),
    )
    return explode_rows(pairs.select(*keys, F.inline(sides)), [*keys, "_new"], "_lines", "_at", "_line")


def _anchors(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., _new, _at) of the chain's lines, on both sides."""
    # which lines are equal is told by 32 bytes at most: short lines stand for themselves
    digest = F.unhex(F.sha2("_line", 256))
    named = F.when(F.octet_length("_line") < 32, F.col("_line").cast("binary")).otherwise(digest)
    counts = lines.groupBy(*keys, named.alias("_name")).agg(
        F.count_if("_new").alias("_n_new"),
        F.count_if(~F.col("_new")).alias("_n_old"),
        F.max(F.when(~F.col("_new"), F.col("_at"))).alias("_old_at"),
        F.max(F.when(F.col("_new"), F.col("_at"))).alias("_new_at"),
    )
    once = counts.filter("_n_new = 1 and _n_old = 1").groupBy(*keys)
    spots = once.agg(F.sort_array(F.collect_list(F.struct("_old_at", "_new_at"))).alias("_spots"))
    chains = spots.withColumn("_places", rising(F.col("_spots._new_at")))
    held = chains.select(*keys, F.explode(F.transform("_places", lambda i: F.get("_spots", i))).alias("_spot"))
    sides = F.array(
        F.struct(F.lit(False).alias("_new"), F.col("_spot._old_at").alias("_at")),
        F.struct(F.lit(True).alias("_new"), F.col("_spot._new_at").alias("_at")),
    )
    return held.select(*keys, F.inline(sides))


def _unmatched(left: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """``left`` without the lines that a gap's two sides share from its start, in ``order``."""
    side = Window.partitionBy(*keys, "_gap", "_new").orderBy(order)
    step = Window.partitionBy(*keys, "_gap", "_step")
    ranked = left.withColumn("_step", F.row_number().over(side))
    # a step with one side only, or two different lines, ends the common run
    same = (F.count("*").over(step) == 2) & F.min("_line").over(step).eqNullSafe(F.max("_line").over(step))
    run = Window.partitionBy(*keys, "_gap").orderBy("_step").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    marked = ranked.withColumn("_same", same.cast("int")).withColumn("_run", F.min("_same").over(run))
    return marked.filter("_run = 0").select(*left.columns)


def line_edits(pairs: DataFrame, keys: list[str], old: str = "old_text", new: str = "new_text") -> DataFrame:
    """(keys..., op, at, line): ``delete`` with the line's place in the old text, ``insert`` with
    its place in the new one, both from 0.

    ``keys`` name a pair and must be unique. Lines end at ``\\n``, an empty text is one empty line,
    a null text has no lines. Equal texts give no row. One pair's lines may meet in one task, as its
    texts already lie in one row; an entry with many pairs is spread. ``pairs`` is read twice.
    """
    lines = _lines(pairs, keys, old, new)
    anchors = _anchors(lines, keys).withColumn("_held", F.lit(True))
    # lines and anchors by pair in one shuffle: every window below lies within a pair
    both = lines.withColumn("_held", F.lit(None).cast("boolean")).unionByName(anchors, True).repartition(*keys)
    held = F.max("_held").over(Window.partitionBy(*keys, "_new", "_at"))
    placed = both.withColumn("_held", held).filter("_line is not null")
    before = Window.partitionBy(*keys, "_new").orderBy("_at")
    gaps = placed.withColumn("_gap", F.count("_held").over(before)).filter("_held is null").drop("_held")
    rest = _unmatched(_unmatched(gaps, keys, F.col("_at").asc()), keys, F.col("_at").desc())
    op = F.when(F.col("_new"), "insert").otherwise("delete")
    return rest.select(*keys, op.alias("op"), F.col("_at").alias("at"), F.col("_line").alias("line"))


def payloads(edits: DataFrame, keys: list[str], field: str) -> DataFrame:
    """(keys..., changes): one JSON per pair, ``{field: [{op, at, line}, ...]}``, deletions first."""
    ordered = F.sort_array(F.collect_list(F.struct("op", "at", "line")))
    return edits.groupBy(*keys).agg(F.to_json(F.create_map(F.lit(field), ordered)).alias("changes"))


def from_payloads(records: DataFrame, keys: list[str], field: str, changes: str = "changes") -> DataFrame:
    """The edits that :func:`payloads` wrote."""
    parsed = F.from_json(changes, "map<string, array<struct<op: string, at: int, line: string>>>")
    return records.select(*keys, F.inline(parsed[field]))


def replay(pairs: DataFrame, edits: DataFrame, keys: list[str], old: str = "old_text", text: str = "text") -> DataFrame:
    """(keys..., text): each pair's old text with its edits made; pairs without edits keep theirs.

    An insert at place p that is the j-th of its pair has p - j kept lines before it, so
    kept and inserted lines merge by one sort.
    """
    lines = explode_rows(pairs.select(*keys, F.split(old, "\n").alias("_lines")), keys, "_lines", "at", "_line")
    gone, is_insert = F.col("op") == "delete", F.col("op") == "insert"
    lines = lines.select(*keys, "at", "_line", F.lit(1).alias("_kind"), F.lit(False).alias("_gone"))
    steps = edits.filter(gone | is_insert).select(
        *keys, "at", F.when(is_insert, F.col("line")).alias("_line"), F.when(gone, 1).otherwise(0).alias("_kind"), gone.alias("_gone")
    )
    # lines and edits by pair in one shuffle
    both = lines.unionByName(steps).repartition(*keys)
    all_gone = F.max("_gone").over(Window.partitionBy(*keys, "_kind", "at"))
    left = both.withColumn("_gone", all_gone).filter(~F.col("_gone"))
    nth = F.row_number().over(Window.partitionBy(*keys, "_kind").orderBy("at")) - 1
    ranked = left.withColumn("_rank", F.when(F.col("_kind") == 1, nth).otherwise(F.col("at") - nth))
    merged = F.sort_array(F.collect_list(F.struct("_rank", "_kind", "at", "_line")))
    made = ranked.groupBy(*keys).agg(F.array_join(merged["_line"], "\n").alias(text))
    return pairs.select(*keys).join(made, keys, "left")
