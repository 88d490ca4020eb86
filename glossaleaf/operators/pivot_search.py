"""Exact nearest errors with pivots: blocks that cannot hold one of the k are never sent.

A few stored vectors are pivots. Every vector knows its distance to each; the stored ones are cut into
blocks by their nearest pivot and their distance to it, and a block keeps the least and the greatest distance
to each pivot. By the triangle inequality these bound the distance between a query and anything in the
block, from below and from above. The blocks that must hold k vectors by their upper bounds give a limit; a
query asks only the blocks whose lower bound is within it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaleaf.operators import memory
from glossaleaf.session import materialize

# vectors that the pivots are chosen from, at most
SAMPLE = 5_000
BANDS = 64
QUERY_BLOCK = 4_096
BLOCK = ["pivot", "band", "part"]
# bounds are widened by this share, for the rounding of distances
ROOM = 1e-9


@dataclass
class Plan:
    """The stored vectors by block, what is known of each block, and which blocks each query asks."""

    stored: DataFrame
    blocks: DataFrame
    asked: DataFrame
    group: list[str]

    def pairs(self) -> tuple[int, int]:
        """(asked, all): pairs of a query and a block of its group."""
        queries = self.asked.select("query_id", *self.group).distinct()
        return self.asked.filter("pivot IS NOT NULL").count(), queries.join(self.blocks, self.group).count()


def choose_pivots(vectors: DataFrame, pivots: int, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Per length of vectors, up to ``pivots`` far-apart ones out of at most ``sample`` vectors, those whose ids
    hash lowest."""
    some = vectors.orderBy(F.xxhash64("error_id"), "error_id").limit(sample)
    by_length: dict[int, list] = {}
    for row in some.select("embedding").collect():
        by_length.setdefault(len(row.embedding), []).append(row.embedding)
    return {n: _far_apart(np.array(rows, dtype="float64"), pivots) for n, rows in by_length.items()}


def _far_apart(vectors: np.ndarray, n: int) -> np.ndarray:
    chosen = [0]
    gap = ((vectors - vectors[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(vectors)):
        chosen.append(int(np.argmax(gap)))
        gap = np.minimum(gap, ((vectors - vectors[chosen[-1]]) ** 2).sum(axis=1))
    return vectors[chosen]


def _distances(vectors: Column, pivots: dict[int, np.ndarray], n: int) -> Column:
    """Distances to the pivots of the vector's length; to one that there is not, 0 for all."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = [None] * len(batch)
            lengths = batch.map(len).to_numpy()
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                found = np.stack(batch.iloc[rows].to_numpy()).astype("float64")
                full = np.zeros((len(rows), n))
                for j, pivot in enumerate(pivots.get(int(length), ())):
                    full[:, j] = np.sqrt(((found - pivot) ** 2).sum(axis=1))
                for row, values in zip(rows, full):
                    out[row] = values
            yield pd.Series(out, dtype=object)

    return run(vectors)


def _in_blocks(errors: DataFrame, group: list[str], pivots: dict[int, np.ndarray], n: int, size: int) -> DataFrame:
    """Adds the block: the nearest pivot, a band of distances to it, and a part of a band that is too large."""
    away = errors.withColumn("away", _distances(F.col("embedding"), pivots, n))
    near = F.array_min(F.transform("away", lambda d, j: F.struct(d.alias("d"), j.alias("j"))))
    own = materialize(away.withColumn("_near", near).select(*away.columns, F.col("_near.j").alias("pivot"), F.col("_near.d").alias("_d")), "pivots")
    edges = [i / BANDS for i in range(1, BANDS)]
    rings = own.groupBy(*group, "pivot").agg(
        F.percentile_approx("_d", edges, 1000).alias("_edges"), F.ceil(F.count("*") / size).alias("_n")
    )
    at = F.size(F.filter("_edges", lambda e: e < F.col("_d")))
    # as many bands as blocks are needed
    banded = own.join(rings, [*group, "pivot"]).withColumn("band", F.floor(at * F.least("_n", F.lit(BANDS)) / BANDS).cast("int"))
    banded = banded.drop("_edges", "_n", "_d")
    parts = banded.groupBy(*group, "pivot", "band").agg(F.ceil(F.count("*") / size).alias("_n"))
    cut = banded.join(parts, [*group, "pivot", "band"]).withColumn("part", F.pmod(F.xxhash64("error_id"), F.col("_n")).cast("int"))
    return cut.drop("_n")


def plan(
    queries: DataFrame, errors: DataFrame, k: int, group: list[str], exclude_same_id: bool, pivots: int, size: int
) -> Plan:
    errors = errors.filter(F.size("embedding") > 0).select("error_id", "embedding", *group)
    chosen = choose_pivots(errors, pivots)
    stored = materialize(_in_blocks(errors, group, chosen, pivots, size), "pivot-blocks")
    bounds = [F.array(*[f(F.get("away", j)) for j in range(pivots)]) for f in (F.min, F.max)]
    blocks = stored.groupBy(*group, *BLOCK).agg(F.count("*").alias("n"), bounds[0].alias("near"), bounds[1].alias("far"))
    blocks = materialize(blocks, "pivot-bounds")

    asking = queries.filter(F.size("embedding") > 0).select("query_id", "embedding", *group)
    away = asking.select("query_id", *group, _distances(F.col("embedding"), chosen, pivots).alias("away"))
    parts = away.groupBy(*group).agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("n_q"))
    left = away.join(parts, group).withColumn("q_block", F.pmod(F.xxhash64("query_id"), F.col("n_q")).cast("int")).drop("n_q")
    right = blocks.join(parts, group).withColumn("q_block", F.explode(F.sequence(F.lit(0), F.col("n_q") - 1))).drop("n_q")
    need = k + exclude_same_id

    def wanted(own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if own.empty or known.empty:
            return pd.DataFrame({"query_id": [], **{c: [] for c in BLOCK}})
        q, near, far = (np.stack(x.to_numpy()) for x in (own["away"], known["near"], known["far"]))
        n = known["n"].to_numpy()
        found = []
        for at in range(0, len(q), 64):
            some = q[at : at + 64]
            low, high = np.zeros((len(some), len(n))), np.full((len(some), len(n)), np.inf)
            for j in range(q.shape[1]):
                d = some[:, j, None]
                low = np.maximum(low, np.maximum(d - far[:, j], near[:, j] - d))
                high = np.minimum(high, d + far[:, j])
            order = np.argsort(high, axis=1, kind="stable")
            enough = np.cumsum(n[order], axis=1) >= need
            first = np.where(enough.any(axis=1), enough.argmax(axis=1), len(n) - 1)
            limit = np.take_along_axis(high, np.take_along_axis(order, first[:, None], axis=1), axis=1)
            limit[~enough.any(axis=1)] = np.inf
            rows, columns = np.nonzero(low * (1 - ROOM) <= limit * (1 + ROOM) + ROOM)
            found.append(pd.DataFrame({"query_id": own["query_id"].to_numpy()[at + rows], **{c: known[c].to_numpy()[columns] for c in BLOCK}}))
        return pd.concat(found)

    asked = left.groupBy(*group, "q_block").cogroup(right.groupBy(*group, "q_block"))
    rows = asked.applyInPandas(wanted, "query_id long, pivot int, band int, part int")
    asking = asking.toDF("query_id", "embedding", *group)
    return Plan(stored, blocks, materialize(asking.join(rows, "query_id"), "pivot-asked"), group)


def similar_errors(
    queries: DataFrame,
    errors: DataFrame,
    k: int = 10,
    group: list[str] | None = None,
    exclude_same_id: bool = False,
    pivots: int = 16,
    size: int = 1_024,
) -> DataFrame:
    """The rows of ``memory.similar_errors``, exact, with blocks of about ``size`` left out where they
    cannot hold one of the k nearest.

    How much is saved depends on the vectors: much if they lie in clusters, little if all are about as
    far apart. ``pivots`` numbers per vector are kept besides. Ids of queries must be unique.
    """
    group = group or memory.SEARCH_KEYS
    return found(plan(queries, errors, k, group, exclude_same_id, pivots, size), k, exclude_same_id)


def found(known: Plan, k: int, exclude_same_id: bool) -> DataFrame:
    block = [*known.group, *BLOCK]
    parts = known.asked.groupBy(*block).agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("n_q"))
    left = known.asked.join(parts, block).withColumn("q_part", F.pmod(F.xxhash64("query_id"), F.col("n_q")).cast("int"))
    # an inner join: a block that nobody asks stays where it is
    right = known.stored.drop("away").join(parts, block).withColumn("q_part", F.explode(F.sequence(F.lit(0), F.col("n_q") - 1)))

    def search(asked: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or stored.empty:
            return pd.DataFrame({"query_id": [], "error_id": [], "distance": []})
        return memory.nearest(*memory.arrays(asked, "query_id"), *memory.arrays(stored, "error_id"), k, exclude_same_id)

    key = [*block, "q_part"]
    hits = left.select("query_id", "embedding", *key).groupBy(*key).cogroup(right.select("error_id", "embedding", *key).groupBy(*key))
    return memory.best_rows(hits.applyInPandas(search, memory.FOUND), k, "distance")
