"""Error memory: stored error records with vectors, and the search for similar ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossaleaf.functions import keys
from glossaleaf.session import materialize

SEARCH_KEYS = ["language_annotation_text", "language_diary_text", "model_id_embedding"]
RULE_KEYS = ["language_annotation_text", "language_diary_text", "error_rule", "category"]

MAX_BROADCAST_GROUPS = 100_000
# rows of a side that a task holds, at most; of long vectors fewer, so that they hold no more than BLOCK_NUMBERS
QUERY_BLOCK = 32_768
MEMORY_BLOCK = 32_768
BLOCK_NUMBERS = 1 << 22
# numbers of a distance matrix, or of gathered vectors, that a task holds at once
TILE = 1 << 20
FOUND = "query_id long, error_id long, distance double"


def to_memory(errors: DataFrame) -> DataFrame:
    """Adds ``page_content``, the text of a record that is embedded and returned."""
    return errors.withColumn(
        "page_content",
        keys.error_text(F.col("category"), F.col("error_rule"), F.col("example_phrase"), F.col("correction")),
    )


def identified(stored: DataFrame) -> DataFrame:
    """Adds ``error_id`` where it is missing: a hash of the record without its vector, so records
    alike in all columns share one."""
    if "error_id" in stored.columns:
        return stored
    return stored.withColumn("error_id", F.xxhash64(*sorted(c for c in stored.columns if c != "embedding")))


# ---- recurring or new ----


def recurring(current: DataFrame, history: DataFrame) -> DataFrame:
    """Current errors whose rule was broken before in the same languages.

    The history shrinks to its distinct rules before it meets the errors.
    """
    return current.join(history.select(*RULE_KEYS).distinct(), RULE_KEYS, "left_semi")


def fresh(current: DataFrame, history: DataFrame) -> DataFrame:
    """Current errors that are not recurring."""
    return current.join(history.select(*RULE_KEYS).distinct(), RULE_KEYS, "left_anti")


def label_by_distance(queries: DataFrame, nearest: DataFrame, threshold: float) -> DataFrame:
    """(query_id, label): RECURRING if the nearest past error is within the threshold."""
    best = nearest.filter("rank = 1").select("query_id", "distance")
    label = F.when(F.col("distance") <= threshold, F.lit("RECURRING")).otherwise(F.lit("NEW"))
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", label.alias("label"))


# ---- similarity search ----


def similar_errors(
    queries: DataFrame,
    memory: DataFrame,
    k: int = 10,
    group: list[str] | None = None,
    exclude_same_id: bool = False,
) -> DataFrame:
    """(query_id, rank, error_id, distance): the k nearest stored errors of each query
    with equal ``group`` columns, by squared Euclidean distance, ties by error_id. Exact.

    ``queries`` has query_id and ``memory`` has error_id (longs); both have ``embedding``
    and the group columns. Both sides are cut into blocks of bounded size and every pair of
    blocks is one task, so a group that holds a large share of all vectors becomes many
    tasks. Each task returns at most k rows per query; vector pairs never become rows. Every
    query meets every stored vector of its group: the cost is the product of the two, and a
    block is sent once for each block of the other side, so blocks are as large as a task can hold.
    """
    group = group or SEARCH_KEYS
    queries = _with_vector(queries).select("query_id", "embedding", *group)
    # both may come from one table: new column identities keep the sides apart
    memory = _with_vector(memory).select("error_id", "embedding", *group).toDF("error_id", "embedding", *group)
    return _best(_block_pairs(queries, memory, k, group, exclude_same_id), k)


def _with_vector(df: DataFrame) -> DataFrame:
    """A record without a vector, left by a failed embedding call, is near to nothing."""
    return df.filter(F.size("embedding") > 0)


def _best(found: DataFrame, k: int) -> DataFrame:
    # a pair may have been found in several cells
    return best_rows(found.groupBy("query_id", "error_id").agg(F.min("distance").alias("distance")), k, "distance")


def best_rows(found: DataFrame, k: int, distance: str) -> DataFrame:
    """The k rows of least distance of each query, ranked, ties by error_id."""
    nearest = Window.partitionBy("query_id").orderBy(distance, "error_id")
    ranked = found.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "error_id", distance, *[c for c in found.columns if c not in ("query_id", "error_id", distance)])


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays of numbers."""
    gaps = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap)


def _block_pairs(
    queries: DataFrame, memory: DataFrame, k: int, group: list[str], exclude_same_id: bool
) -> DataFrame:
    def sizes(df: DataFrame, rows: int, name: str) -> DataFrame:
        return df.groupBy(*group).agg(block_count(rows, F.max(F.size("embedding"))).alias(name))

    # one row per group and side: the block counts of both
    blocks = beside(sizes(queries, QUERY_BLOCK, "n_q").join(sizes(memory, MEMORY_BLOCK, "n_m"), group))

    def numbered(df: DataFrame, row_id: str, own: str, count: str, other: str, other_count: str) -> DataFrame:
        return (
            df.join(blocks, group)
            .withColumn(own, F.pmod(F.xxhash64(row_id), F.col(count)))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_count) - 1)))
            .select(row_id, "embedding", *group, F.col("q_block").cast("int"), F.col("m_block").cast("int"))
        )

    pair = [*group, "q_block", "m_block"]
    left = numbered(queries, "query_id", "q_block", "n_q", "m_block", "n_m").groupBy(*pair)
    right = numbered(memory, "error_id", "m_block", "n_m", "q_block", "n_q").groupBy(*pair)

    def search(asked: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or stored.empty:
            return pd.DataFrame({"query_id": [], "error_id": [], "distance": []})
        return nearest(*arrays(asked, "query_id"), *arrays(stored, "error_id"), k, exclude_same_id)

    return left.cogroup(right).applyInPandas(search, FOUND)


def block_count(rows: int, numbers: Column) -> Column:
    """An aggregate: the blocks that the counted rows make, of at most ``rows`` and BLOCK_NUMBERS, if a vector has ``numbers``."""
    held = F.least(F.lit(rows), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_NUMBERS) / numbers)))
    return F.ceil(F.count("*") / held).cast("int")


def beside(blocks: DataFrame) -> DataFrame:
    """Counts by group that go to the rows, not the rows to them, unless the groups are very many."""
    return F.broadcast(blocks) if blocks.limit(MAX_BROADCAST_GROUPS + 1).count() <= MAX_BROADCAST_GROUPS else blocks


def arrays(part: pd.DataFrame, row_id: str) -> tuple[np.ndarray, np.ndarray]:
    return part[row_id].to_numpy(), np.stack(part["embedding"].to_numpy()).astype("float64")


def keep(found: pd.DataFrame, k: int) -> pd.DataFrame:
    ordered = found.sort_values(["query_id", "distance", "error_id"], kind="stable")
    return ordered[ordered.groupby("query_id").cumcount() < k]


def nearest(
    query_ids: np.ndarray,
    queries: np.ndarray,
    error_ids: np.ndarray,
    errors: np.ndarray,
    k: int,
    exclude_same_id: bool = False,
    among: Callable[[np.ndarray], np.ndarray] | None = None,
) -> pd.DataFrame:
    """The k nearest stored vectors of each query.

    A matrix product finds the candidates, with room for its rounding; their distances
    are then computed directly, so that equal vectors tie exactly. Both are done for a few queries
    at a time, so that no array holds many more than ``TILE`` numbers, however long the vectors are.
    ``among`` gets some of the queries and marks (queries x errors) what they may find.
    """
    found = []
    error_norms = (errors**2).sum(axis=1)
    at_once, pairs_at_once = max(TILE // max(len(errors), 1), 1), max(TILE // max(errors.shape[1], 1), 1)
    for at in range(0, len(queries), at_once):
        ids, block = query_ids[at: at + at_once], queries[at: at + at_once]
        norms = (block**2).sum(axis=1)
        # in place: one array of all pairs
        rough = block @ errors.T
        rough *= -2.0
        rough += norms[:, None]
        rough += error_norms
        if exclude_same_id:
            rough[ids[:, None] == error_ids[None, :]] = np.inf
        if among is not None:
            rough[~among(block)] = np.inf
        room = 1e-9 * (1.0 + norms[:, None] + error_norms.max())
        last = min(k, rough.shape[1]) - 1
        limit = np.partition(rough, last, axis=1)[:, last: last + 1]
        rows, columns = np.nonzero((rough <= limit + room) & np.isfinite(rough))
        some = []
        for start in range(0, len(rows), pairs_at_once):
            r, c = rows[start: start + pairs_at_once], columns[start: start + pairs_at_once]
            exact = ((block[r] - errors[c]) ** 2).sum(axis=1)
            some.append(
                keep(pd.DataFrame({"query_id": ids[r], "error_id": error_ids[c], "distance": exact}), k)
            )
        if some:
            found.append(keep(pd.concat(some), k) if len(some) > 1 else some[0])
    if not found:
        return pd.DataFrame({"query_id": [], "error_id": [], "distance": []})
    every = pd.concat(found)
    # only an id that comes twice may have hits of several rounds
    return every if len(np.unique(query_ids)) == len(query_ids) else keep(every, k)


def similar_by_vector(queries: DataFrame, memory: DataFrame, k: int = 10, group: list[str] | None = None) -> DataFrame:
    """(query_id, error_id, distance): the rows of ``similar_errors`` without their rank, where many
    vectors are equal.

    Equal vectors of a group have the same nearest errors, so each different one is searched for once; of
    the stored rows with one vector only the k of least error_id can be among the nearest. The cost
    is the product of the different vectors of the two sides, at most k of each stored one. Rows that
    come twice, of either side, count twice among a query's k.
    """
    group = group or SEARCH_KEYS
    same = [*group, "embedding"]
    asked = _with_vector(queries).select("query_id", *same)
    # numbered once: the numbers must not change if a task runs again
    different = materialize(asked.select(*same).distinct().withColumn("query_id", F.monotonically_increasing_id()), "vectors")
    least = Window.partitionBy(*same).orderBy("error_id")
    stored = _with_vector(memory).select("error_id", *same).withColumn("_nth", F.row_number().over(least))
    stored = stored.filter(F.col("_nth") <= k).select("error_id", *same)
    near = best_rows(_block_pairs(different, stored, k, group, False), k, "distance")
    near = near.groupBy("query_id").agg(F.collect_list(F.struct("error_id", "distance")).alias("_near"))
    answers = different.join(near, "query_id").drop("query_id")
    found = best_rows(asked.join(answers, same).select("query_id", F.inline("_near")), k, "distance")
    return found.groupBy("query_id", "error_id").agg(F.min("distance").alias("distance"))


def past_errors(errors: DataFrame, memory: DataFrame, entry: str, k: int = 10) -> DataFrame:
    """(entry, past): the texts of the stored errors that are among the ``k`` nearest of any of
    the entry's errors, each once, nearest first. Entries without any are left out.

    ``errors`` has query_id, embedding, the entry and the group columns; ``memory`` also has
    page_content. An entry's list holds k texts for each of its errors at most.
    """
    found = with_texts(similar_by_vector(errors, memory, k), memory)
    owned = found.join(errors.select("query_id", entry), "query_id")
    texts = owned.groupBy(entry, "page_content").agg(F.min("distance").alias("distance"))
    ordered = F.sort_array(F.collect_list(F.struct("distance", "page_content")))
    return texts.groupBy(entry).agg(ordered.alias("_past")).select(entry, F.col("_past.page_content").alias("past"))


def with_texts(found: DataFrame, memory: DataFrame) -> DataFrame:
    """Adds the stored text of each hit."""
    return found.join(memory.select("error_id", "page_content"), "error_id")


# ---- approximate variant ----


def cells(vectors: Column, tables: int, bits: int, seed: int) -> Column:
    """One cell per table: the signs of ``bits`` seeded random projections. Nothing is fitted,
    so a vector's cells depend on the vector alone."""

    @F.pandas_udf("array<int>")
    def signs(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if batch.empty:
                yield pd.Series([], dtype=object)
                continue
            found = np.stack(batch.to_numpy()).astype("float64")
            planes = np.random.default_rng(seed).standard_normal((found.shape[1], tables, bits))
            above = np.einsum("nd,dtb->ntb", found, planes) > 0
            number = (above << np.arange(bits)).sum(axis=2) + (np.arange(tables) << bits)
            yield pd.Series(list(number.astype("int32")))

    return signs(vectors)


def similar_errors_approx(
    queries: DataFrame,
    memory: DataFrame,
    k: int = 10,
    tables: int = 16,
    bits: int = 3,
    seed: int = 7,
    exclude_same_id: bool = False,
) -> DataFrame:
    """Like ``similar_errors``, but a query only meets vectors that share one of its cells: one
    of 2 ** ``bits`` in each of ``tables`` hash tables. The cell is one more group column, so large
    cells are cut into blocks in the same way. Distances are exact; a near error that shares no
    cell is missed. More bits cost less and miss more, more tables the reverse; raise the bits
    with the table so that a cell keeps its size. Without bits all is one cell, and exact.
    """

    def in_cells(df: DataFrame) -> DataFrame:
        return _with_vector(df).withColumn("cell", F.explode(cells(F.col("embedding"), tables, bits, seed)))

    return similar_errors(in_cells(queries), in_cells(memory), k, [*SEARCH_KEYS, "cell"], exclude_same_id)
