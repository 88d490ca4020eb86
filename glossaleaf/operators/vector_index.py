"""A stored index of the error memory: inverted lists with product-quantised codes.

The index is two tables. ``model`` holds the centres of the lists and the codebooks, fitted once on a
bounded sample. ``lists`` holds every stored vector under the list of its nearest centre, with
a short code of what is left after the centre: one byte per part of the vector. Its folders are the
lists, so appending writes new files and a search reads the asked lists only.

A search ranks the codes of each asked list, then the best of them by the true distances of their vectors,
in the same task: only a query's k nearest of a list leave it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaleaf.operators import memory
from glossaleaf.session import materialize

# vectors that centres and codebooks are fitted on, at most
SAMPLE = 20_000
ROUNDS = 12
CODEWORDS = 256
# queries of a task, and vectors of one list that meet them there, at most; fewer if they are long
QUERY_BLOCK = 32_768
CODE_BLOCK = 32_768
# coded vectors that one choice of the best by codes is made for
CHOICE = 8_192


@dataclass
class Model:
    """Centres (lists x numbers) and codebooks (parts x codewords x numbers of a part)."""

    centres: np.ndarray
    books: np.ndarray

    def lists_of(self, vectors: np.ndarray, n: int = 1) -> np.ndarray:
        """The nearest n lists of each vector, nearest first."""
        rough = (self.centres**2).sum(axis=1) - 2.0 * (vectors @ self.centres.T)
        return np.argsort(rough, axis=1, kind="stable")[:, :n]

    def parts(self, vectors: np.ndarray) -> np.ndarray:
        return vectors.reshape(len(vectors), len(self.books), -1)

    def codes(self, vectors: np.ndarray, lists: np.ndarray) -> np.ndarray:
        left = self.parts(vectors - self.centres[lists])
        out = np.empty(left.shape[:2], np.uint8)
        for p, book in enumerate(self.books):
            out[:, p] = np.argmin((book**2).sum(axis=1) - 2.0 * (left[:, p] @ book.T), axis=1)
        return out

    def decoded(self, which: int, codes: np.ndarray) -> np.ndarray:
        """The vectors of one list as their codes give them."""
        left = [book[codes[:, p]] for p, book in enumerate(self.books)]
        return self.centres[which] + np.concatenate(left, axis=1)


def _centres(vectors: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Lloyd's rounds from spread-out first centres; an empty centre stays where it was."""
    rng = np.random.default_rng(seed)
    n = min(n, len(vectors))
    chosen = vectors[[rng.integers(len(vectors))]]
    gap = ((vectors - chosen) ** 2).sum(axis=1)
    while len(chosen) < n:
        total = gap.sum()
        at = rng.choice(len(vectors), p=gap / total) if total > 0 else rng.integers(len(vectors))
        chosen = np.vstack([chosen, vectors[at]])
        gap = np.minimum(gap, ((vectors - vectors[at]) ** 2).sum(axis=1))
    for _ in range(ROUNDS):
        own = np.argmin((chosen**2).sum(axis=1) - 2.0 * (vectors @ chosen.T), axis=1)
        size = np.bincount(own, minlength=n)
        sums = np.zeros_like(chosen)
        np.add.at(sums, own, vectors)
        chosen = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], chosen)
    return chosen


def fit(vectors: DataFrame, lists: int, parts: int = 16, sample: int = SAMPLE, seed: int = 7) -> Model:
    """Centres and codebooks from at most ``sample`` vectors, those whose ids hash lowest. All vectors
    must have one length, a multiple of ``parts``."""
    some = vectors.filter(F.size("embedding") > 0).orderBy(F.xxhash64("error_id"), "error_id").limit(sample)
    rows = [r.embedding for r in some.select("embedding").collect()]
    if not rows:
        raise ValueError("no vector to fit the index on")
    found = np.array(rows, dtype="float64")
    if found.shape[1] % parts:
        raise ValueError(f"vectors of {found.shape[1]} numbers do not divide into {parts} parts")
    centres = _centres(found, lists, seed)
    model = Model(centres, np.empty((parts, 0, 0)))
    left = model.parts(found - centres[model.lists_of(found)[:, 0]])
    return Model(centres, np.stack([_padded(_centres(left[:, p], CODEWORDS, seed + p)) for p in range(parts)]))


def _padded(book: np.ndarray) -> np.ndarray:
    # a small sample has fewer codewords; the rest repeat the first and are never the nearer
    return np.vstack([book, np.repeat(book[:1], CODEWORDS - len(book), axis=0)])


def create(vectors: DataFrame, path: str, lists: int, parts: int = 16, sample: int = SAMPLE, seed: int = 7) -> Model:
    """Fits a model and writes it; the folder must not hold an index yet. Rows are added by ``append``."""
    model = fit(vectors, lists, parts, sample, seed)
    rows = [("centre", i, 0, x.tolist()) for i, x in enumerate(model.centres)]
    rows += [("word", i, p, x.tolist()) for p, book in enumerate(model.books) for i, x in enumerate(book)]
    table = vectors.sparkSession.createDataFrame(rows, "kind string, number int, part int, vector array<double>")
    table.coalesce(1).write.mode("errorifexists").parquet(f"{path}/model")
    return model


def read_model(spark: SparkSession, path: str) -> Model:
    rows = spark.read.parquet(f"{path}/model").collect()
    centres = sorted((r.number, r.vector) for r in rows if r.kind == "centre")
    words = sorted((r.part, r.number, r.vector) for r in rows if r.kind == "word")
    books = np.array([w[2] for w in words])
    return Model(np.array([c[1] for c in centres]), books.reshape(words[-1][0] + 1, CODEWORDS, -1))


def _stacked(batch: pd.Series) -> np.ndarray:
    return np.stack(batch.to_numpy()).astype("float64")


def append(path: str, errors: DataFrame, group: list[str] | None = None) -> None:
    """Adds records (error_id, embedding and the group columns) to the lists of an index. Records
    without a vector are left out. Only new files are written."""
    model = read_model(errors.sparkSession, path)

    @F.pandas_udf("list int, code binary")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                yield pd.DataFrame({"list": pd.Series(dtype="int32"), "code": pd.Series(dtype=object)})
                continue
            found = _stacked(batch)
            lists = model.lists_of(found)[:, 0]
            yield pd.DataFrame({"list": lists.astype("int32"), "code": [c.tobytes() for c in model.codes(found, lists)]})

    rows = errors.filter(F.size("embedding") > 0).select("error_id", "embedding", *(group or memory.SEARCH_KEYS))
    placed = rows.withColumn("_c", coded("embedding")).select(*rows.columns, "_c.code", "_c.list")
    # the rows of a list together, a large list in several files
    dealt = placed.repartition("list", F.pmod(F.xxhash64("error_id"), F.lit(8)))
    dealt.write.mode("append").partitionBy("list").parquet(f"{path}/lists")


def stored(spark: SparkSession, path: str, asked: list[int] | None = None) -> DataFrame:
    """The stored records; of the asked lists only, if given: other folders are not read."""
    table = spark.read.parquet(f"{path}/lists")
    return table if asked is None else table.filter(F.col("list").isin(asked))


def search(
    path: str,
    queries: DataFrame,
    k: int = 10,
    probes: int = 8,
    again: int = 8,
    group: list[str] | None = None,
    exclude_same_id: bool = False,
) -> DataFrame:
    """(query_id, rank, error_id, distance): like ``memory.similar_errors``, from the stored index.

    Each query asks its ``probes`` nearest lists. By the codes, its ``again`` * k best of each list are
    chosen, and those are ranked by squared Euclidean distance, ties by error_id. A
    near error in a list that was not asked, or with a misleading code, is missed. Raise ``probes`` up
    to the number of lists and ``again`` for more recall. Queries and lists are cut into blocks, as large as
    a task can hold, so a very large list is several tasks. As many are chosen by the codes for each ``CHOICE``
    vectors of a block, and its k nearest are returned, whatever ``again`` is.
    """
    group = group or memory.SEARCH_KEYS
    spark = queries.sparkSession
    model = read_model(spark, path)
    probes, most = min(probes, len(model.centres)), k * again

    @F.pandas_udf("array<int>")
    def nearest_lists(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(model.lists_of(_stacked(batch), probes).astype("int32")) if len(batch) else [], dtype=object)

    asking = queries.filter(F.size("embedding") > 0).select("query_id", "embedding", *group)
    # one row per query; it is repeated for its lists on the way to them
    asking = materialize(asking.withColumn("lists", nearest_lists("embedding")), "index-queries")
    asked = asking.select("query_id", "embedding", *group, F.explode("lists").alias("list"))
    # at most one number per list
    lists = sorted(r.list for r in asked.select("list").distinct().collect())
    codes = stored(spark, path, lists).select("error_id", "code", "embedding", "list", *group)

    pair = [*group, "list"]
    numbers = F.lit(model.centres.shape[1])
    sizes = codes.groupBy(*pair).agg(memory.block_count(CODE_BLOCK, numbers).alias("n_c")).join(
        asked.groupBy(*pair).agg(memory.block_count(QUERY_BLOCK, numbers).alias("n_q")), pair
    )
    sizes = memory.beside(sizes)

    def blocked(df: DataFrame, row_id: str, own: str, count: str, other: str, other_count: str) -> DataFrame:
        mine = df.join(sizes, pair).withColumn(own, F.pmod(F.xxhash64(row_id), F.col(count)).cast("int"))
        every = mine.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_count) - 1)))
        return every.drop("n_q", "n_c").groupBy(*pair, "q_block", "c_block")

    def scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "error_id": [], "distance": []})
        which = int(right["list"].iloc[0])
        known = model.decoded(which, np.frombuffer(b"".join(right["code"]), np.uint8).reshape(len(right), -1))
        norms = (known**2).sum(axis=1)
        # a query's own record may be one of the best, and is left out later
        n = most * math.ceil(len(right) / CHOICE) + exclude_same_id

        def by_codes(some: np.ndarray) -> np.ndarray:
            rough = norms - 2.0 * (some @ known.T)
            chosen = np.zeros(rough.shape, bool)
            np.put_along_axis(chosen, np.argpartition(rough, n - 1, axis=1)[:, :n], True, axis=1)
            return chosen

        among = by_codes if n < len(right) else None
        near = memory.nearest(
            *memory.arrays(left, "query_id"), *memory.arrays(right, "error_id"), k, exclude_same_id, among
        )
        # an id that repeats in a list brings each hit once more for each of its rows
        copies = near["query_id"].map(left["query_id"].value_counts()) * near["error_id"].map(right["error_id"].value_counts())
        return near if near.empty or copies.max() == 1 else memory.keep(near.iloc[np.arange(len(near)).repeat(copies)], k)

    left = blocked(asked, "query_id", "q_block", "n_q", "c_block", "n_c")
    right = blocked(codes.toDF(*codes.columns), "error_id", "c_block", "n_c", "q_block", "n_q")
    return memory.best_rows(left.cogroup(right).applyInPandas(scan, memory.FOUND), k, "distance")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the hits of the exact search and how many of them were found."""
    hits = exact.select("query_id", "error_id").join(found.select("query_id", "error_id").withColumn("hit", F.lit(1)), ["query_id", "error_id"], "left")
    return hits.agg(F.count("*").alias("n_exact"), F.count("hit").alias("n_found"))
