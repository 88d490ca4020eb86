"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered 0 to n - 1 in the order of (doc_id, text). A balanced Feistel network
permutes the numbers below the next power of four; a result of n or more is permuted again
until it is below n (cycle walking), which makes it a permutation of 0 to n - 1. Shard and
slot are remainder and quotient of the permuted number, so anyone who knows seed, n and
row number can compute them, and back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossaleaf.llm.common import whole
from glossaleaf.session import materialize

ROUNDS = 6
LAW = "rows"


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser with fixed odd multipliers."""
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(seed: int) -> list[int]:
    start = np.arange(1, ROUNDS + 1, dtype=np.uint64)
    return _mixed(start * np.uint64(0x9E3779B97F4A7C15), seed & (1 << 64) - 1).tolist()


def _once(x: np.ndarray, half: int, keys: list[int], back: bool) -> np.ndarray:
    size, mask = np.uint64(half), np.uint64((1 << half) - 1)
    left, right = x >> size, x & mask
    for key in reversed(keys) if back else keys:
        if back:
            left, right = right ^ (_mixed(left, key) & mask), left
        else:
            left, right = right, left ^ (_mixed(right, key) & mask)
    return left << size | right


def permuted(rows: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """The permuted place of each row number below ``n``; ``back`` gives the row number of a place."""
    if n < 2:
        return np.asarray(rows, dtype=np.int64)
    half = ((n - 1).bit_length() + 1) // 2
    keys = _keys(seed)
    out = _once(np.asarray(rows, dtype=np.uint64), half, keys, back)
    while (far := out >= n).any():
        out[far] = _once(out[far], half, keys, back)
    return out.astype(np.int64)


def place(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """The row number that lies at (shard, slot)."""
    return int(permuted(np.array([slot * shards + shard]), n, seed, back=True)[0])


def _permute(row: Column, n: Column, seed: int) -> Column:
    @F.pandas_udf("long")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for rows, counts in batches:
            out = permuted(rows.to_numpy(), int(counts.iloc[0]), seed) if len(rows) else rows
            yield pd.Series(out, dtype="int64")

    return run(row, n)


def numbered(rows: DataFrame, order: list[str], number: str, total: str) -> DataFrame:
    """Adds the global row number in ``order`` and the number of rows.

    The rows are dealt out by range and written once, so that a task that runs again finds
    the same parts. Only one count per part is gathered to find where a part begins.
    """
    dealt = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    written = materialize(dealt, "numbered")
    counts = written.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "_part",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
        F.sum("_rows").over(Window.partitionBy(F.lit(1))).alias(total),
    )
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    # one row per part: as many as there are partitions
    joined = written.withColumn("_nth", within).join(F.broadcast(starts), "_part")
    return joined.withColumn(number, F.col("_start") + F.col("_nth") - 1).drop("_part", "_nth", "_start")


def shard(docs: DataFrame, shards: int = 16, seed: int = 0, text: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``rows``: shard sizes differ by one row at most, whatever the rows hold.
    ``size`` is the UTF-8 bytes of the text plus 1; a null text has none. Rows with one
    doc_id are ordered by their text's hash; rows alike in both are interchangeable, and a
    null doc_id comes first. An empty table gives no rows. Other columns are left out.
    """
    content = F.col("text")
    rows = docs.select("doc_id", whole(text).alias("text")).select(
        "doc_id",
        (F.octet_length(content).cast("long") + 1).alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        F.xxhash64(content).alias("text_hash"),
    )
    known = numbered(rows, ["doc_id", "text_hash"], "row", "n")
    at = known.withColumn("place", _permute(F.col("row"), F.col("n"), seed))
    return at.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        F.pmod("place", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"place div {int(shards)}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
