"""Token counts from an exact histogram of encoded lengths.

Documents are counted by their encoded length; suffix sums over the histogram then answer,
for every context limit at once, how many documents are longer, how many tokens there are
and how many are left if every document is cut at the limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossaleaf.session import materialize

# lengths per chunk of the two-level sums
CHUNK = 1024


def histogram(lengths: DataFrame, length: str = "n_tokens") -> DataFrame:
    """(length, n_docs) of a column of lengths; null counts as 0. Combines before the shuffle.

    Written once, a row per length: the sums read it more than once, and the encoding that it
    rests on must not run again for each."""
    counts = lengths.groupBy(F.coalesce(F.col(length), F.lit(0)).cast("long").alias("length")).agg(
        F.count("*").alias("n_docs")
    )
    return materialize(counts, "histogram")


def suffix_sums(hist: DataFrame) -> DataFrame:
    """The histogram with, for each length L in it:

    ``docs_from`` and ``tokens_from``, the documents of at least L tokens and their tokens;
    ``total_tokens`` of all documents; ``truncated_total``, the tokens left if every document
    is cut at L; ``docs_upto``, the documents of at most L, so L is the quantile q for every
    q in (``quantile_from``, ``quantile_upto``].

    Sums run within chunks of lengths and over one row per chunk, so no task gets the
    whole histogram. An empty histogram gives no rows.
    """
    chunked = hist.withColumn("chunk", F.floor(F.col("length") / CHUNK))
    totals = chunked.groupBy("chunk").agg(
        F.sum("n_docs").alias("chunk_docs"), F.sum(F.col("n_docs") * F.col("length")).alias("chunk_tokens")
    )
    # one row per chunk: the longest document's length over CHUNK at most
    later = Window.orderBy(F.col("chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    ends = totals.select(
        "chunk",
        F.coalesce(F.sum("chunk_docs").over(later), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("chunk_tokens").over(later), F.lit(0)).alias("tokens_after"),
        F.sum("chunk_docs").over(everything).alias("total_docs"),
        F.sum("chunk_tokens").over(everything).alias("total_tokens"),
    )
    down = Window.partitionBy("chunk").orderBy(F.col("length").desc())
    summed = chunked.select(
        "chunk",
        "length",
        "n_docs",
        F.sum("n_docs").over(down).alias("docs_here"),
        F.sum(F.col("n_docs") * F.col("length")).over(down).alias("tokens_here"),
    ).join(ends, "chunk")
    docs_from = F.col("docs_here") + F.col("docs_after")
    tokens_from = F.col("tokens_here") + F.col("tokens_after")
    docs_below = F.col("total_docs") - docs_from
    return summed.select(
        "length",
        "n_docs",
        docs_from.alias("docs_from"),
        tokens_from.alias("tokens_from"),
        "total_tokens",
        (F.col("total_tokens") - tokens_from + docs_from * F.col("length")).alias("truncated_total"),
        (docs_below + F.col("n_docs")).alias("docs_upto"),
        (docs_below / F.col("total_docs")).alias("quantile_from"),
        ((docs_below + F.col("n_docs")) / F.col("total_docs")).alias("quantile_upto"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, longer_docs, truncated_total) for any limits, in one pass over the sums.

    Between two lengths of the histogram the sums of the next longer one hold. Without
    documents every figure is 0.
    """
    columns = [F.coalesce(F.max("total_tokens"), F.lit(0)).alias("total")]
    for i, limit in enumerate(limits):
        above = F.col("length") > limit
        columns.append(F.coalesce(F.max(F.when(above, F.col("docs_from"))), F.lit(0)).alias(f"docs_{i}"))
        columns.append(F.coalesce(F.max(F.when(above, F.col("tokens_from"))), F.lit(0)).alias(f"tokens_{i}"))
    answers = [
        F.struct(
            F.lit(int(limit)).cast("long").alias("context_limit"),
            F.col(f"docs_{i}").alias("longer_docs"),
            (F.col("total") - F.col(f"tokens_{i}") + F.col(f"docs_{i}") * limit).alias("truncated_total"),
        )
        for i, limit in enumerate(limits)
    ]
    return sums.agg(*columns).select(F.inline(F.array(*answers)))


def quantiles(sums: DataFrame, wanted: list[float]) -> DataFrame:
    """(quantile, length): the shortest length up to which that share of the documents lies."""
    reached = [F.min(F.when(F.col("quantile_upto") >= q, F.col("length"))).alias(f"q_{i}") for i, q in enumerate(wanted)]
    answers = [F.struct(F.lit(float(q)).alias("quantile"), F.col(f"q_{i}").alias("length")) for i, q in enumerate(wanted)]
    return sums.agg(*reached).select(F.inline(F.array(*answers)))
