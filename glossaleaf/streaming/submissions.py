"""Submissions and job states as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from glossaleaf.operators import store
from glossaleaf.sources.tables import read_table


def run_batches(
    stream: DataFrame, step: Callable[[DataFrame], dict[str, DataFrame]], out: str, checkpoint: str
) -> StreamingQuery:
    """Applies a batch transform to what has arrived and appends its tables, by name.

    Each micro-batch owns the folder ``<name>/batch=N``, which a repeat of that batch
    replaces, so a restart after a lost driver writes nothing twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        for name, table in step(batch).items():
            table.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_status(batch: DataFrame) -> dict[str, DataFrame]:
    """A micro-batch shrinks to one record per job; the reader takes the latest of those."""
    return {"status": store.latest_per_key(batch, "job_id", ["ts"])}


def read_status(batches: DataFrame) -> DataFrame:
    return store.latest_per_key(batches.drop("batch"), "job_id", ["ts"])


def stored_before(spark: SparkSession, out: str, schema: T.StructType, number: int, buckets: list[int]) -> DataFrame:
    """What batches before ``number`` stored in the given buckets; other folders are not read."""
    kept = T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField("bucket", T.LongType())])
    return read_table(spark, out, kept).filter((F.col("batch") < number) & F.col("bucket").isin(buckets))


def accept_batches(
    stream: DataFrame, key: str, order: list[str], out: str, checkpoint: str, buckets: int = 64
) -> StreamingQuery:
    """Keeps the first row of each key, whenever a repeat arrives.

    The accepted rows are stored by a hash of their key. A micro-batch is reduced to one row per
    key before the shuffle and held against the keys of the buckets it touches only: of these,
    the key column alone is read. Give ``buckets`` so many that a bucket's keys are a small read, and
    merge the folders of old batches from time to time.
    """

    def write(batch: DataFrame, number: int) -> None:
        dealt = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("long"))
        touched = [r.bucket for r in dealt.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        # a repeated batch must not read the folder it is about to replace
        before = stored_before(batch.sparkSession, out, batch.schema, number, touched).select(key)
        accepted, _ = store.append_new(dealt, before, key, order)
        accepted.write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/batch={number}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def first_submissions(stream: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """Drops repeats of a key that arrive within ``delay`` of the first."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp"))
    return timed.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def append_stream(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
