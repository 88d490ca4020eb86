"""The whole analysis as a stream: its tables and one commit record for each micro-batch.

A micro-batch writes its rows of every table into folders of its own and then one commit record.
Readers see committed batches only, so a batch that stopped between two tables is not seen; when it is
repeated its folders are replaced. A batch that is repeated after its commit writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from glossaleaf.plans.analysis import Analysis
from glossaleaf.schemas import ERROR_MEMORY
from glossaleaf.sources.tables import read_table

TABLES = [f.name for f in fields(Analysis)]
COMMIT = T.StructType([T.StructField("batch", T.LongType())])
STORED = T.StructType([T.StructField("primary_id", T.StringType()), *COMMIT.fields])
REMEMBERED = T.StructType([*ERROR_MEMORY.fields, T.StructField("error_no", T.IntegerType()), *COMMIT.fields])


def commits(spark: SparkSession, out: str) -> DataFrame:
    """One row per committed batch."""
    return read_table(spark, f"{out}/commits", COMMIT)


def committed(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A table's rows of the committed batches."""
    if not commits(spark, out).head(1):
        raise ValueError("no batch was committed yet")
    rows = spark.read.option("mergeSchema", False).parquet(f"{out}/{name}")
    # one row per batch on the right: it chooses the folders
    return rows.join(commits(spark, out), "batch", "left_semi").drop("batch")


def _before(spark: SparkSession, out: str, name: str, schema: T.StructType, number: int) -> DataFrame:
    """A table's rows of the batches committed before a batch."""
    rows = read_table(spark, f"{out}/{name}", schema).filter(F.col("batch") < number)
    return rows.join(commits(spark, out), "batch", "left_semi").drop("batch")


def run(
    stream: DataFrame, analyse: Callable[..., Analysis], out: str, checkpoint: str, remember: bool = False
) -> StreamingQuery:
    """Analyses the submissions that have arrived.

    ``analyse`` takes the new submissions and the keys stored before (primary_id); with ``remember``
    also the error memory, the errors of earlier batches with their vectors. Both are of
    committed batches, so a key is taken once and an error remembered once however often a batch is
    repeated. An earlier batch is always committed before a later one runs.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if commits(spark, out).filter(F.col("batch") == number).head(1):
            return
        known = [_before(spark, out, "entries", STORED, number)]
        if remember:
            known.append(_before(spark, out, "errors", REMEMBERED, number))
        result = analyse(batch, *known)
        for name in TABLES:
            table = getattr(result, name)
            if table is not None:
                table.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        # one file: the batch is there with all its tables or not at all
        spark.range(1).select(F.lit("done").alias("state")).coalesce(1).write.mode("overwrite").parquet(f"{out}/commits/batch={number}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
