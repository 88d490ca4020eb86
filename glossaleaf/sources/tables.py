"""Reading and writing the diary tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossaleaf.functions import keys
from glossaleaf.schemas import SUBMISSIONS, UNKNOWN_EXPRESSIONS


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table with its declared schema; empty if nothing was stored yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Gives a scan that offers far fewer pieces than there are cores more of them.

    For text work that costs much more than moving the text. A large table has pieces
    enough and is left where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() * 2 <= cores else df


def shaped(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema``, in order and type; a missing one fails here, not later."""
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def append_table(df: DataFrame, path: str, schema: T.StructType, partition_by: list[str] | None = None) -> None:
    writer = shaped(df, schema).write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_snapshot(df: DataFrame, path: str) -> None:
    """A new state of a table, to a folder that must not exist yet."""
    df.write.mode("errorifexists").parquet(path)


def read_submissions(spark: SparkSession, path: str, file_format: str = "json") -> DataFrame:
    return spark.read.schema(SUBMISSIONS).format(file_format).load(path)


def read_expressions_with_text_spans(spark: SparkSession, path: str) -> DataFrame:
    """Unknown expressions from a table that stores spans as ``[start, end]`` text."""
    text_form = T.StructType(
        [
            T.StructField(f.name, T.StringType() if f.name.startswith("span_") else f.dataType)
            for f in UNKNOWN_EXPRESSIONS.fields
        ]
    )
    table = spark.read.schema(text_form).parquet(path)
    return table.withColumns(
        {
            "span_original": keys.span_from_text(F.col("span_original")),
            "span_translation": keys.span_from_text(F.col("span_translation")),
        }
    )
