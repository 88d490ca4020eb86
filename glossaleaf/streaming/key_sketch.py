"""Key refusal with a Bloom filter per bucket: only possible repeats are looked up among the stored keys.

Beside the rows that a micro-batch stores lies a sketch of their keys: per bucket, bitmaps in which
every key has set a few bits. The bits of a new key are tested first. A key with a bit unset was
never stored; only the buckets of the others are read, and of these the key column alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from glossaleaf.operators import store
from glossaleaf.session import materialize
from glossaleaf.sources.tables import read_table
from glossaleaf.streaming import submissions

# bits of a bitmap of Spark's, and bits that a key sets
BITMAP = 32_768
HASHES = 4
SKETCH = T.StructType(
    [T.StructField("bucket", T.LongType()), T.StructField("part", T.LongType()), T.StructField("bits", T.BinaryType()), T.StructField("batch", T.LongType())]
)


def _spots(keys: DataFrame, key: str, parts: int) -> DataFrame:
    """A row for each bit of each key: the bitmap it is in and its place there."""
    hashes = F.array(*[F.pmod(F.xxhash64(F.lit(i), F.col(key)), F.lit(parts * BITMAP)) for i in range(HASHES)])
    rows = keys.select(key, "bucket", F.explode(hashes).alias("_at"))
    return rows.select(key, "bucket", F.expr(f"_at div {BITMAP}").alias("part"), (F.col("_at") % BITMAP).alias("bit"))


def sketch(keys: DataFrame, key: str, parts: int) -> DataFrame:
    """(bucket, part, bits): at most ``parts`` bitmaps of 4 KB per bucket."""
    return _spots(keys, key, parts).groupBy("bucket", "part").agg(F.bitmap_construct_agg("bit").alias("bits"))


def _is_set(bits: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte, (bit % 8).cast("int")) == 1


def possible_repeats(new: DataFrame, known: DataFrame, key: str, parts: int) -> DataFrame:
    """(key, bucket) of the new keys that may be stored: all that are, and few others."""
    # the sketches of all batches in one
    merged = known.groupBy("bucket", "part").agg(F.bitmap_or_agg("bits").alias("bits"))
    spots = _spots(new.select(key, "bucket").distinct(), key, parts).join(merged, ["bucket", "part"], "left")
    tested = spots.groupBy(key, "bucket").agg(F.bool_and(F.coalesce(_is_set(F.col("bits"), F.col("bit")), F.lit(False))).alias("maybe"))
    return tested.filter("maybe").select(key, "bucket")


def read(spark: SparkSession, out: str) -> DataFrame:
    """The accepted rows."""
    return spark.read.parquet(f"{out}/rows").drop("batch", "bucket")


def accept_batches(
    stream: DataFrame, key: str, order: list[str], out: str, checkpoint: str, buckets: int = 64, parts: int = 8
) -> StreamingQuery:
    """Like ``submissions.accept_batches``, with sketches. One bitmap holds some 3,000 keys with one
    in a hundred false alarms; give ``parts`` for the keys of a bucket. More only cost reads."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        dealt = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("long"))
        known = read_table(spark, f"{out}/sketch", SKETCH).filter(F.col("batch") < number)
        maybe = materialize(possible_repeats(dealt, known, key, parts), "possible-repeats")
        touched = [r.bucket for r in maybe.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        before = maybe.select(key).limit(0)
        if touched:
            stored = submissions.stored_before(spark, f"{out}/rows", batch.schema, number, touched)
            before = stored.select(key).join(maybe.select(key), key, "left_semi")
        accepted, _ = store.append_new(dealt, before, key, order)
        accepted.write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/rows/batch={number}")
        sketch(accepted, key, parts).write.mode("overwrite").parquet(f"{out}/sketch/batch={number}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
