"""Sketches of stored keys: no false refusal, few false alarms, no read for new keys."""

import pytest
from pyspark.sql import functions as F

from glossaleaf.session import fresh_path
from glossaleaf.streaming import key_sketch, submissions

SCHEMA = "k string, at int"


def bucketed(df):
    return df.withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(4)).cast("long"))


def test_every_stored_key_is_possible_and_few_others(spark):
    stored = bucketed(spark.range(8_000).select(F.concat(F.lit("a"), "id").alias("k")))
    other = bucketed(spark.range(8_000).select(F.concat(F.lit("b"), "id").alias("k")))
    known = [key_sketch.sketch(part, "k", 2) for part in stored.randomSplit([0.5, 0.5], 1)]
    known = known[0].unionByName(known[1])
    found = key_sketch.possible_repeats(stored.unionByName(other), known, "k", 2)
    names = {r.k[0]: r.n for r in found.groupBy(F.left("k", F.lit(1)).alias("k")).agg(F.count("*").alias("n")).collect()}
    assert names["a"] == 8_000 and names.get("b", 0) < 160
    assert key_sketch.possible_repeats(other, known.limit(0), "k", 2).count() == 0


@pytest.fixture
def arrive(spark):
    arrivals, out, state = (fresh_path(spark, x) for x in ("in", "out", "state"))

    def go(*rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema(SCHEMA).parquet(arrivals)
        key_sketch.accept_batches(stream, "k", ["at"], out, state, buckets=4).awaitTermination()
        return sorted(tuple(r) for r in key_sketch.read(spark, out).collect())

    return go


def test_new_keys_read_no_stored_key(arrive, monkeypatch):
    asked = []
    real = submissions.stored_before

    def counted(spark, out, schema, number, buckets):
        asked.append(buckets)
        return real(spark, out, schema, number, buckets)

    monkeypatch.setattr(submissions, "stored_before", counted)
    assert arrive(("a", 2), ("a", 1), ("b", 1), (None, 1)) == [("a", 1), ("b", 1)]
    assert arrive(("c", 3), ("d", 3)) == [("a", 1), ("b", 1), ("c", 3), ("d", 3)]
    assert asked == []
    assert arrive(("a", 0), ("e", 4)) == [("a", 1), ("b", 1), ("c", 3), ("d", 3), ("e", 4)]
    assert [len(x) for x in asked] == [1]
