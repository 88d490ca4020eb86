from collections import Counter

from glossaleaf.operators import store
from glossaleaf.sources import given
from glossaleaf.streaming import submissions


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def land(spark, df, folder, parts):
    """The rows in several files, as if they had arrived one after the other."""
    for i, part in enumerate(df.randomSplit([1.0] * parts, seed=3)):
        part.coalesce(1).write.parquet(f"{folder}/in/{i}")
    return spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_status_stream_equals_batch_and_restart_adds_nothing(spark, sf_dir, tmp_path):
    events = given.status_events(spark, sf_dir)
    for turn in range(2):
        stream = (
            land(spark, events, tmp_path, 4)
            if turn == 0
            else spark.readStream.schema(events.schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        )
        query = submissions.run_batches(stream, submissions.latest_status, f"{tmp_path}/out", f"{tmp_path}/state")
        query.awaitTermination()
        got = submissions.read_status(spark.read.parquet(f"{tmp_path}/out/status"))
        assert rows(got.select(*events.columns)) == rows(store.latest_per_key(events, "job_id", ["ts"]).select(*events.columns))
    assert spark.read.parquet(f"{tmp_path}/out/status").select("batch").distinct().count() > 1


def test_repeated_submissions_are_dropped(spark, sf_dir, tmp_path):
    events = given.status_events(spark, sf_dir).select("job_id", "diary_id", "ts")
    first = submissions.first_submissions(land(spark, events, tmp_path, 3), "job_id", "ts", "365 days")
    submissions.append_stream(first.select("job_id"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == rows(events.select("job_id").distinct())


def test_first_row_of_a_key_wins_across_batches_and_restarts(spark, tmp_path):
    """One key holds a third of the rows; its repeats come in every batch."""
    rows_in = [("hot" if i % 3 == 0 else f"k{i % 40}", i) for i in range(300)]
    df = spark.createDataFrame(rows_in, "job_id string, seq int")
    for i in range(3):
        df.filter(f"seq >= {i * 100} and seq < {i * 100 + 100}").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")

    def run(number):
        stream = (
            spark.readStream.schema(df.schema).option("recursiveFileLookup", True)
            .option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        )
        submissions.accept_batches(stream, "job_id", ["seq"], f"{tmp_path}/out", f"{tmp_path}/state-{number}").awaitTermination()
        return rows(spark.read.parquet(f"{tmp_path}/out").select("job_id", "seq"))

    first = {}
    for job, seq in rows_in:
        first.setdefault(job, seq)
    once = run(0)
    assert once == Counter(first.items())
    assert run(1) == once  # all batches repeated from the start: the same rows again


def test_a_batch_reads_only_the_buckets_it_touches(spark, tmp_path):
    schema = "job_id string, seq int"
    out = f"{tmp_path}/out"
    for i in range(2):
        rows_in = [(f"k{n}", n) for n in range(i * 50, i * 50 + 50)]
        spark.createDataFrame(rows_in, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    spark.createDataFrame([("k7", 900), ("k7", 901)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    df = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    stream = (
        spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    )
    submissions.accept_batches(stream, "job_id", ["seq"], out, f"{tmp_path}/state", buckets=8).awaitTermination()
    assert spark.read.parquet(out).count() == 100
    bucket = spark.read.parquet(out).filter("job_id = 'k7'").first().bucket
    before = submissions.stored_before(spark, out, df.schema, 3, [bucket])
    assert before.filter("job_id = 'k7'").count() == 1
    assert all(f"/bucket={bucket}/" in r[0] for r in before.selectExpr("input_file_name()").distinct().collect())
    assert "PartitionFilters: [" in before._jdf.queryExecution().executedPlan().toString()
