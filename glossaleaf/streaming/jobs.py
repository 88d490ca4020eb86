"""The registered stream queries: run to the end of the given table, then read the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaleaf.languages import Languages
from glossaleaf.operators import intake
from glossaleaf.session import fresh_path
from glossaleaf.sources import given
from glossaleaf.streaming import chain, job_state, key_sketch, submissions


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream; the pattern takes a single file as well as a folder of files."""
    schema = given.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _run(query) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def status_by_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, state = fresh_path(spark, "jobs"), fresh_path(spark, "jobs-state")
    events = given.status_of(_stream(spark, sf_dir, "events"))
    _run(submissions.run_batches(events, submissions.latest_status, out, state))
    return submissions.read_status(spark.read.parquet(f"{out}/status"))


def intake_by_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, state = fresh_path(spark, "intake"), fresh_path(spark, "intake-state")

    def step(batch: DataFrame) -> dict[str, DataFrame]:
        given_rows = given.submissions_of(batch)
        checked = intake.checked(given_rows, Languages(batch.sparkSession))
        good = intake.with_codes(intake.with_keys(checked))
        seen = good.select("job_id", "primary_id", "language_source", "level_rewriting", "reject_reason")
        return {"seen": seen, "status": intake.initial_status(intake.valid(good))}

    _run(submissions.run_batches(_stream(spark, sf_dir, "documents"), step, out, state))
    seen, status = (spark.read.parquet(f"{out}/{name}") for name in ("seen", "status"))
    started = status.select("job_id", "status")
    return seen.join(started, "job_id", "left").drop("batch")


def unique_by_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, state = fresh_path(spark, "unique"), fresh_path(spark, "unique-state")
    events = given.status_of(_stream(spark, sf_dir, "events")).select("job_id", "diary_id", "ts")
    first = submissions.first_submissions(events, "job_id", "ts", "60 days")
    _run(submissions.append_stream(first.select("job_id", "diary_id"), out, state))
    return spark.read.parquet(out)


def first_by_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, state = fresh_path(spark, "first"), fresh_path(spark, "first-state")
    events = given.status_of(_stream(spark, sf_dir, "events")).select("job_id", "diary_id", "ts")
    _run(submissions.accept_batches(events, "job_id", ["ts"], out, state))
    return spark.read.parquet(out).drop("batch", "bucket")


def first_in_many_batches(spark: SparkSession, sf_dir: str, files: int = 4, sketched: bool = False) -> DataFrame:
    """The same over events that arrive span by span of time, so that keys repeat in several
    micro-batches; ``sketched`` tests the keys by sketches first."""
    arrivals, out, state = (fresh_path(spark, name) for name in ("arrivals", "refusal", "refusal-state"))
    events = given.status_of(given.table(spark, sf_dir, "events")).select("job_id", "diary_id", "ts")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    first, last = events.agg(F.min(seconds), F.max(seconds)).first()
    part = F.floor((seconds - first) * files / max(last - first, 1.0))
    most = 1
    for number in range(files):
        arrived = events.filter(F.least(part, F.lit(files - 1)) == number)
        arrived.write.parquet(f"{arrivals}/{number}")
        most = max(most, len(spark.read.schema(events.schema).parquet(f"{arrivals}/{number}").inputFiles()))
    reader = spark.readStream.schema(events.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", most)
    if sketched:
        _run(key_sketch.accept_batches(reader.parquet(arrivals), "job_id", ["ts"], out, state))
        return key_sketch.read(spark, out)
    _run(submissions.accept_batches(reader.parquet(arrivals), "job_id", ["ts"], out, state))
    return spark.read.parquet(out).drop("batch", "bucket")


def chain_by_stream(spark: SparkSession, parts: list[DataFrame], analyse: Callable, name: str, remember: bool = False) -> DataFrame:
    """The chain over submissions that arrive part by part; the stream starts anew after each. Gives
    the committed rows of one of its tables."""
    arrivals, out, state = (fresh_path(spark, x) for x in ("submitted", "chain", "chain-state"))
    for part in parts:
        part.write.mode("append").parquet(arrivals)
        _run(chain.run(spark.readStream.schema(part.schema).parquet(arrivals), analyse, out, state, remember))
    return chain.committed(spark, out, name)


def kept_states_by_stream(spark: SparkSession, sf_dir: str, minutes: int, delay: str) -> DataFrame:
    """Job states over all events, then over older and repeated ones that arrive after a restart."""
    arrivals, out, state = (fresh_path(spark, x) for x in ("events", "kept", "kept-state"))
    events = given.status_of(given.table(spark, sf_dir, "events"))
    for part in (events, events.filter(F.pmod(F.xxhash64("job_id"), F.lit(3)) == 0)):
        part.write.mode("append").parquet(arrivals)
        _run(job_state.run(spark.readStream.schema(events.schema).parquet(arrivals), minutes, delay, out, state))
    return job_state.read(spark, out)
