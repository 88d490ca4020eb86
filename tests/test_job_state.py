"""Kept job states: stuck, late, repeated and revived jobs, over restarts."""

from datetime import datetime, timedelta

import pytest

from glossaleaf.schemas import STATUS_EVENTS
from glossaleaf.session import fresh_path
from glossaleaf.streaming import job_state

START = datetime(2024, 5, 1, 12)


class Stream:
    def __init__(self, spark):
        self.spark = spark
        self.arrivals, self.out, self.state = (fresh_path(spark, x) for x in ("events", "out", "state"))

    def arrive(self, *events):
        """(job, minute, status) rows; then the states so far."""
        rows = [(job, f"d-{job}", START + timedelta(minutes=at), status, "bad" if status == "error" else "") for job, at, status in events]
        self.spark.createDataFrame(rows, STATUS_EVENTS).coalesce(1).write.mode("append").parquet(self.arrivals)
        reader = self.spark.readStream.schema(STATUS_EVENTS).parquet(self.arrivals)
        job_state.run(reader, 30, "10 minutes", self.out, self.state).awaitTermination()
        return {r.job_id: (r.status, r.message) for r in job_state.read(self.spark, self.out).collect()}


STUCK = ("error", job_state.stuck_message(30))


@pytest.fixture
def stream(spark):
    return Stream(spark)


def test_stuck_and_ended_jobs(stream):
    got = stream.arrive(("a", 0, "processing"), ("b", 0, "processing"), ("b", 5, "completed"), ("c", 1, "error"), ("d", 70, "processing"))
    # the watermark is at minute 60: a has waited for more than 30, d has just begun
    assert got == {"a": STUCK, "b": ("completed", ""), "c": ("error", "bad"), "d": ("processing", "")}


def test_a_timer_fires_when_time_goes_on(stream):
    assert stream.arrive(("a", 0, "processing"), ("b", 20, "processing")) == {"a": ("processing", ""), "b": ("processing", "")}
    assert stream.arrive(("c", 45, "processing")) == {"a": STUCK, "b": ("processing", ""), "c": ("processing", "")}
    # an end that comes after all counts; a repeat of the start does not
    got = stream.arrive(("a", 50, "completed"), ("b", 20, "processing"))
    assert got["a"] == ("completed", "") and got["b"] == ("processing", "")


def test_repeated_and_older_events_change_nothing(stream):
    first = stream.arrive(("a", 10, "completed"), ("a", 8, "processing"), ("a", 10, "completed"))
    assert first == {"a": ("completed", "")}
    assert stream.arrive(("a", 9, "processing"), ("a", 10, "processing"), ("a", 1, "error")) == first


def test_an_end_of_the_same_moment_counts(stream):
    assert stream.arrive(("a", 10, "completed"), ("a", 10, "processing")) == {"a": ("completed", "")}


def test_jobs_share_few_states_and_ended_ones_are_forgotten(spark):
    arrivals, out, state = (fresh_path(spark, x) for x in ("events", "out", "state"))

    def arrive(jobs, minute, status):
        rows = [(f"j{n}", f"d{n}", START + timedelta(minutes=minute, seconds=n % 50), status, "") for n in jobs]
        spark.createDataFrame(rows, STATUS_EVENTS).write.mode("append").parquet(arrivals)
        reader = spark.readStream.schema(STATUS_EVENTS).parquet(arrivals)
        stream = job_state.run(reader, 30, "10 minutes", out, state, buckets=4)
        stream.awaitTermination()
        held = spark.read.format("statestore").load(state).select("value.groupState.job_id").collect()
        found = {r.job_id: r.status for r in job_state.read(spark, out).collect()}
        return found, len(held), sum(len(r.job_id) for r in held)

    first = {f"j{n}": "processing" for n in range(200)}
    assert arrive(range(200), 0, "processing") == (first, 4, 200)
    ended = first | {f"j{n}": "completed" for n in range(180)}
    assert arrive(range(180), 5, "completed") == (ended, 4, 200)
    # past the limit the last 20 are stuck; of all jobs only the new ones need to be known
    late = ended | {f"j{n}": "error" for n in range(180, 200)} | {f"j{n}": "processing" for n in range(200, 300)}
    found, states, jobs = arrive(range(200, 300), 60, "processing")
    assert found == late and states <= 4 and jobs == 100
    # an older event of a forgotten job changes nothing, a later one counts
    assert arrive(range(150, 200), 20, "processing")[0] == late
    assert arrive(range(190, 200), 61, "completed")[0] == late | {f"j{n}": "completed" for n in range(190, 200)}
