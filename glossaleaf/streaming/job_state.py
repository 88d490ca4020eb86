"""Job states kept by a stream, with timers: a job without an end becomes an error after a time.

The state of a job is its latest event. A repeated or older event changes nothing. While a job is processing a timer
runs in event time; when the watermark passes it, the job ends as an error. An end that arrives later
still counts.

Jobs are dealt into buckets by a hash, and a bucket's jobs are kept and stepped together, with one timer for the first
of them that is due: a call into Python costs milliseconds, a job in it microseconds. A job that has ended
before the watermark is forgotten, as whatever may still come of it is later and counts anyway; so a bucket holds the
running jobs and those of the last ``delay``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from glossaleaf.operators import store

RUNNING = "processing"
COLUMNS = ["job_id", "at_ms", "diary_id", "status", "message"]
CHANGE = "job_id string, at_ms long, diary_id string, status string, message string"
# the same by column, a value per job
KEPT = "job_id array<string>, at_ms array<long>, diary_id array<string>, status array<string>, message array<string>"
BUCKETS = 4_096


def stuck_message(minutes: int) -> str:
    return f"no end within {minutes} minutes"


def changes(events: DataFrame, minutes: int, delay: str, buckets: int = BUCKETS) -> DataFrame:
    """A stream of (job_id, at_ms, diary_id, status, message): each job's state whenever it has changed.

    ``events`` has the columns of ``STATUS_EVENTS``. ``delay`` is how late an event may come; one that is
    later is dropped. Of events of one millisecond an end counts before ``processing``, then the
    greater status and message. Give ``buckets`` so many that a bucket's running and recent jobs are a few
    thousand; the number is fixed once a checkpoint has begun.
    """
    limit = minutes * 60_000
    stuck = stuck_message(minutes)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = {row[0]: row[1:] for row in zip(*state.get)} if state.exists else {}
        before = dict(kept)
        for batch in batches:
            for job, *row in zip(*(batch[c] for c in COLUMNS)):
                now = kept.get(job)
                if now is None or _place(row) > _place(now) and (row[0] > now[0] or now[3] != stuck):
                    kept[job] = (int(row[0]), *row[1:])
        watermark = state.getCurrentWatermarkMs()
        due = None
        for job, now in kept.items():
            if now[2] != RUNNING:
                continue
            # the watermark may have passed the limit already
            if now[0] + limit < watermark:
                kept[job] = (now[0], now[1], "error", stuck)
            else:
                due = now[0] + limit if due is None else min(due, now[0] + limit)
        changed = [(job, *now) for job, now in kept.items() if now != before.get(job)]
        # later batches bring nothing from before the watermark
        held = [(job, *now) for job, now in kept.items() if now[2] == RUNNING or now[0] >= watermark]
        if held:
            state.update(tuple(list(column) for column in zip(*held)))
            if due is not None:
                state.setTimeoutTimestamp(max(due, watermark + 1))
        elif state.exists:
            state.remove()
        if changed:
            yield pd.DataFrame(changed, columns=COLUMNS)

    # a time with a zone, as watermarks need; milliseconds, as timers have
    at = F.col("ts").cast("timestamp")
    timed = events.withColumn("at", at).withColumn("at_ms", F.unix_millis(at)).withWatermark("at", delay)
    rows = timed.select("job_id", "at", "at_ms", "diary_id", "status", F.coalesce("message", F.lit("")).alias("message"))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int")).groupBy("bucket")
    return dealt.applyInPandasWithState(step, CHANGE, KEPT, "update", GroupStateTimeout.EventTimeTimeout)


def _place(row: Sequence) -> tuple:
    return row[0], row[2] != RUNNING, row[2], row[3]


def run(events: DataFrame, minutes: int, delay: str, out: str, checkpoint: str, buckets: int = BUCKETS):
    """Writes the changes of each micro-batch to a folder of its own, which a repeat replaces."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        changes(events, minutes, delay, buckets).writeStream.foreachBatch(write).outputMode("update")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read(spark: SparkSession, out: str) -> DataFrame:
    """The state of each job: its last change. A batch has one change of a job at most."""
    return store.latest_per_key(spark.read.parquet(out), "job_id", ["batch"]).select("job_id", "diary_id", "status", "message")

