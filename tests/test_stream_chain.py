"""The chain as a stream: a stop between two tables, a repeat after the commit, keys across batches."""

import pytest
from pyspark.sql import functions as F

from glossaleaf.plans import queries
from glossaleaf.session import fresh_path
from glossaleaf.sources import given
from glossaleaf.streaming import chain


def rows(df):
    return sorted(str(r) for r in df.select(*sorted(df.columns)).collect())


@pytest.fixture(scope="module")
def batch_chain(spark, sf_dir):
    return queries._chain(spark, sf_dir)


class Stopping:
    """An analysis whose table cannot be read."""

    def __init__(self, result, name):
        self.result, self.name = result, name

    def __getattr__(self, name):
        if name == self.name:
            raise RuntimeError(f"stopped before {name}")
        return getattr(self.result, name)


def stream(spark, arrivals, schema):
    return spark.readStream.schema(schema).parquet(arrivals)


def test_stop_between_two_tables_and_repeats(spark, sf_dir, batch_chain):
    arrivals, out, state = (fresh_path(spark, x) for x in ("in", "out", "state"))
    all_rows = given.submissions_with_repeats(spark, sf_dir)
    again = F.col("job_id").endswith("-again")
    stops = ["errors_rejected", "entries", None]

    def analyse(submissions, stored):
        result = queries._chain(spark, sf_dir, submissions, stored)
        stop = stops.pop(0) if stops else None
        return Stopping(result, stop) if stop else result

    def go():
        query = chain.run(stream(spark, arrivals, all_rows.schema), analyse, out, state)
        query.awaitTermination()

    all_rows.filter(~again).write.mode("append").parquet(arrivals)
    # some tables of the batch are there, none is seen
    with pytest.raises(Exception, match="stopped before errors_rejected"):
        go()
    assert spark.read.parquet(f"{out}/entries").count() > 0
    with pytest.raises(ValueError, match="no batch"):
        chain.committed(spark, out, "entries")
    with pytest.raises(Exception, match="stopped before entries"):
        go()
    go()
    all_rows.filter(again).write.mode("append").parquet(arrivals)
    go()
    assert chain.commits(spark, out).count() == 2
    for name in chain.TABLES:
        if name == "past":  # no embedding model was given
            assert batch_chain.past is None
            continue
        assert rows(chain.committed(spark, out, name)) == rows(getattr(batch_chain, name)), name


def test_a_repeat_after_the_commit_writes_nothing(spark, sf_dir):
    arrivals, out = fresh_path(spark, "in"), fresh_path(spark, "out")
    some = given.submissions_with_repeats(spark, sf_dir)
    some.write.parquet(arrivals)
    calls = []

    def analyse(submissions, stored):
        calls.append(1)
        return queries._chain(spark, sf_dir, submissions, stored)

    for _ in range(2):
        # a new checkpoint: the same batch number comes again, as after a lost one
        chain.run(stream(spark, arrivals, some.schema), analyse, out, fresh_path(spark, "state")).awaitTermination()
    assert len(calls) == 1
    assert chain.committed(spark, out, "status").count() == queries.chain_status(spark, sf_dir).count()


def test_later_batches_remember_the_errors_of_earlier_ones(spark, sf_dir):
    arrivals, out, state = (fresh_path(spark, x) for x in ("in", "out", "state"))
    rows_of_all = given.submissions(spark, sf_dir)
    late = F.pmod(F.xxhash64("job_id"), F.lit(2)) == 0
    seen = []

    def analyse(submissions, stored, remembered):
        seen.append({r.page_content for r in remembered.collect()})
        return queries._chain(spark, sf_dir, submissions, stored, embed=queries.letter_counts, remembered=remembered)

    for part in (rows_of_all.filter(~late), rows_of_all.filter(late)):
        part.write.mode("append").parquet(arrivals)
        chain.run(stream(spark, arrivals, rows_of_all.schema), analyse, out, state, remember=True).awaitTermination()
    first = spark.read.parquet(f"{out}/errors").filter("batch = 0")
    assert seen[0] == set() and seen[1] == {r.page_content for r in first.collect()} != set()
    # what a later entry is told comes from the earlier batch alone
    told = spark.read.parquet(f"{out}/past").filter("batch = 1").select(F.explode("past").alias("t")).distinct().collect()
    assert told and {r.t for r in told} <= seen[1]
    assert chain.committed(spark, out, "errors").count() == queries.chain_errors(spark, sf_dir).count()
