"""The stored index and the search with pivots, against the plain exact search."""

import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossaleaf.operators import memory, pivot_search, vector_index
from glossaleaf.session import fresh_path
from glossaleaf.sources import given

GROUP = ["g"]


@pytest.fixture(scope="module")
def clustered(spark):
    """40 far-apart clusters of 30 vectors in one group, a second group of copies, and rows without a vector."""
    rng = np.random.default_rng(5)
    heads = rng.normal(size=(40, 16)) * 20
    rows = [(i, "a", (heads[i % 40] + rng.normal(size=16)).tolist()) for i in range(1200)]
    rows += [(2000 + i, "b", [1.0] * 16) for i in range(50)] + [(3000, "a", []), (3001, "b", None)]
    return spark.createDataFrame(rows, "error_id long, g string, embedding array<float>").cache()


def as_queries(stored):
    return stored.withColumnRenamed("error_id", "query_id")


def rows(found):
    return sorted((r.query_id, r["rank"], r.error_id, round(r.distance, 4)) for r in found.collect())


@pytest.fixture(scope="module")
def exact(clustered):
    return rows(memory.similar_errors(as_queries(clustered), clustered, 5, GROUP, exclude_same_id=True))


def test_pivots_give_the_exact_rows_and_save_blocks(clustered, exact):
    known = pivot_search.plan(as_queries(clustered), clustered, 5, GROUP, True, 40, 32)
    assert rows(pivot_search.found(known, 5, True)) == exact
    asked, every = known.pairs()
    # a pivot in each cluster: of some forty blocks of the group a query asks a few
    assert asked * 4 < every
    blocks = known.blocks.agg(F.sum("n"), F.max("n")).first()
    assert blocks[0] == 1250 and blocks[1] <= 3 * 32


@pytest.mark.parametrize("k, size", [(1, 8), (60, 64), (2000, 100)])
def test_pivots_for_any_k(clustered, k, size):
    few = as_queries(clustered).filter("query_id % 9 = 0")
    want = rows(memory.similar_errors(few, clustered, k, GROUP))
    assert rows(pivot_search.similar_errors(few, clustered, k, GROUP, pivots=5, size=size)) == want


def test_pivots_on_the_given_vectors(spark, sf_dir):
    stored = given.error_memory(spark, sf_dir)
    want = rows(memory.similar_errors(as_queries(stored), stored, 4, exclude_same_id=True))
    assert rows(pivot_search.similar_errors(as_queries(stored), stored, 4, exclude_same_id=True, size=10)) == want


def test_vectors_of_several_lengths(spark):
    data = [(i, str(n), [float(i * j % 7) for j in range(n)]) for n in (3, 5) for i in range(n, 90, n)]
    stored = spark.createDataFrame(data, "error_id long, g string, embedding array<float>").dropDuplicates(["error_id"])
    want = rows(memory.similar_errors(as_queries(stored), stored, 3, GROUP))
    assert rows(pivot_search.similar_errors(as_queries(stored), stored, 3, GROUP, pivots=4, size=6)) == want


def test_empty_sides(clustered):
    none = clustered.limit(0)
    assert pivot_search.similar_errors(as_queries(clustered), none, 3, GROUP).count() == 0
    assert pivot_search.similar_errors(as_queries(none), clustered, 3, GROUP).count() == 0


@pytest.fixture(scope="module")
def index(spark, clustered):
    path = fresh_path(spark, "index")
    vector_index.create(clustered, path, lists=40, parts=4, sample=600)
    vector_index.append(path, clustered.filter("error_id % 3 = 0"), GROUP)
    before = set(vector_index.stored(spark, path).inputFiles())
    vector_index.append(path, clustered.filter("error_id % 3 <> 0"), GROUP)
    assert before < set(vector_index.stored(spark, path).inputFiles())
    return path


def test_index_holds_every_vector_once(spark, index, clustered):
    kept = vector_index.stored(spark, index)
    assert sorted(r.error_id for r in kept.collect()) == sorted(r.error_id for r in clustered.filter("size(embedding) > 0").collect())
    assert {len(r.code) for r in kept.collect()} == {4}


def test_index_recall_with_few_lists(spark, index, clustered):
    asked = as_queries(clustered).filter("g = 'a'")
    want = memory.similar_errors(asked, clustered, 5, GROUP, exclude_same_id=True)
    got = vector_index.search(index, asked, 5, probes=3, group=GROUP, exclude_same_id=True)
    found = vector_index.recall(got, want).first()
    assert found.n_exact == 6000 and found.n_found >= 0.95 * found.n_exact


def test_index_with_all_lists_is_exact(index, clustered, exact):
    got = vector_index.search(index, as_queries(clustered), 5, probes=99, again=400, group=GROUP, exclude_same_id=True)
    assert rows(got) == exact


def test_search_reads_the_asked_lists_only(spark, index, clustered):
    codes = vector_index.stored(spark, index, [7]).select("error_id", "code")
    plan = codes._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*list#\d+ = 7", plan)
    assert "embedding" not in plan.split("ReadSchema:")[1]
    one = as_queries(clustered).filter("query_id = 1")
    found = vector_index.search(index, one, 3, probes=2, group=GROUP)
    plan = found._jdf.queryExecution().executedPlan().toString()
    asked = re.findall(r"PartitionFilters: \[[^]]*list#\d+ IN \(([\d,]+)\)", plan)
    assert asked and all(len(x.split(",")) == 2 for x in asked)


def test_index_refuses_what_it_cannot_hold(spark, clustered):
    with pytest.raises(ValueError, match="divide"):
        vector_index.fit(clustered, 3, parts=5)
    with pytest.raises(ValueError, match="no vector"):
        vector_index.fit(clustered.limit(0), 3)


def test_only_the_nearest_leave_a_list(index, clustered):
    found = vector_index.search(index, as_queries(clustered), 5, probes=99, again=400, group=GROUP)
    after_scan = found._jdf.queryExecution().executedPlan().toString().split("FlatMapCoGroupsInPandas")[0]
    assert "Join" not in after_scan and "rank" in after_scan


def test_distances_are_held_a_few_at_a_time():
    """Blocks of the largest size, and long vectors, in arrays of bounded size."""
    rng = np.random.default_rng(3)
    for n, dims in ((memory.MEMORY_BLOCK, 64), (600, 1024)):
        stored, asked = rng.normal(size=(n, dims)), rng.normal(size=(memory.QUERY_BLOCK, dims))
        tracemalloc.start()
        found = memory.nearest(np.arange(len(asked)), asked, np.arange(n), stored, 10)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(found) == 10 * len(asked) and most < 60e6
        away = ((stored - asked[77]) ** 2).sum(axis=1)
        assert found[found.query_id == 77].error_id.tolist() == np.argsort(away)[:10].tolist()


def sent(found):
    """Rows that were sent to the pairs of blocks, by side."""
    found.collect()

    def below(node):
        yield node
        for i in range(node.children().size()):
            yield from below(node.children().apply(i))

    scan = next(n for n in below(found._jdf.queryExecution().executedPlan()) if n.nodeName() == "FlatMapCoGroupsInPandas")
    sides = [scan.children().apply(i) for i in range(2)]
    exchanges = [next(n for n in below(side) if n.nodeName() == "Exchange") for side in sides]
    return [e.metrics().apply("shuffleRecordsWritten").value() for e in exchanges]


def test_no_row_is_sent_twice_to_a_group_that_a_task_can_hold(spark, monkeypatch):
    """10,000 rows of one group: each goes once, or once for each list that it asks."""
    numbers = F.array(F.rand(1).cast("float"), F.rand(2).cast("float"))
    stored = spark.range(10_000).select(F.col("id").alias("error_id"), F.lit("a").alias("g"), numbers.alias("embedding")).cache()
    path = fresh_path(spark, "index")
    vector_index.create(stored, path, lists=2, parts=1)
    vector_index.append(path, stored, GROUP)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        assert sent(memory.similar_errors(as_queries(stored), stored, 1, GROUP)) == [10_000, 10_000]
        assert sent(vector_index.search(path, as_queries(stored), 1, probes=2, group=GROUP)) == [20_000, 10_000]
        # but no task gets more numbers than it can hold
        monkeypatch.setattr(memory, "BLOCK_NUMBERS", 10_000)
        assert sent(memory.similar_errors(as_queries(stored).filter("query_id < 10"), stored, 1, GROUP)) == [20, 10_000]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", True)


def test_long_vectors_make_small_blocks(spark):
    blocks = [memory.block_count(memory.QUERY_BLOCK, F.lit(n)).alias(str(n)) for n in (2, 64, 1024, 1 << 23)]
    assert list(spark.range(32_000).agg(*blocks).first()) == [1, 1, 8, 32_000]


def test_a_list_of_several_choices_chooses_for_each(spark, monkeypatch):
    """Lists cut into smaller choices are re-ranked from more codes, never fewer."""
    rng = np.random.default_rng(2)
    data = [(i, "a", v.tolist()) for i, v in enumerate(rng.normal(size=(900, 8)))]
    stored = spark.createDataFrame(data, "error_id long, g string, embedding array<float>").cache()
    path = fresh_path(spark, "index")
    vector_index.create(stored, path, lists=1, parts=2, sample=300)
    vector_index.append(path, stored, GROUP)
    asked = as_queries(stored).filter("query_id < 100")
    want = memory.similar_errors(asked, stored, 5, GROUP)

    def hits():
        got = vector_index.search(path, asked, 5, probes=1, again=1, group=GROUP)
        return vector_index.recall(got, want).first().n_found

    few = hits()
    monkeypatch.setattr(vector_index, "CHOICE", 90)
    assert few < 500 and hits() > few
    monkeypatch.setattr(vector_index, "CHOICE", 5)
    assert hits() == 500
