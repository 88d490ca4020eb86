import numpy as np
import pytest
from pyspark.sql import functions as F

from glossaleaf.operators import langid, memory, models, rewriting
from glossaleaf.sources import given


def brute_force(stored, k):
    found = {}
    for q in stored:
        near = sorted(
            (float(((np.array(q.embedding) - np.array(m.embedding)) ** 2).sum()), m.error_id)
            for m in stored
            if m.error_id != q.error_id and all(q[c] == m[c] for c in memory.SEARCH_KEYS)
        )
        found[q.error_id] = [i for _, i in near[:k]]
    return found


@pytest.fixture(scope="module")
def stored(spark, sf_dir):
    """The given vectors; a third of them copies in one group."""
    base = given.error_memory(spark, sf_dir)
    hot = F.col("error_id") % 3 == 0
    out = base.withColumn("language_diary_text", F.when(hot, "eng").otherwise(F.col("language_diary_text")))
    out = out.withColumn("language_annotation_text", F.when(hot, "fra").otherwise(F.col("language_annotation_text")))
    out = out.withColumn("model_id_embedding", F.when(hot, "model-0").otherwise(F.col("model_id_embedding")))
    copy = F.array_repeat(F.lit(0.125).cast("float"), 64)
    return out.withColumn("embedding", F.when(F.col("error_id") % 6 == 0, copy).otherwise(F.col("embedding")))


def hits(found):
    out = {}
    for r in found.sort("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.error_id)
    return out


def test_search_is_exact(stored, monkeypatch):
    monkeypatch.setattr(memory, "QUERY_BLOCK", 40)
    monkeypatch.setattr(memory, "MEMORY_BLOCK", 60)
    asked = stored.withColumnRenamed("error_id", "query_id")
    found = memory.similar_errors(asked, stored, k=5, exclude_same_id=True)
    want = {q: ids for q, ids in brute_force(stored.collect(), 5).items() if ids}
    assert hits(found) == want


def test_approximate_recall(stored):
    asked = stored.withColumnRenamed("error_id", "query_id")
    exact = hits(memory.similar_errors(asked, stored, k=10))
    near = hits(memory.similar_errors_approx(asked, stored, k=10))
    one_cell = hits(memory.similar_errors_approx(asked, stored, k=10, tables=1, bits=0))
    share = sum(len(set(exact[q]) & set(near.get(q, []))) for q in exact) / sum(map(len, exact.values()))
    assert one_cell == exact
    assert share > 0.9


def test_errors_without_a_vector_are_near_to_nothing(stored):
    no_vector = stored.withColumn("embedding", F.when(F.col("error_id") % 2 == 0, F.col("embedding")).otherwise(F.array().cast("array<float>")))
    asked = no_vector.withColumnRenamed("error_id", "query_id")
    for search in (memory.similar_errors, memory.similar_errors_approx):
        found = search(asked, no_vector, k=3).collect()
        assert found and all(r.query_id % 2 == r.error_id % 2 == 0 for r in found)


def test_labels_by_distance(spark):
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    nearest = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.0), (2, 1, 0.9)], "query_id long, rank int, distance double")
    got = {r.query_id: r.label for r in memory.label_by_distance(queries, nearest, 0.5).collect()}
    assert got == {1: "RECURRING", 2: "NEW", 3: "NEW"}


def test_recurring_and_new_split_the_errors(spark):
    schema = "language_annotation_text string, language_diary_text string, error_rule string, category string, n int"
    now = spark.createDataFrame([("eng", "fra", "r", "Grammar", 1), ("eng", "spa", "r", "Grammar", 2)], schema)
    past = spark.createDataFrame([("eng", "fra", "r", "Grammar", 0)] * 3, schema)
    assert [r.n for r in memory.recurring(now, past).collect()] == [1]
    assert [r.n for r in memory.fresh(now, past).collect()] == [2]


@pytest.mark.parametrize(
    "statuses, attempt",
    [
        (["xml_error", "success", "success"], 2),
        (["incorrect_language", "insufficient_length"], 2),
        (["xml_error"] * 7, 5),  # the fifth is the last one tried
        (["xml_error"] * 5 + ["success"], 5),
        (["incorrect_language"], 1),
    ],
)
def test_attempt_that_counts(spark, statuses, attempt):
    rows = [("e", i, s, f"text {i}") for i, s in enumerate(statuses, start=1)]
    df = spark.createDataFrame(rows, "entry string, attempt int, status string, rewriting string")
    got = rewriting.chosen_attempts(df, "entry").first()
    assert (got.attempt, got.rewriting) == (attempt, f"text {attempt}")


def test_model_failure_becomes_a_row(spark):
    def model(chats):
        if any("bad" in c for c in chats):
            raise RuntimeError("no answer")
        return [{"content": c.upper(), "finish_reason": "stop", "completion_tokens": 1} for c in chats]

    good = models.generate(spark.createDataFrame([("hi",)], "chat string"), model).first()
    mixed = models.generate(spark.createDataFrame([("bad",), ("ok",)], "chat string").coalesce(1), model).collect()
    bad = mixed[0]
    assert mixed[1].response == "OK"
    assert (good.response, good.finish_reason, good.completion_tokens, good.prompt_tokens, good.error) == ("HI", "stop", 1, None, None)
    assert (bad.response, bad.finish_reason, bad.error) == (None, "unknown", "no answer")


def test_embedding(spark):
    df = models.embed(spark.createDataFrame([("ab",)], "t string"), "t", lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert list(df.first().embedding) == [2.0, 1.0]


def test_one_bad_text_does_not_empty_its_call(spark):
    def model(texts):
        if "bad" in texts:
            raise RuntimeError("down")
        return [[float(len(t))] for t in texts]

    texts = spark.createDataFrame([(f"{'x' * i}",) for i in range(1, 10)] + [("bad",)], "t string").coalesce(1)
    rows = models.embed(texts, "t", model, empty_on_error=True).collect()
    assert {r.t: list(r.embedding) for r in rows} == {"x" * i: [float(i)] for i in range(1, 10)} | {"bad": []}


def test_too_few_answers_are_asked_again(spark):
    def short(chats):
        return [{"content": c} for c in chats[:1]]

    chats = spark.createDataFrame([("a",), ("b",), ("c",)], "chat string").coalesce(1)
    assert sorted(r.response for r in models.generate(chats, short).collect()) == ["a", "b", "c"]
    none = models.generate(chats, lambda chats: []).collect()
    assert [r.error for r in none] == ["0 answers to 1 chats"] * 3
    vectors = models.embed(chats, "chat", lambda texts: [[1.0]], empty_on_error=True).collect()
    assert [list(r.embedding) for r in vectors] == [[1.0]] * 3


def test_the_model_is_one_step_of_the_plan(spark):
    texts = spark.createDataFrame([("a",)], "t string")
    kept = models.embed(texts, "t", lambda texts: [[1.0] for _ in texts]).filter(F.size("embedding") > 0)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "ArrowEvalPython" not in plan


def test_embedding_failure(spark):
    def model(texts):
        raise RuntimeError("down")

    texts = spark.createDataFrame([("ab",)], "t string")
    assert models.embed(texts, "t", model, empty_on_error=True).first().embedding == []
    with pytest.raises(Exception, match="down"):
        models.embed(texts, "t", model).collect()


def test_recorded_answers(spark):
    asked = spark.createDataFrame([(1,), (2,)], "id int")
    answers = spark.createDataFrame([(1, "x")], "id int, response string")
    assert sorted(tuple(r) for r in models.recorded(asked, answers, "id").collect()) == [(1, "x"), (2, None)]


def test_language_identification_on_held_out_texts(spark, sf_dir):
    texts = given.base(spark, sf_dir).withColumn("part", F.crc32("text") % 5)
    train, test = texts.filter("part <> 0"), texts.filter("part = 0")

    def accuracy(profile):
        found = langid.detect(test, "doc_id", "text", profile).join(test, "doc_id")
        return found.agg(F.avg((F.col("detected_language") == F.col("language_source")).cast("int"))).first()[0]

    mixed = train.withColumn("language_source", F.element_at(F.array(*map(F.lit, given.CODES.values())), (F.col("doc_id") % 4 + 1).cast("int")))
    assert accuracy(langid.train(train, "text", "language_source")) > 0.9
    assert accuracy(langid.train(mixed, "text", "language_source")) < 0.7


def test_short_and_long_texts(spark, sf_dir, monkeypatch):
    texts = given.base(spark, sf_dir)
    profile = langid.train(texts, "text", "language_source")
    some = texts.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, "ab"), (-2, ""), (-3, None), (-4, "😀😀é"), (-5, "le 😀 la")], "doc_id long, text string"))
    found = {r[0]: r[1] for r in langid.detect(some, "doc_id", "text", profile).collect()}
    assert found[-1] is None and found[-2] is None and found[-3] is None and found[-4] is not None
    # a profile in slices and texts in pieces give the same
    monkeypatch.setattr(langid, "WEIGHTS_AT_ONCE", 500)
    sliced = langid.train(texts, "text", "language_source")
    assert {r[0]: r[1] for r in langid.detect(some, "doc_id", "text", sliced).collect()} == found


def test_equal_vectors_are_searched_once(spark, stored):
    """The exact hits also where vectors, texts and whole rows come many times."""
    few = F.transform("embedding", lambda x: F.round(x).cast("float"))
    again = stored.withColumn("embedding", F.slice(few, 1, 2)).select("error_id", "embedding", *memory.SEARCH_KEYS)
    asked = again.withColumnRenamed("error_id", "query_id")
    found = memory.similar_by_vector(asked, again, 4)
    want = {(r.query_id, r.error_id): r.distance for r in memory.similar_errors(asked, again, 4).collect()}
    assert {(r.query_id, r.error_id): r.distance for r in found.collect()} == want
    vectors = asked.select("embedding", *memory.SEARCH_KEYS).distinct().count()
    searched = {f.rsplit("/", 1)[0] for f in found.inputFiles() if "/vectors-" in f}
    assert len(searched) == 1 and spark.read.parquet(*searched).count() == vectors < asked.count()
    twice = memory.similar_by_vector(asked.union(asked), again.union(again), 4)
    # of four rows all are one error's
    assert twice.groupBy("query_id").count().filter("count > 1").count() == 0
