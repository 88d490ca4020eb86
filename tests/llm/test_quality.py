import math
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from glossaleaf.llm import quality
from glossaleaf.llm.queries import op10_quality_rules

from .conftest import python_nodes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    times = Counter(windows)
    covered = {k + d for k, w in enumerate(windows) if times[w] > 1 for d in range(3)}
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def grams(text):
    words = WORD.findall(text or "")
    found = (f"{a[-3:]} {b[0]}" for a, b in zip(words, words[1:]))
    hashes = (xxhash.xxh64_intdigest(g, seed=42) for g in found)
    return [(h - (1 << 64) if h >> 63 else h) % quality.BUCKETS for h in hashes]


def scores(docs, trusted):
    corpus, target = Counter(), Counter()
    for i, t in docs:
        corpus.update(grams(t))
        if i in trusted:
            target.update(grams(t))
    n, m, rest = sum(corpus.values()), sum(target.values()), quality.SMOOTHING * quality.BUCKETS

    def weight(g):
        return math.log((target[g] + 1) / (m + rest)) - math.log((corpus[g] + 1) / (n + rest)) if m else 0.0

    return {t: sum(map(weight, grams(t))) / max(len(grams(t)), 1) for _, t in docs}


def check(rows, docs, trusted):
    want = scores(docs, trusted)
    by_text = {(str(i), *counts(t), round(want[t], 4)) for i, t in docs}
    assert len(rows) == len(docs)
    for r in rows:
        mine = (str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        near = [x for x in by_text if x[:-1] == mine and abs(x[-1] - r.score) < 1e-3]
        assert near, (mine, r.score)
        assert r.kept == (not r.base_failed and r.score >= quality.THRESHOLD)


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    trusted = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").collect()}
    check(op10_quality_rules(spark, sf_dir).collect(), docs, trusted)


def test_labelled_junk_goes_and_clean_documents_stay(spark):
    rows = op10_quality_rules(spark, "/root/testdata/sf0.1").join(
        spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "quality"), "doc_id"
    ).filter("not base_failed").collect()
    clean = [r for r in rows if r.quality == 1]
    junk = [r for r in rows if r.quality == 0]
    assert all(r.kept for r in clean)
    assert sum(not r.kept for r in junk) > 0.9 * len(junk)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1) for i in range(10, 30)] + [(5, 0), (None, 1), (3, None)], "doc_id long, quality int")


def test_messy(messy, messy_rows, labels):
    check(quality.judge(messy, labels).collect(), [r[:2] for r in messy_rows], set(range(10, 30)))


def test_kept_rows(messy, labels):
    kept = quality.kept_rows(messy, labels, threshold=-5.0)
    assert kept.columns == messy.columns
    assert kept.count() == quality.judge(messy, labels, threshold=-5.0).filter("kept").count() > 0


def test_many_trusted_ids_with_and_without_broadcast(spark):
    docs = spark.range(30_500).selectExpr("if(id < 500, null, id) as doc_id", "concat('word', id % 97, ' other', id % 31, ' third') as text")
    labels = spark.range(500, 30_500).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    ids = quality.trusted(labels)
    assert ids.count() == 30_000
    small = quality.weights(docs, ids).first()
    known = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert quality.weights(docs, ids).first() == small
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known)
    some = quality.weights(docs, quality.trusted(labels, 20_000)).first()
    assert some != small


def test_bound_of_trusted_rows(labels):
    assert quality.trusted(labels, 7).count() == 7
    assert quality.trusted(labels, 100).count() == 20


def test_without_labels_or_documents(messy, empty, labels):
    rows = quality.judge(messy, labels.limit(0)).collect()
    assert all(r.score == 0 and r.kept == (not r.base_failed) for r in rows)
    assert quality.judge(empty, labels).count() == 0


def test_native(messy, labels):
    assert python_nodes(quality.judge(messy, labels)) == [] and python_nodes(quality.kept_rows(messy, labels)) == []


@pytest.mark.parametrize("is_labelled", [True, False])
def test_copies_of_a_clean_document_do_not_reject_it(spark, is_labelled):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{path}/labels.parquet")
    first = quality.judge(docs, labels).filter("kept and n_words > 100")
    clean = first.join(labels.filter("quality = 1"), "doc_id").orderBy("doc_id").first()
    text = docs.filter(docs.doc_id == clean.doc_id).first().text
    if not is_labelled:
        docs, labels = docs.filter(docs.text != text), labels.filter(labels.doc_id != clean.doc_id)
    n = docs.count() // 2  # a third of all rows
    copies = spark.createDataFrame([(text,)], "text string").crossJoin(spark.range(10**9, 10**9 + n)).select(F.col("id").alias("doc_id"), "text")
    rows = quality.judge(docs.unionByName(copies), labels).collect()
    assert sum(r.kept for r in rows if r.doc_id >= 10**9) == n
    # and they move no other verdict
    without = {r.doc_id: r.kept for r in quality.judge(docs, labels).collect()}
    assert {r.doc_id: r.kept for r in rows if r.doc_id < 10**9} == without
    assert quality.kept_rows(docs.unionByName(copies), labels).filter("doc_id >= 1000000000").count() == n


def test_ids_meet_digests_without_ngrams(spark, messy, labels):
    known = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = quality.weights(messy, quality.trusted(labels))._jdf.queryExecution().optimizedPlan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known)
    joined = plan.toString().split("Join Inner")[1].split("Union")[0].split("Join")[0]
    assert "grams" not in joined
