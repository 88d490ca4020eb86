import zlib

import pytest
from pyspark.sql import functions as F

from glossaleaf.llm import toxicity
from glossaleaf.llm.queries import op5_toxicity


def test_held_out_accuracy(spark):
    rows = op5_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    held = rows.filter("held_out").collect()
    right = sum(r.predicted == r.toxic for r in held)
    toxic = [r for r in held if r.toxic]
    clean = [r for r in held if not r.toxic]
    assert right / len(held) > 0.96
    assert sum(r.predicted for r in toxic) >= 0.88 * len(toxic)
    assert sum(r.predicted for r in clean) < 0.01 * len(clean)


def test_fit_against_plain_loops(spark):
    """The same features and steps, one document and one feature at a time."""
    import math
    import random

    import numpy as np

    rng = random.Random(6)
    words = "you are an idiot nice day the house red fool".split()
    texts = [" ".join(rng.choices(words, k=12)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    known = [(i, int("idiot" in t or "fool" in t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bias, weights = toxicity.fit(docs, spark.createDataFrame(known, "doc_id long, toxic int"))

    used = [i for i, _ in known if zlib.crc32(str(i).encode()) % 5]
    used.sort(key=str)
    every = np.ones(toxicity.BUCKETS, bool)
    have = {i: sorted({int(b) for _, part in toxicity.present([texts[i]], every) for b in part}) for i in used}
    label = dict(known)
    n = [sum(label[i] == k for i in used) for k in (0, 1)]
    seen = {}
    for i in used:
        for b in have[i]:
            seen.setdefault(b, [0, 0])[label[i]] += 1
    ratio = {b: math.log((c[1] + 1) / (n[1] + 2)) - math.log((c[0] + 1) / (n[0] + 2)) for b, c in seen.items() if sum(c) >= 3}
    ratio = {b: r for b, r in ratio.items() if abs(r) >= toxicity.LEAST_RATIO}
    w, square = dict.fromkeys(ratio, 0.0), dict.fromkeys(ratio, 1e-8)
    b0, b_square = math.log((n[1] + 0.5) / (n[0] + 1)), 1e-8
    total = n[0] + toxicity.TOXIC_WEIGHT * n[1]
    for _ in range(toxicity.STEPS):
        step, b_step = {b: toxicity.DECAY * w[b] for b in w}, 0.0
        for i in used:
            z = b0 + sum(w[b] * ratio[b] for b in have[i] if b in ratio)
            error = (1 / (1 + math.exp(-z)) - label[i]) * (toxicity.TOXIC_WEIGHT if label[i] else 1.0) / total
            b_step += error
            for b in have[i]:
                if b in ratio:
                    step[b] += ratio[b] * error
        for b in w:
            square[b] += step[b] ** 2
            w[b] -= toxicity.RATE * step[b] / math.sqrt(square[b])
        b_square += b_step**2
        b0 -= toxicity.RATE * b_step / math.sqrt(b_square)
    assert ratio and abs(bias - b0) < 1e-6
    assert set(np.flatnonzero(weights).tolist()) == {b for b in ratio if w[b]}
    assert all(abs(weights[b] - w[b] * ratio[b]) < 1e-6 for b in ratio)


def test_repeated_ids_do_not_widen_the_sample(spark):
    docs = spark.createDataFrame([(i % 10, f"text {i}") for i in range(200)], "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, toxic int")
    assert toxicity._labelled(docs, known, "text", 4).count() == 4


def test_features_do_not_depend_on_grouping(monkeypatch):
    import numpy as np

    texts = ["", "ab", "the quick  brown\nfox", "x" * 50, "ÄÖ ü", "the quick brown fox"] * 3
    every = np.ones(toxicity.BUCKETS, bool)

    def by_text(parts):
        out = {i: [] for i in range(len(texts))}
        for owner, buckets in parts:
            for o, b in zip(owner.tolist(), buckets.tolist()):
                out[o].append(b)
        return out

    together = by_text(toxicity.present(texts, every))
    alone = {i: by_text(toxicity.present([t], every))[0] for i, t in enumerate(texts)}
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    blocks = by_text(toxicity.present(texts, every))
    assert together == alone == blocks
    assert together[2] == together[5] != []


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (7, None)], "doc_id long, toxic int")


def test_messy(spark, messy, messy_rows, labels):
    rows = toxicity.score(messy, labels).collect()
    assert len(rows) == len(messy_rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    for r in rows:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)


def test_same_text_same_score_whatever_else_is_in_the_row(messy, labels):
    rows = toxicity.score(messy, labels).filter("doc_id = 12").collect()
    assert len({r.score for r in rows}) <= 2


def test_held_out_labels_are_not_learned(spark, labels, messy):
    def scores(known):
        return sorted((str(r.doc_id), r.score) for r in toxicity.score(messy, known).collect())

    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert scores(labels) == scores(flipped)


def test_without_labels_or_documents(spark, messy, empty, labels):
    none = labels.limit(0)
    assert {r.predicted for r in toxicity.score(messy, none).collect()} == {0}
    assert toxicity.score(empty, labels).count() == 0
