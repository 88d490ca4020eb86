import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossaleaf.llm import collocations
from tests.llm.conftest import python_nodes

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least=10, best=2000):
    """By the definition, with Python's whole numbers."""
    grams, size = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            size[lang] += len(words)
            counts = grams.setdefault(lang, Counter())
            for k in (1, 2, 3):
                counts.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in grams.items():
        often = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        hidden = {g[i : i + 2] for g, b in often.items() if len(g) == 3 for i in (0, 1) if 100 * b >= 50 * often[g[i : i + 2]]}
        found = []
        for g, a in often.items():
            if g in hidden:
                continue
            cuts = [(1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g))]
            score, _, left, right = min(cuts)
            found.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, size[lang], -score))
    return sorted(out)


def got(df, **options):
    return sorted(tuple(r[c] for c in COLUMNS) for r in collocations.collocations(df, **options).collect())


def texts(rng, n):
    words = "the of THE tall house Über über runs\x1con a\x01b a!b x;y, . 42 \t\t é \x0b z \x85nel".split(" ")
    return [(rng.choice(["en", "fr", None, "de"]), " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for _ in range(n)]


@pytest.mark.parametrize("chunk, width", [(1_000_000, 2_000_000), (50, 40)])
def test_against_counting(spark, monkeypatch, chunk, width):
    """Also with many small chunks and ranges, so that runs of one prefix are cut."""
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    monkeypatch.setattr(collocations, "RANGE", width)
    rows = texts(random.Random(7), 300) + [("en", None), ("en", ""), (None, "a a a a a a a a a a a a")]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    want = brute(rows)
    assert len(want) > 100
    assert got(df) == want


def test_options_and_ties(spark):
    rows = [("en", "b a. c d. d c. a b. e f g")] * 3 + [("fr", "a b")] * 2
    df = spark.createDataFrame(rows, "lang string, text string")
    assert got(df, least=2, best=3) == brute(rows, 2, 3)
    assert [r[2] for r in got(df, least=3, best=4)] == ["e f g", "a b", "b a", "c d"]


def test_covered_pairs_go(spark):
    rows = [("en", "new york city")] * 10 + [("en", "york city")] * 11 + [("en", "new york")] * 10
    phrases = [r[2] for r in got(spark.createDataFrame(rows, "lang string, text string"))]
    # 10 of 20 is half, 10 of 21 is less
    assert "new york" not in phrases and "york city" in phrases and "new york city" in phrases


def test_products_beyond_64_bits(spark):
    df = spark.createDataFrame([(10**12, 10**12 + 1, 3 * 10**12)], "a long, l long, r long")
    score = df.select(collocations._score(F.col("a"), F.col("l"), F.col("r")).alias("s")).first()["s"]
    assert score == 1_000_000 * 10**24 // ((10**12 + 1) * 3 * 10**12)


def test_many_different_words_in_a_chunk():
    """Ranks that do not fit together into 64 bits are sorted column by column."""
    rng = np.random.default_rng(2)
    w = [rng.integers(0, 5, 999) for _ in range(3)]
    *keys, n = collocations._summed(*w, np.ones(999, np.int64))
    want = Counter(zip(*[x.tolist() for x in w]))
    assert list(zip(*[x.tolist() for x in keys])) == sorted(want)
    assert n.tolist() == [want[k] for k in sorted(want)]


def test_streams_round_trip():
    rows = np.zeros(1000, collocations.STREAM)
    rows["w1"], rows["n"] = np.arange(1000) * 7, 3
    assert (collocations._unpacked(collocations._packed(rows), 1000) == rows).all()
    assert collocations._streams(pa.table({}), pa.table({}), 0.0, 5).num_rows == 0


def test_messy_and_long(spark, messy, messy_rows):
    rows = [(r[2], r[1]) for r in messy_rows]
    assert got(messy) == brute(rows)


def test_empty_table_and_plan(spark, empty):
    assert got(empty) == []
    found = collocations.collocations(empty.limit(0))
    assert not {"CartesianProduct", "BroadcastNestedLoopJoin"} & set(python_nodes(found))
