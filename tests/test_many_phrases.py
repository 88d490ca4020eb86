"""Many phrases at once give what one search after the other gives, in time in proportion."""

import random
import time

import pytest
from pyspark.sql import functions as F

from glossaleaf.functions import text
from glossaleaf.operators import translation


def plain_spans(body, phrases):
    out = []
    for p in phrases:
        at = body.find(p) if p else -1
        again = body.find(p, at + len(p)) if at >= 0 else -1
        out.append((at, at + len(p)) if at >= 0 and again < 0 else None)
    return out


def plain_replace(body, old, new):
    for o, n in zip(old, new):
        body = body.replace(o, n) if o else body
    return body


def test_spans_against_one_by_one(spark):
    rng = random.Random(2)
    words = ["a", "aa", "ab", "aba", "é", "😀b", "", "b c", "zz", "bab"]
    rows = [("".join(rng.choice(["a", "b", "é", "😀", " ", "c"]) for _ in range(rng.randrange(60))), rng.choices(words, k=rng.randrange(40))) for _ in range(200)]
    rows += [(None, ["a"] * 30), ("abc", None), ("abc", []), ("", ["a"] * 20)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, b string, p array<string>").repartition(3)
    got = {r["i"]: r["s"] for r in df.select("i", text.single_spans(F.col("b"), F.col("p")).alias("s")).collect()}
    for i, (body, phrases) in enumerate(rows):
        want = None if body is None or phrases is None else plain_spans(body, phrases)
        found = None if got[i] is None else [None if s is None else (s["start"], s["end"]) for s in got[i]]
        assert found == want, (body, phrases)


def test_replacement_against_one_by_one():
    rng = random.Random(3)
    bits = ["[a]", "[b c]", "[é]", "x", " ", "[", "]", "[[a]", "a", "[a][b c]"]
    for _ in range(3000):
        body = "".join(rng.choices(bits, k=rng.randrange(12)))
        n = rng.randrange(6)
        old = rng.choices(["[a]", "[b c]", "[é]", "a", "", "[x [a]", "x"], k=n)
        new = rng.choices(["u", "", "[b c]", "[", "a", "vw"], k=n)
        assert text.replace_all(body, old, new) == plain_replace(body, old, new), (body, old, new)


@pytest.mark.parametrize("work", ["spans", "replace"])
def test_time_grows_in_proportion(work):
    def seconds(n):
        words = [f"w{i}x" for i in range(n)]
        body = " ".join(f"[{w}] t" for w in words)
        best = 9.0
        for _ in range(3):
            start = time.perf_counter()
            if work == "spans":
                assert all(text._only_spans(body, words))
            else:
                text.replace_all(body, [f"[{w}]" for w in words], words)
            best = min(best, time.perf_counter() - start)
        return best

    # twice the phrases in twice the text: twice the time, where a search for each would take four times
    assert seconds(16_000) < 3.2 * seconds(8_000)


def test_many_phrases_in_one_long_draft(spark):
    n = 8_000
    draft = " ".join(f"[word{i}x] is" for i in range(n))
    answer = "".join(f"<bracket>[word{i}x]</bracket><translation>mot{i}y</translation>" for i in range(n))
    df = spark.createDataFrame([(draft, answer)], "draft string, response string")
    got = translation.translate(df).select("translate_status", F.size("spans").alias("n"), "draft_replaced").first()
    assert (got.translate_status, got.n) == ("ok", n)
    assert got.draft_replaced == " ".join(f"mot{i}y is" for i in range(n))
