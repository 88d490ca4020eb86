import random
import re

import pytest

from glossaleaf.llm import mixing

from .conftest import python_nodes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shared(sizes, weights, total, most):
    """Shares by weight, again and again, until none is above its limit."""
    target, open_ = {}, dict(weights)
    while open_:
        left = total - sum(target.values())
        level = left / sum(open_.values())
        over = [s for s in open_ if level * open_[s] >= most * sizes[s]]
        if not over:
            return target | {s: level * w for s, w in open_.items()}
        for s in over:
            target[s] = most * sizes[s]
            del open_[s]
    return target


def highest_quotients(weights, seats):
    won = {k: 0 for k in weights}
    for _ in range(seats):
        best = max(sorted(weights), key=lambda k: (weights[k] / (2 * won[k] + 1), -list(sorted(weights)).index(k)))
        won[best] += 1
    return won


def test_targets(spark):
    rng = random.Random(8)
    for _ in range(4):
        sizes = {f"s{i:02}": rng.choice([0, 3, 50, 400, 9000]) for i in range(rng.randrange(1, 9))}
        weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
        rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
        want = shared(sizes, weights, 1.5 * sum(sizes.values()), 2)
        assert {r.source: pytest.approx(want[r.source]) for r in rows} == {r.source: r.target for r in rows}


def test_apportion_is_sainte_lague(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for group in range(12):
        weights = {k: float(rng.choice([0, 1, 7, 7, 30, 1000, 5000])) for k in range(rng.randrange(1, 12))}
        seats = rng.choice([0, 1, 5, 40, 300])
        rows += [(group, k, w, seats) for k, w in weights.items()]
        won = highest_quotients(weights, seats) if sum(weights.values()) else {k: 0 for k in weights}
        want |= {(group, k): n for k, n in won.items()}
    df = spark.createDataFrame(rows, "g int, k int, w double, s long")
    got = {(r.g, r.k): r.quota for r in mixing.apportion(df, ["g"], "k", "w", "s").collect()}
    assert got == want


def test_messy(messy, messy_rows):
    rows = mixing.mark(messy, block=4, shard_words=500).collect()
    assert len(rows) == len(messy_rows)
    sizes = [len(WORD.findall(t or "")) for _, t, *_ in messy_rows]
    assert sorted(r.size for r in rows) == sorted(sizes)
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    assert sum(r.taken for r in rows) == pytest.approx(1.5 * sum(sizes), rel=0.02)
    again = mixing.mark(messy.repartition(7), block=4, shard_words=500).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_rows_of_the_mix_hold_the_words_taken(messy, messy_rows):
    taken = mixing.mark(messy, block=4, shard_words=500).groupBy().sum("taken").first()[0]
    mixed = mixing.mixed_rows(messy, block=4, shard_words=500)
    assert mixed.columns == messy.columns
    out = mixed.select("doc_id", "text").collect()
    assert sum(len(WORD.findall(r.text)) for r in out) == taken
    texts = {}
    for i, t, *_ in messy_rows:
        texts.setdefault(i, []).append(t or "")
    for r in out:  # whole, or words of the text in order
        words = WORD.findall(r.text)
        assert any(is_part(words, WORD.findall(t)) for t in texts[r.doc_id])


def is_part(few, many):
    rest = iter(many)
    return all(w in rest for w in few)


def test_rows_without_an_id_spread_over_the_shards(spark):
    docs = spark.range(20_000).selectExpr(
        "cast(null as long) as doc_id", "concat(repeat('word ', 20), id) as text", "'en' as lang", "'one' as source", "0L as n_chars"
    )
    sizes = mixing._sizes(docs, "text", "source")
    placed = mixing._placed(sizes, sizes, mixing.WEIGHTS, mixing.SHARE, mixing.MOST, mixing.BLOCK, 1 << 15, 0)
    words = [r["sum(size)"] for r in placed.groupBy("shard").sum("size").collect()]
    assert sum(words) == 420_000 and len(words) == 14
    assert max(words) < 1.2 * (1 << 15)
    taken = mixing.mark(docs, shard_words=1 << 15).agg({"taken": "sum"}).first()[0]
    assert abs(taken - 630_000) <= 64 * 14


def test_empty_and_native(empty, messy):
    assert mixing.mark(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0
    assert python_nodes(mixing.mark(messy)) == [] and python_nodes(mixing.mixed_rows(messy)) == []
