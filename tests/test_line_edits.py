import json
import random

import pytest
from glossaleaf.operators import line_edits

SCHEMA = "entry string, version int, old_text string, new_text string"
KEYS = ["entry", "version"]


def lines_and_anchors(old, new):
    """Both texts' lines, and the length of a longest chain of anchors by a quadratic table."""
    a = [] if old is None else old.split("\n")
    b = [] if new is None else new.split("\n")
    once = [(i, b.index(x)) for i, x in enumerate(a) if a.count(x) == 1 and b.count(x) == 1]
    longest = [1] * len(once)
    for i in range(len(once)):
        for j in range(i):
            if once[j][1] < once[i][1]:
                longest[i] = max(longest[i], longest[j] + 1)
    return a, b, max(longest, default=0)


def made(a, edits):
    """Old lines with the edits made, one after the other."""
    gone = {e.at for e in edits if e.op == "delete"}
    lines = [x for i, x in enumerate(a) if i not in gone]
    for e in sorted((e for e in edits if e.op == "insert"), key=lambda e: e.at):
        lines.insert(e.at, e.line)
    return lines


@pytest.fixture(scope="module")
def cases(spark):
    rng = random.Random(3)
    rows = [
        ("same", 1, "a\nb", "a\nb"), ("empty", 1, "", "a"), ("emptied", 1, "a\nb", ""), ("moved", 1, "a\nb\nc", "c\na\nb"),
        ("front and back", 1, "x\nx\ny\nx\nx", "x\nx\nz\nz\nx\nx"), ("null", 1, None, "a\nb"), ("nulled", 1, "a", None),
        ("nulls", 1, None, None), ("ends", 1, "a\n", "a"),
    ]
    for n in range(120):
        words = "abcdefghijklmnop"[: rng.randint(1, 16)]
        old = [rng.choice(words) for _ in range(rng.randint(0, 14))]
        new = [x for x in old if rng.random() < 0.7]
        for _ in range(rng.randint(0, 4)):
            new.insert(rng.randint(0, len(new)), rng.choice(words))
        # one entry holds a third of the pairs
        rows.append(("hot" if n % 3 == 0 else f"e{n}", n, "\n".join(old), "\n".join(new)))
    return spark.createDataFrame(rows, SCHEMA)


def test_edits_turn_old_into_new(cases):
    edits = {}
    for e in line_edits.line_edits(cases, KEYS).collect():
        edits.setdefault((e.entry, e.version), []).append(e)
    for r in cases.collect():
        a, b, anchors = lines_and_anchors(r.old_text, r.new_text)
        mine = edits.get((r.entry, r.version), [])
        assert made(a, mine) == b
        assert all(e.line == (a if e.op == "delete" else b)[e.at] for e in mine)
        kept = len(a) - sum(e.op == "delete" for e in mine)
        assert kept >= anchors
        if a == b:
            assert not mine


def test_lines_move_by_the_shorter_way(spark):
    df = spark.createDataFrame([("e", 1, "a\nb\nc\nd", "d\na\nb\nc")], SCHEMA)
    got = sorted((e.op, e.at, e.line) for e in line_edits.line_edits(df, KEYS).collect())
    assert got == [("delete", 3, "d"), ("insert", 0, "d")]


def test_common_lines_of_a_gap_stay(spark):
    df = spark.createDataFrame([("e", 1, "x\nx\ny\nx\nx", "x\nx\nz\nz\nx\nx")], SCHEMA)
    got = sorted((e.op, e.at, e.line) for e in line_edits.line_edits(df, KEYS).collect())
    assert got == [("delete", 2, "y"), ("insert", 2, "z"), ("insert", 3, "z")]


def test_replay_from_payloads(cases):
    edits = line_edits.line_edits(cases, KEYS)
    records = line_edits.payloads(edits, KEYS, "diary_rewritten")
    one = json.loads(records.filter("entry = 'moved'").first().changes)
    assert one == {"diary_rewritten": [{"op": "delete", "at": 2, "line": "c"}, {"op": "insert", "at": 0, "line": "c"}]}
    again = line_edits.replay(cases, line_edits.from_payloads(records, KEYS, "diary_rewritten"), KEYS)
    want = {(r.entry, r.version): r.new_text for r in cases.collect()}
    assert {(r.entry, r.version): r.text for r in again.collect()} == want


def test_empty_table_and_a_very_long_text(spark):
    assert line_edits.line_edits(spark.createDataFrame([], SCHEMA), KEYS).count() == 0
    lines = [f"line {i}" for i in range(30_000)]
    changed = lines[:10_000] + ["new"] + lines[10_001:]
    df = spark.createDataFrame([("e", 1, "\n".join(lines), "\n".join(changed))], SCHEMA)
    got = sorted((e.op, e.at, e.line) for e in line_edits.line_edits(df, KEYS).collect())
    assert got == [("delete", 10_000, "line 10000"), ("insert", 10_000, "new")]


def test_lines_meet_no_join(spark):
    """Lines, anchors and edits come together in one shuffle by pair."""
    pairs = spark.createDataFrame([(1, "a\nb\nc", "a\nc\nd"), (2, "x", "x\ny")], "pair int, old_text string, new_text string")
    plan = line_edits.line_edits(pairs, ["pair"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" in plan


def test_lines_are_counted_by_their_digests(spark):
    """Long lines do not go through the aggregate that finds the anchors."""
    pairs = spark.createDataFrame([(1, "a\nb\nc", "a\nc\nd")], "pair int, old_text string, new_text string")
    plan = line_edits.line_edits(pairs, ["pair"])._jdf.queryExecution().executedPlan().toString()
    keyed = [line for line in plan.split("\n") if "HashAggregate(keys=[" in line]
    assert keyed and not any("_line#" in line.split("keys=[")[1].split("]")[0] for line in keyed)


def test_lines_of_any_length_anchor(spark):
    rng = random.Random(9)
    lines = [c * n for n in (1, 30, 31, 32, 33, 64, 5000) for c in ("a", "é", "\U0001f600")]
    rows = []
    for n in range(40):
        old = [rng.choice(lines) for _ in range(rng.randint(1, 14))]
        new = [x for x in old if rng.random() < 0.7]
        for _ in range(rng.randint(0, 4)):
            new.insert(rng.randint(0, len(new)), rng.choice(lines))
        rows.append(("e", n, "\n".join(old), "\n".join(new)))
    df = spark.createDataFrame(rows, SCHEMA)
    edits = {}
    for e in line_edits.line_edits(df, KEYS).collect():
        edits.setdefault(e.version, []).append(e)
    for _, n, old, new in rows:
        a, b, anchors = lines_and_anchors(old, new)
        mine = edits.get(n, [])
        assert made(a, mine) == b
        assert len(a) - sum(e.op == "delete" for e in mine) >= anchors
