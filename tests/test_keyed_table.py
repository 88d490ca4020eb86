"""The keyed table against a plain dictionary, its untouched files, and a writer that dies."""

import random
from pathlib import Path

import pytest

from glossaleaf.session import fresh_path
from glossaleaf.sources import keyed_table

SCHEMA = "k string, text string, n int"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def content(df):
    return {r.k: (r.text, r.n) for r in df.collect()}


@pytest.fixture
def path(spark):
    path = fresh_path(spark, "keyed")
    keyed_table.create(frame(spark, [(f"k{i}", f"t{i}", i) for i in range(40)]).repartition(3), path, "k", 8)
    return path


def test_rounds_of_changes_against_a_dictionary(spark, path):
    rng = random.Random(1)
    want = {f"k{i}": (f"t{i}", i) for i in range(40)}
    for round_ in range(3):
        changes = [(f"k{rng.randrange(50)}", seq, rng.choice([None, f"new {round_} {seq}"]), rng.choice([None, seq])) for seq in range(12)]
        gone = [(f"k{rng.randrange(50)}",) for _ in range(4)] + [(None,)]
        insert = round_ == 1
        for k, _, text, n in changes:
            if k in want or insert:
                old = want.get(k, (None, None))
                want[k] = (old[0] if text is None else text, old[1] if n is None else n)
        for (k,) in gone:
            want.pop(k, None)
        number = keyed_table.change(
            path, frame(spark, changes, "k string, seq int, text string, n int"), frame(spark, gone, "k string"), ["seq"], insert
        )
        assert number == round_ + 1
        assert content(keyed_table.read(spark, path)) == want
    assert content(keyed_table.read(spark, path, 0)) == {f"k{i}": (f"t{i}", i) for i in range(40)}


def test_untouched_buckets_keep_their_files(spark, path):
    before = keyed_table.manifest(spark, path)
    times = {f: f.stat().st_mtime_ns for f in Path(f"{path.removeprefix('file:')}/rows").rglob("*.parquet")}
    keyed_table.change(path, frame(spark, [("k7", 1, "x")], "k string, seq int, text string"), order=["seq"])
    after = keyed_table.manifest(spark, path)
    assert [b for b in before if before[b] != after[b]] == [b for b in after if before.get(b) != after[b]] and len(set(after.values()) - set(before.values())) == 1
    assert all(f.stat().st_mtime_ns == t for f, t in times.items())


def test_a_writer_that_dies_before_the_swap_changes_nothing(spark, path, monkeypatch):
    before = content(keyed_table.read(spark, path))
    edit = frame(spark, [("k1", 1, "lost")], "k string, seq int, text string")

    def dies(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(keyed_table, "_commit", dies)
        with pytest.raises(RuntimeError, match="killed"):
            keyed_table.change(path, edit, order=["seq"])
    assert keyed_table.state(spark, path) == 0
    assert content(keyed_table.read(spark, path)) == before
    assert keyed_table.change(path, edit, order=["seq"]) == 1
    assert content(keyed_table.read(spark, path)) == before | {"k1": ("lost", 1)}


def test_a_state_is_committed_once(spark, path):
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        keyed_table._commit(spark, path, 0, {}, "k", 8)
    keyed_table.change(path, deletes=frame(spark, [("k2",)], "k string"), number=0)
    with pytest.raises(ValueError, match="at state 1"):
        keyed_table.change(path, deletes=frame(spark, [("k3",)], "k string"), number=0)
    with pytest.raises(ValueError, match="nothing"):
        keyed_table.change(path)


def test_lookup_reads_the_buckets_of_the_keys_only(spark, path):
    found = keyed_table.lookup(spark, path, frame(spark, [("k5",), ("k5",), ("none",), (None,)], "k string"))
    assert content(found) == {"k5": ("t5", 5)}
    assert len(found.inputFiles()) < len(keyed_table.read(spark, path).inputFiles())


def test_empty_tables(spark):
    path = fresh_path(spark, "keyed")
    keyed_table.create(frame(spark, []), path, "k", 4)
    assert content(keyed_table.read(spark, path)) == {}
    keyed_table.change(path, frame(spark, [("a", 1, "x", 2)], "k string, seq int, text string, n int"), order=["seq"], insert=True)
    assert content(keyed_table.read(spark, path)) == {"a": ("x", 2)}
    keyed_table.change(path, deletes=frame(spark, [("a",), ("b",)], "k string"))
    assert content(keyed_table.read(spark, path)) == {}
    keyed_table.change(path, frame(spark, [], "k string, seq int, text string"), order=["seq"])
    assert keyed_table.state(spark, path) == 3
