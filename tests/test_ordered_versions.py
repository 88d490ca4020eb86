import difflib
import json
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from glossaleaf.operators import ordered, versions
from glossaleaf.session import shared_dir


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with half of all rows."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("entry"),
        ((F.col("id") * 7919) % 3000).alias("seq"),
        F.concat(F.lit("line "), F.col("id") % 5, F.lit("\nsame\n"), F.col("id") % 3).alias("text"),
    )
    # small pieces stay apart, as they would at size
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield rows.repartition(8)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def as_set(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_spread_form_equals_window_form(skewed):
    got = {}
    for spread in (False, True):
        df = ordered.with_previous(skewed, "entry", ["seq"], "n", {"text": "before"}, spread=spread)
        got[spread] = as_set(df, "entry", "seq", "text", "n", "before")
    assert got[True] == got[False]


def test_changes_are_counted_across_parts(skewed):
    rows = skewed.withColumn("text", F.expr("CASE WHEN seq % 11 = 0 THEN null WHEN seq % 3 = 0 THEN 'a' ELSE 'b' END"))
    texts = {}
    for r in rows.sort("entry", "seq").collect():
        texts.setdefault(r.entry, []).append((r.seq, r.text))
    want = Counter()
    for entry, seen in texts.items():
        n, before = 0, None
        for seq, text in seen:
            n += before is not None and text is not None and before != text
            want[(entry, seq, before, n)] += 1
            before = text
    for spread in (False, True):
        df = ordered.with_previous(rows, "entry", ["seq"], "n", {"text": "before"}, spread, changes={"text": "changes"})
        assert as_set(df, "entry", "seq", "before", "changes") == want


def test_spread_form_splits_the_large_key(skewed):
    parts = ordered.materialize(ordered.ranged(skewed, "entry", ["seq"]), "test")
    assert parts.filter("entry = 'hot'").select("_part").distinct().count() > 1


@pytest.mark.parametrize("spread", [False, True])
def test_pairs_and_line_changes_against_plain_python(skewed, spread):
    texts = {}
    for r in skewed.sort("entry", "seq").collect():
        texts.setdefault(r.entry, []).append(r.text)
    edits, lines = Counter(), Counter()
    for entry, seen in texts.items():
        version = 0
        for step, (old, new) in enumerate(zip(seen, seen[1:]), start=1):
            if old != new:
                edits[(entry, version, version + 1, old, new)] += 1
                version += 1
            delta = Counter(new.split("\n"))
            delta.subtract(old.split("\n"))
            for line, n in delta.items():
                if n:
                    lines[(entry, step, "added" if n > 0 else "removed", line, abs(n))] += 1
    pairs = versions.version_pairs(skewed, "entry", ["seq"], "text", spread)
    assert as_set(pairs, "entry", "version_from", "version_to", "old_text", "new_text") == edits
    changes = versions.line_changes(skewed, "entry", ["seq"], "text", spread)
    assert as_set(changes, "entry", "version_to", "change", "line", "n") == lines


def sizes(spark):
    """Bytes of each file in the shared folder."""
    top = Path(shared_dir(spark).removeprefix("file:"))
    return {f: f.stat().st_size for f in top.rglob("*.parquet")}


def test_texts_of_entries_with_one_text_are_not_written(spark):
    rng = random.Random(5)
    rows = [(f"k{i}", 0, "".join(rng.choices("abcdefghij ", k=2000))) for i in range(300)]
    rows += [("k7", 1, "second"), ("k7", 2, "third")]
    texts = spark.createDataFrame(rows, "entry string, seq int, text string")
    before = sizes(spark)
    got = as_set(versions.version_pairs(texts, "entry", ["seq"], "text"), "version_to", "old_text", "new_text")
    assert got == Counter([(1, rows[7][2], "second"), (2, "second", "third")])
    assert sum(n for f, n in sizes(spark).items() if f not in before) < 300 * 2000 / 10


def test_only_digests_are_ordered(skewed):
    """Texts go through no window and no aggregate, only to the pairs that hold them."""
    plan = versions.version_pairs(skewed, "entry", ["seq"], "text")._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line or "Aggregate(" in line]
    assert windows and not any("text" in line for line in windows)


@pytest.mark.parametrize("most", [0, 2_000_000])
@pytest.mark.parametrize("spread", [False, True])
def test_pairs_with_and_without_sent_hashes(spark, monkeypatch, spread, most):
    monkeypatch.setattr(versions, "MAX_BROADCAST_ENTRIES", most)
    rows = [
        ("a", 1, "x"), ("a", 2, "y"), ("a", 3, None), ("a", 4, "z"), ("a", 5, "z"), ("a", 6, "y"), ("a", 6, "y"),
        ("b", 1, "x"), ("c", 1, "x"), ("c", 2, "x"), ("d", None, "x"), ("d", 1, ""),
    ]
    texts = spark.createDataFrame(rows, "entry string, seq int, text string")
    pairs = versions.version_pairs(texts, "entry", ["seq"], "text", spread)
    assert pairs.columns == ["entry", "seq", "new_text", "old_text", "version_to", "version_from"]
    want = [("a", 2, "y", "x", 1, 0), ("a", 6, "y", "z", 2, 1), ("d", 1, "", "x", 1, 0)]
    assert as_set(pairs, *pairs.columns) == Counter(want)


@pytest.mark.parametrize("spread", [False, True])
def test_stored_text_comes_before_an_edit_without_time(spark, spread):
    entries = spark.createDataFrame([(f"e{i}", "old", 0) for i in range(40)], "primary_id string, diary_rewritten string, current_version int")
    edits = spark.createDataFrame([(f"e{i}", None, "new") for i in range(40)], "primary_id string, at int, text string")
    updated, records = versions.edit_texts(entries, edits, "diary_rewritten", spread)
    assert {r.diary_rewritten for r in updated.collect()} == {"new"}
    assert records.count() == 40


def test_diff_text(spark):
    df = spark.createDataFrame([("a\nb", "a\nc"), ("x", "x\ny")], "old_text string, new_text string")
    got = [json.loads(r.changes)["diary_rewritten"] for r in versions.text_changes(df, "diary_rewritten").collect()]
    assert got[0] == "--- v_old+++ v_new@@ -1,2 +1,2 @@ a\n-b+c"
    want = difflib.unified_diff(["x"], ["x\n", "y"], "v_old", "v_new", lineterm="")
    assert got[1] == "".join(want)


def test_expression_change_json(spark):
    change = versions.expression_change("add", F.lit("id"), F.lit("[a]"), F.lit(None).cast("string"))
    made = json.loads(spark.range(1).select(change).first()[0])
    assert made == {
        "primary_id": "id", "operation": "add", "expression_original": "[a]", "expression_translation": None,
    }
    with pytest.raises(ValueError):
        versions.expression_change("edit", F.lit("id"), F.lit("a"), F.lit("b"))


@pytest.mark.parametrize("spread", [False, True])
def test_edits_become_versions(spark, spread):
    entries = spark.createDataFrame([("a", "t0", 0), ("b", "u0", 0)], "primary_id string, diary_rewritten string, current_version int")
    edits = spark.createDataFrame(
        [("a", 1, "t1"), ("a", 2, "t1"), ("a", 3, None), ("a", 4, "t2"), ("b", 1, "u0"), ("zz", 1, "no")],
        "primary_id string, at int, text string",
    )
    updated, records = versions.edit_texts(entries, edits, "diary_rewritten", spread)
    assert sorted(tuple(r) for r in updated.collect()) == [("a", "t2", 2), ("b", "u0", 0)]
    got = sorted((r.primary_id_DiaryEntry, r.version_from, r.version_to, r.created_at) for r in records.collect())
    assert got == [("a", 0, 1, 1), ("a", 1, 2, 4)]
    raised = versions.apply_versions(entries, records)
    assert {r.primary_id: r.current_version for r in raised.collect()} == {"a": 2, "b": 0}


@pytest.mark.parametrize("spread", [False, True])
def test_versions_go_on_from_the_stored_one(spark, spread):
    schema = "primary_id string, diary_rewritten string, current_version int"
    entries = spark.createDataFrame([("a", "t0", 3), ("b", "u0", None), ("c", "w0", 5)], schema)
    edits = spark.createDataFrame([("a", 1, "t1"), ("a", 2, "t2"), ("b", 1, "u1")], "primary_id string, at int, text string")
    updated, records = versions.edit_texts(entries, edits, "diary_rewritten", spread)
    assert sorted(tuple(r) for r in updated.collect()) == [("a", "t2", 5), ("b", "u1", 1), ("c", "w0", 5)]
    got = sorted((r.primary_id_DiaryEntry, r.version_from, r.version_to) for r in records.collect())
    assert got == [("a", 3, 4), ("a", 4, 5), ("b", 0, 1)]
    changes = spark.createDataFrame([("a", 1, "x"), ("zz", 1, "y")], "primary_id_DiaryEntry string, created_at int, changes string")
    rows = versions.history_rows(changes, ["created_at"], spread, entries).collect()
    assert sorted((r.primary_id_DiaryEntry, r.version_from, r.version_to) for r in rows) == [("a", 3, 4), ("zz", 0, 1)]
