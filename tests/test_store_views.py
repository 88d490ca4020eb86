from collections import Counter
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from glossaleaf.languages import Languages
from glossaleaf.operators import errors, intake, store, views
from glossaleaf.sources import given, tables
from glossaleaf.schemas import DIARY_ENTRIES, UNKNOWN_EXPRESSIONS


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_append_keeps_the_first_of_each_new_key(spark):
    new = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), ("c", 1, "w")], "k string, seq int, v string")
    stored = spark.createDataFrame([("b",)], "k string")
    accepted, refused = store.append_new(new, stored, "k", ["seq"])
    assert rows(accepted) == [("a", 1, "x"), ("c", 1, "w")]
    assert rows(refused.select("k", "seq")) == [("a", 2), ("b", 1)]


def test_updates_take_the_latest_value_per_column(spark):
    base = spark.createDataFrame([("a", "t0", 0), ("b", "t0", 0)], "k string, text string, version int")
    changes = spark.createDataFrame(
        [("a", 1, "t1", 1), ("a", 3, None, 3), ("a", 2, "t2", 2), ("zz", 1, "no", 1)],
        "k string, seq int, text string, version int",
    )
    got = store.apply_updates(base, changes, "k", ["seq"], ["text", "version"])
    assert rows(got) == [("a", "t2", 3), ("b", "t0", 0)]


def test_deletes(spark):
    base = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "primary_id string, is_show boolean")
    gone = spark.createDataFrame([("a",), ("a",), ("x",)], "primary_id string")
    assert rows(store.soft_delete(base, gone)) == [("a", False), ("b", True), ("c", False)]
    assert rows(store.delete_rows(base, gone)) == [("b", True), ("c", False)]


def test_missing_table_reads_as_empty(spark, tmp_path):
    path = str(tmp_path / "none")
    assert tables.read_table(spark, path, DIARY_ENTRIES).count() == 0
    assert tables.read_table(spark, path, UNKNOWN_EXPRESSIONS).columns == UNKNOWN_EXPRESSIONS.fieldNames()


def test_append_then_snapshot(spark, sf_dir, tmp_path):
    entries = given.diary_entries(spark, sf_dir)
    path = str(tmp_path / "diary")
    tables.append_table(entries, path, DIARY_ENTRIES, ["language_source"])
    stored = tables.read_table(spark, path, DIARY_ENTRIES)
    assert rows(stored.select(*entries.columns)) == rows(entries)
    hidden = store.soft_delete(stored, stored.filter("language_source = 'fra'"))
    tables.write_snapshot(hidden, str(tmp_path / "diary-2"))
    again = tables.read_table(spark, str(tmp_path / "diary-2"), DIARY_ENTRIES)
    assert again.filter("language_source = 'fra' and is_show").count() == 0
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        tables.write_snapshot(hidden, str(tmp_path / "diary-2"))


def test_submissions_from_json_lines(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"job_id": "j", "draft_text": "a [b]", "extra": 1}\n')
    got = tables.read_submissions(spark, str(tmp_path / "in.json")).first()
    assert (got.job_id, got.draft_text, got.title_diary) == ("j", "a [b]", None)


def test_old_text_spans(spark, tmp_path):
    names = UNKNOWN_EXPRESSIONS.fieldNames()
    table = spark.range(1).select(
        *[F.lit("[2, 5]" if n.startswith("span_") else None).cast("timestamp_ntz" if n == "created_at" else "string").alias(n) for n in names]
    )
    table.write.parquet(str(tmp_path / "old"))
    got = tables.read_expressions_with_text_spans(spark, str(tmp_path / "old")).first()
    assert tuple(got.span_original) == (2, 5)


def test_filters_reach_the_scan(spark, sf_dir, tmp_path):
    path = str(tmp_path / "diary")
    tables.append_table(given.diary_entries(spark, sf_dir), path, DIARY_ENTRIES, ["language_source"])
    found = views.entries(tables.read_table(spark, path, DIARY_ENTRIES), "fra", "eng").select("primary_id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(language_source" in plan
    assert "EqualTo(language_annotation,eng)" in plan and "diary_original" not in plan


def test_no_condition_is_a_full_scan(spark, sf_dir):
    entries = given.diary_entries(spark, sf_dir)
    assert views.entries(entries, visible_only=False).count() == entries.count()


def test_list_marks(spark):
    kinds = spark.createDataFrame([("completed",), ("error",), ("processing",), ("odd",), (None,)], "s string")
    assert [r[0] for r in kinds.select(views.status_mark(F.col("s"))).collect()] == ["✅", "❌", "⏳", "❓", "❓"]


def test_errors_of_list_and_table_agree(spark, sf_dir):
    entries = views.entries(given.diary_entries(spark, sf_dir))
    stored = given.error_memory(spark, sf_dir).drop("embedding")
    ids = [r[0] for r in entries.select("primary_id").collect()]
    assert rows(views.errors_of(stored, ids)) == rows(views.errors_of(stored, entries))


def test_error_validity(spark):
    schema = "category string, language_diary_text string, language_annotation_text string"
    df = spark.createDataFrame([("Grammar", "fra", "eng"), ("Style", "fra", "eng"), ("None", "xx", "eng"), (None, "fra", "eng"), ("None", "fra", None)], schema)
    reasons = Counter(r.reject_reason for r in errors.with_validity(df, Languages(spark)).collect())
    assert reasons == {None: 1, "category": 2, "language_diary": 1, "language_annotation": 1}


def test_language_table_may_be_given(spark):
    table = spark.createDataFrame([("qaa", None, "Private")], "alpha_3 string, alpha_2 string, name string")
    df = spark.createDataFrame([("qaa",), ("fra",)], "c string")
    assert rows(Languages(spark, table).known(df, "c")) == [("qaa",)]


def test_intake_reasons(spark):
    schema = "draft_text string, lang_diary_body string, lang_annotation string, level_rewriting string, title_diary string"
    cases = [
        (("t", " fra ", "eng", "B2", ""), None),
        (("t", "", "eng", "B2", ""), None),
        (("t", "", "xx", "B2", ""), None),  # one blank code: detection decides, nothing is checked
        (("t", "xx", "eng", "B2", ""), "unknown language"),
        (("", "fra", "eng", "B2", ""), "Please enter some text."),
        (("t", "fra", "eng", "D1", ""), "invalid level"),
        (("t", "fra", "eng", None, ""), "missing field"),
        (("t", None, "eng", "B2", ""), "missing field"),
    ]
    for row, reason in cases:
        df = spark.createDataFrame([row], schema)
        assert intake.checked(df, Languages(spark)).first().reject_reason == reason


def test_large_entry_is_split_in_the_join(spark):
    """Errors that mostly belong to one entry: the adaptive join splits that entry's rows."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        stored = spark.range(0, 40000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).cast("string").alias("primary_id_DiaryEntry"),
            F.sha2(F.col("id").cast("string"), 256).alias("error_rule"),
        )
        entries = spark.range(40000).select(
            F.col("id").cast("string").alias("primary_id"), F.lit(True).alias("is_show"),
            F.lit("fra").alias("language_source"), F.lit("eng").alias("language_annotation"),
            F.current_date().alias("date_diary"), F.lit(0).alias("current_version"),
        )
        joined = views.entries_with_errors(entries, stored)
        assert len(joined.collect()) == 40000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_keys_come_from_the_submission_or_its_time(spark):
    schema = "submitted_at timestamp_ntz, title_diary string, date_diary date, primary_id string"
    at = datetime(2024, 1, 2, 3, 4, 5, 60)
    rows_in = [(at, None, None, None), (at, "t", date(2023, 5, 6), None), (at, "t", None, "mine")]
    got = intake.with_keys(spark.createDataFrame(rows_in, schema)).collect()
    assert [r.primary_id for r in got] == [
        "2024-01-02_2024-01-02T03:04:05.000060", "2023-05-06_2024-01-02T03:04:05.000060", "mine",
    ]
    assert [r.title_diary for r in got] == ["", "t", "t"]
    assert [r.date_diary for r in got] == [date(2024, 1, 2), date(2023, 5, 6), date(2024, 1, 2)]
