"""Column expressions against the plain Python they stand for, on arbitrary texts."""

import json
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glossaleaf.functions import prompts, responses, text
from glossaleaf.operators import translation

CALM = settings(
    max_examples=8, deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow],
)
ANY = st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\x00"), max_size=40)
MARKED = st.text(st.sampled_from("ab[] \n\t😀é<>/"), max_size=40)


def mapped(spark, values, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").coalesce(1)
    return [r[0] for r in df.select(column, "i").sort("i").collect()]


@CALM
@given(st.lists(ANY, min_size=1, max_size=60))
def test_json_string(spark, values):
    assert mapped(spark, values, prompts.json_string(F.col("v"))) == [json.dumps(v) for v in values]


@CALM
@given(st.lists(st.one_of(ANY, MARKED), min_size=1, max_size=60))
def test_brackets_and_strip(spark, values):
    assert mapped(spark, values, text.brackets(F.col("v"))) == [re.findall(r"\[[^]]+\]", v) for v in values]
    assert mapped(spark, values, text.strip(F.col("v"))) == [v.strip() for v in values]
    tail = mapped(spark, values, responses.response_tail(F.col("v")))
    assert tail == [v.split("<|assistant|>")[-1] for v in values]


@CALM
@given(st.lists(st.tuples(MARKED, st.text(st.sampled_from("ab😀 "), min_size=1, max_size=3)), min_size=1, max_size=60))
def test_single_spans(spark, values):
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, b string, p string").coalesce(1)
    got = [r[0][0] for r in df.select(text.single_spans(F.col("b"), F.array("p")), "i").sort("i").collect()]
    for span, (body, phrase) in zip(got, values):
        spans = [m.span() for m in re.finditer(re.escape(phrase), body)]
        assert (tuple(span) if span else None) == (spans[0] if len(spans) == 1 else None)


@CALM
@given(st.lists(st.lists(st.tuples(st.text("abcé", min_size=1, max_size=4), st.text("xyz😀", min_size=1, max_size=4)), max_size=4), min_size=1, max_size=30))
def test_spans_point_at_what_they_say(spark, drafts):
    rows = []
    for items in drafts:
        draft = " - ".join(f"[{w}]" for w, _ in items)
        answer = "".join(f"<bracket>[{w}]</bracket><translation>{t}</translation>" for w, t in items)
        rows.append((draft, answer))
    df = spark.createDataFrame(rows, "draft string, response string").coalesce(1)
    for r in translation.translate(df).collect():
        if r.translate_status != "ok":
            assert (r.draft_replaced, r.spans) == ("", [])
        for s in r.spans:
            assert r.draft[slice(*s.span_original)] == s.expression_original.strip("[]")
            assert r.draft_replaced[slice(*s.span_translation)] == s.expression_translation
