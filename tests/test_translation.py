import re

import pytest
from pyspark.sql import functions as F

from glossaleaf.operators import translation

ECHO = "<bracket>[text]</bracket><translation>corresponding translation</translation>"


def pair(original, translated, gap=""):
    return f"<bracket>{original}</bracket>{gap}<translation>{translated}</translation>"


def run(spark, draft, response, **options):
    df = spark.createDataFrame([(draft, response)], "draft string, response string")
    return translation.translate(df, **options).first()


def test_french_draft(spark):
    draft = "Hier je allé au marché avec ma [aunt]. Il y avait beaucoup de [fresh vegetables] partout."
    got = run(spark, draft, "<|assistant|>" + ECHO + pair(" [aunt]", "tante") + pair("[fresh vegetables]", "légumes frais", "\n"))
    assert got.translate_status == "ok"
    assert got.draft_replaced == "Hier je allé au marché avec ma tante. Il y avait beaucoup de légumes frais partout."
    for s in got.spans:
        inner = s.expression_original.strip("[]")
        assert draft[s.span_original.start: s.span_original.end] == inner
        assert got.draft_replaced[s.span_translation.start: s.span_translation.end] == s.expression_translation


def test_chinese_draft_with_emoji_counts_code_points(spark):
    draft = "😀昨天我去了[market]买东西。我喜欢[fresh vegetables]。"
    got = run(spark, draft, pair("[market]", "市场") + pair("[fresh vegetables]", "新鲜蔬菜"))
    assert got.draft_replaced == "😀昨天我去了市场买东西。我喜欢新鲜蔬菜。"
    assert [tuple(s.span_original) for s in got.spans] == [(7, 13), (22, 38)]
    assert [tuple(s.span_translation) for s in got.spans] == [(6, 8), (15, 19)]


@pytest.mark.parametrize(
    "response, parsed",
    [
        (pair("[a1]", "x1") + pair("[b1]", "y1"), 2),  # as many as expected: nothing is an echo
        (ECHO + pair("[a1]", "x1") + pair("[b1]", "y1"), 2),
        (pair("[a1]", "x1"), 0),  # a single one is taken for the echo
        (ECHO + pair("[a1]", "x1") + pair("[b1]", "y1") + pair("[c1]", "z1"), 3),
        (pair("[a1]", "x1") + pair("[b1]", "y1") + "<no_errors/><no_errors/>", 0),
        (pair("[a1]", "x1") + pair("[b1]", "y1") + "<no_errors/>", 2),
        (pair("[a1]", "x1", "\n\n") + pair("[b1]", "y1"), 0),  # more than one blank between the tags
        ("nothing", 0),
    ],
)
def test_echo_rule(spark, response, parsed):
    assert run(spark, "say [a1] and [b1]", response).n_parsed == parsed


def test_no_answer_leaves_the_draft(spark):
    got = run(spark, "say [a1]", "sorry")
    assert (got.translate_status, got.draft_replaced, got.spans) == ("ok", "say [a1]", [])


@pytest.mark.parametrize(
    "draft, response, status",
    [
        ("[aa] aa", pair("[aa]", "x"), "position_mismatch"),  # phrase twice
        ("[aa] b", pair("[zz]", "x"), "position_mismatch"),
        ("[aa] fille", pair("[aa]", "fille"), "span_mismatch"),  # translation twice
        ("[a b] c", pair("[a\tb]", "x"), "span_mismatch"),  # found, but the text to replace is not there
    ],
)
def test_failures_give_no_text(spark, draft, response, status):
    got = run(spark, draft, response)
    assert (got.translate_status, got.draft_replaced, got.spans) == (status, "", [])


def test_metacharacters_are_literal_when_strict(spark):
    got = run(spark, "is it [what?] (", pair("[what?]", "quoi*"))
    assert (got.translate_status, got.draft_replaced) == ("ok", "is it quoi* (")


def reference_substitution(draft, pairs):
    """The rule of pattern mode, written out one draft at a time."""
    try:
        before = [
            (o, t)
            for o, t in pairs
            for _ in re.finditer(o.replace("[", "").replace("]", "").replace(" ", r"\s"), draft, re.DOTALL)
        ]
        if len(before) != len(pairs):
            return "position_mismatch", ""
        for o, t in before:
            draft = draft.replace(o, t)
        after = [m.span() for _, t in pairs for m in re.finditer(t, draft, re.DOTALL)]
    except re.error:
        return "position_mismatch", ""
    return ("ok", draft) if len(after) == len(pairs) else ("span_mismatch", "")


@pytest.mark.parametrize(
    "draft, pairs",
    [
        ("a [b c] d", [("[b c]", "x")]),
        ("a [b\tc] d", [("[b c]", "x")]),
        ("[aa] aa [zz]", [("[aa]", "x"), ("[zz]", "y")]),
        ("[w?] is [vv]", [("[w?]", "x"), ("[vv]", "y")]),
        ("[a.c] is [vv]", [("[a.c]", "xx"), ("[vv]", "yy")]),
        ("[(a] is [vv]", [("[(a]", "x"), ("[vv]", "y")]),
        ("[a?] is [(b]", [("[a?]", "x"), ("[(b]", "y")]),
        ("[aa] fille [bb]", [("[aa]", "fille"), ("[bb]", "zz")]),
        ("[ab] ab [c(d)]", [("[ab]", "x"), ("[c(d)]", "y")]),
        ("[ab] ab [c(d)] ", [("[ab]", "q[ab] "), ("[c(d)]", " ")]),
    ],
)
def test_pattern_mode_is_the_total_count_rule(spark, draft, pairs):
    got = run(spark, draft, "".join(pair(o, t) for o, t in pairs), strict=False)
    assert (got.translate_status, got.draft_replaced) == reference_substitution(draft, pairs)


def test_expression_rows_have_distinct_keys(spark):
    schema = (
        "primary_id string, created_at timestamp_ntz, language_source string, language_annotation string, "
        "spans array<struct<expression_original:string,expression_translation:string,"
        "span_original:struct<start:int,end:int>,span_translation:struct<start:int,end:int>>>"
    )
    from datetime import datetime

    spans = [("[a]", "x", (0, 1), (0, 1)), ("[a]", "x", (4, 5), (4, 5)), ("[b]", "y", (8, 9), (8, 9))]
    df = spark.createDataFrame([("e", datetime(2024, 1, 1), None, "eng", spans), ("f", datetime(2024, 1, 1), "fra", "eng", [])], schema)
    rows = translation.expression_rows(df).collect()
    assert len(rows) == 3 and len({r.primary_id for r in rows}) == 3
    assert {r.language_source for r in rows} == {"Unknown"}


def test_a_draft_is_searched_once(spark, sf_dir):
    from glossaleaf.sources import given

    drafts = given.translated(spark, sf_dir)
    assert drafts._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1
    exploded = translation.expression_rows(drafts).filter("expression_translation is not null")
    plan = exploded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1 and plan.count("substituted(") <= 2
