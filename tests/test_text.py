import hashlib
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from glossaleaf.functions import keys, prompts, responses, text


def value(spark, column, **inputs):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()]) if inputs else spark.range(1)
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    "draft, expected",
    [
        ("Voilà [a river]. C'est [quite deep].", ["[a river]", "[quite deep]"]),
        ("empty [] is none, [[x] is one", ["[[x]"]),
        ("two\n[lines\nlong]", ["[lines\nlong]"]),
        ("none", []),
    ],
)
def test_brackets(spark, draft, expected):
    assert value(spark, text.brackets(F.col("d")), d=draft) == expected


def test_cut_brackets(spark):
    draft = "a [b] c [d] e\nf [g] h"
    assert value(spark, text.without_brackets(F.col("d")), d=draft) == "a  c  e\nf  h"
    assert value(spark, text.without_brackets(F.col("d"), greedy=True), d=draft) == "a  e\nf  h"


def test_strip_is_pythons(spark):
    raw = "　\x1c\t x y  \n"
    assert value(spark, text.strip(F.col("d")), d=raw) == raw.strip()


def test_single_spans_count_code_points(spark):
    found = value(
        spark,
        text.single_spans(F.col("d"), F.array(F.lit("girl"), F.lit("a"), F.lit("zz"), F.lit(""))),
        d="😀 a girl",
    )
    assert [tuple(s) if s else None for s in found] == [(4, 8), (2, 3), None, None]


def test_single_spans_do_not_overlap(spark):
    found = value(spark, text.single_spans(F.col("d"), F.array(F.lit("aba"))), d="ababa")
    assert tuple(found[0]) == (0, 3)


@pytest.mark.parametrize(
    "response, rules",
    [
        ("<error><rule>echo</rule><correction>c</correction></error>", []),
        (
            "<error><rule>echo</rule><correction>c</correction></error>\n"
            "<error><rule> r1\n</rule><phrase>p</phrase><correction></correction><category>Spelling</category></error>",
            [("r1", "p", "", "Spelling")],
        ),
        (
            "<error>echo</error><error><rule>r</rule></error><error><rule>r2</rule><correction>c</correction></error>",
            [("r2", "", "c", "None")],
        ),
        ("<no_errors/><no_errors/><error>e</error><error><rule>r</rule><correction>c</correction></error>", []),
        ("nothing", []),
    ],
)
def test_error_blocks(spark, response, rules):
    found = value(spark, responses.error_blocks(F.col("r")), r=response)
    assert [(e.error_rule, e.example_phrase, e.correction, e.category) for e in found] == rules


def test_error_blocks_without_echo(spark):
    one = "<error><rule>r</rule><correction>c</correction></error>"
    assert len(value(spark, responses.error_blocks(F.col("r"), skip_first=False), r=one)) == 1


def test_last_tag_wins(spark):
    two = "<rewriting>a</rewriting><rewriting>b\nc</rewriting>"
    assert value(spark, responses.last_rewriting(F.col("r")), r=two) == "b\nc"
    assert value(spark, responses.last_rewriting(F.col("r")), r="plain") is None
    assert value(spark, responses.review_text(F.col("r")), r="plain") == "plain"


@pytest.mark.parametrize(
    "response, finish, detected, status, rewriting",
    [
        ("plain", "length", "fra", "xml_error", "plain"),
        ("<rewriting>x</rewriting>", "length", "fra", "insufficient_length", "<rewriting>x</rewriting>"),
        ("<rewriting>x</rewriting>", "stop", "eng", "incorrect_language", "<rewriting>x</rewriting>"),
        ("<rewriting>x</rewriting>", "stop", None, "incorrect_language", "<rewriting>x</rewriting>"),
        ("<rewriting>[x] y</rewriting>", "stop", "fra", "success", "x y"),
    ],
)
def test_rewrite_status(spark, response, finish, detected, status, rewriting):
    df = spark.createDataFrame([(response, finish, detected, "fra")], "r string, f string, d string, l string")
    got = df.select(responses.rewrite_status(F.col("r"), F.col("f"), F.col("d"), F.col("l")).alias("s"), "r")
    row = got.select("s", responses.rewriting_text(F.col("r"), F.col("s"))).first()
    assert tuple(row) == (status, rewriting)


@pytest.mark.parametrize(
    "output, prompt, limit, expected",
    [([1, 2, 9], [1], 5, "stop"), ([1, 2, 3], [1], 2, "length"), ([1, 2, 3], [1], 5, "unknown")],
)
def test_finish_reason(spark, output, prompt, limit, expected):
    ids = [F.array(*[F.lit(i) for i in items]) for items in (output, prompt)]
    assert value(spark, responses.finish_reason(*ids, F.lit(limit), F.lit(9))) == expected


@pytest.mark.parametrize("reported, expected", [(None, "stop"), ("", "stop"), ("length", "length")])
def test_done_reason(spark, reported, expected):
    assert value(spark, responses.done_reason(F.lit(reported).cast("string"))) == expected


def test_response_without_prompt(spark):
    assert value(spark, responses.without_prompt(F.lit("Hi.\n Hi.answer \n"), F.lit("Hi."))) == "answer"


@pytest.mark.parametrize(
    "raw", ["plain", 'quote " back \\ slash', "line\nand\ttab", "é ü ß 中文", "😀 and \x7f", ""]
)
def test_json_string_is_pythons(spark, raw):
    assert value(spark, prompts.json_string(F.col("d")), d=raw) == json.dumps(raw)


def test_chat_json_is_pythons(spark):
    prompt = F.struct(F.lit('You are "é".').alias("system"), F.lit("a\nb").alias("user"))
    chat = [{"role": "system", "content": 'You are "é".'}, {"role": "user", "content": "a\nb"}]
    assert value(spark, prompts.chat_json(prompt)) == json.dumps(chat)


def test_translator_prompt_text(spark):
    prompt = value(
        spark, prompts.translator_prompt(F.lit("English"), F.lit("French"), F.array(F.lit("[girl]"), F.lit("[é]")))
    )
    assert prompt.system == "You are a translator from English to French."
    assert prompt.user.startswith("Task:\nTranslate text in bracketed [text] one by one. The bracketed text is")
    assert prompt.user.endswith('\n    \n\nINPUT: ["[girl]", "[\\u00e9]"]')


def test_rewriter_prompt_repeats_the_format_after_failed_parses(spark):
    args = (F.lit("French"), F.lit("B2"), F.lit("x {level} y"))
    plain = value(spark, prompts.rewriter_prompt(*args)).user
    again = value(spark, prompts.rewriter_prompt(*args, F.lit(2))).user
    assert plain.endswith("Input: x {level} y")
    assert again == plain + 2 * prompts.REWRITER_RETRY


def test_request_bodies(spark):
    prompt = F.struct(F.lit("s").alias("system"), F.lit('u "é"').alias("user"))
    body = json.loads(value(spark, prompts.chat_request(F.lit("m"), prompt, F.lit(None).cast("int"), F.lit(90))))
    assert body == {
        "model": "m",
        "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": 'u "é"'}],
        "stream": False,
        "options": {"temperature": 0.7, "num_predict": 90, "top_p": 0.9},
    }
    body = json.loads(value(spark, prompts.generate_request(prompts.chat_json(prompt), temperature=F.lit(0.1))))
    assert (body["max_length"], body["temperature"], body["enable_thinking"]) == (512, 0.1, True)
    assert json.loads(body["prompt"])[1]["content"] == 'u "é"'


def test_chat_roles(spark):
    kinds = ["system", "human", "ai", "tool"]
    df = spark.createDataFrame([(k,) for k in kinds], "k string")
    assert [r[0] for r in df.select(prompts.chat_role(F.col("k"))).collect()] == ["system", "user", "assistant", "user"]


def test_keys_follow_isoformat(spark):
    for at in (datetime(2024, 5, 6, 7, 8, 9), datetime(2024, 5, 6, 7, 8, 9, 12000)):
        ts = F.lit(str(at)).cast("timestamp_ntz")
        assert value(spark, keys.entry_key(F.to_date(ts), ts)) == f"2024-05-06_{at.isoformat()}"
        plain = hashlib.sha256(f"e_[x]_{at.isoformat()}".encode()).hexdigest()
        assert value(spark, keys.expression_key(F.lit("e"), F.lit("[x]"), ts, F.lit(1))) == plain
        assert value(spark, keys.expression_key(F.lit("e"), F.lit("[x]"), ts, F.lit(2))) != plain


@pytest.mark.parametrize("raw, span", [("[3, 9]", (3, 9)), ("[-1, -1]", (-1, -1)), ("[3]", None), ("x", None), (None, None)])
def test_span_text(spark, raw, span):
    got = value(spark, keys.span_from_text(F.lit(raw).cast("string")))
    assert (tuple(got) if got else None) == span
    if span:
        assert value(spark, keys.span_to_text(keys.span_from_text(F.lit(raw)))) == raw


def test_budget_doubles_when_thinking(spark):
    assert value(spark, prompts.token_budget(F.lit("abc"), F.lit(True))) == 1030
    assert value(spark, prompts.token_budget(F.lit("abc"), F.lit(None).cast("boolean"))) == 515
