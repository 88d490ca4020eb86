"""Column expressions that read model responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossaleaf.functions.text import PY_SPACE_CLASS, drop_square_brackets, strip

# Tags and patterns of the response formats.
ASSISTANT_MARK = "<|assistant|>"
NO_ERRORS = "<no_errors/>"
PAIR = (
    r"(?s)<bracket>(.*?)</bracket>" + PY_SPACE_CLASS + r"?+<translation>(.*?)</translation>"
)
ERROR_BLOCK = r"(?s)<error>(.*?)</error>"
REWRITING = r"(?s)<rewriting>(.*?)</rewriting>"
REVIEW = r"(?s)<review>(.*?)</review>"

PAIRS_TYPE = "array<struct<expression_original:string,expression_translation:string>>"
ERRORS_TYPE = "array<struct<error_rule:string,example_phrase:string,correction:string,category:string>>"


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _drop_first(items: Column) -> Column:
    return F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0)))


def _says_no_errors(text: Column) -> Column:
    """The tag twice: once from the echoed prompt, once as the answer."""
    return F.regexp_count(text, F.lit(NO_ERRORS)) > 1


def response_tail(response: Column) -> Column:
    """What follows the last assistant mark; the whole text if there is none."""
    return F.substring_index(response, ASSISTANT_MARK, -1)


def all_pairs(text: Column) -> Column:
    """Every bracket/translation pair in the text, before the echo rule."""
    zipped = F.arrays_zip(_all(text, PAIR, 1).alias("o"), _all(text, PAIR, 2).alias("t"))
    return F.transform(
        zipped,
        lambda p: F.struct(
            strip(p["o"]).alias("expression_original"),
            p["t"].alias("expression_translation"),
        ),
    )


def keep_answers(text: Column, pairs: Column, n_expected: Column, skip_first: bool = True) -> Column:
    """Applies the echo rule: a count other than the expected one means that the first
    pair is the echoed template."""
    none = F.array().cast(PAIRS_TYPE)
    if not skip_first:
        return F.when(_says_no_errors(text), none).otherwise(pairs)
    return (
        F.when(_says_no_errors(text), none)
        .when(F.size(pairs) == n_expected, pairs)
        .when(F.size(pairs) == 1, none)
        .otherwise(_drop_first(pairs))
    )


def error_blocks(response: Column, skip_first: bool = True) -> Column:
    """The grammar errors a response lists; the first block is the echoed template."""
    blocks = _all(response, ERROR_BLOCK)
    none = F.array().cast("array<string>")
    kept = F.when(_says_no_errors(response), none)
    kept = kept.otherwise(_drop_first(blocks)) if skip_first else kept.otherwise(blocks)

    def tag(block: Column, name: str) -> Column:
        return strip(F.try_element_at(_all(block, f"(?s)<{name}>(.*?)</{name}>"), F.lit(1)))

    read = F.transform(
        kept,
        lambda b: F.struct(
            tag(b, "rule").alias("error_rule"),
            F.coalesce(tag(b, "phrase"), F.lit("")).alias("example_phrase"),
            tag(b, "correction").alias("correction"),
            F.coalesce(tag(b, "category"), F.lit("None")).alias("category"),
        ),
    )
    return F.filter(read, lambda e: e["error_rule"].isNotNull() & e["correction"].isNotNull())


def last_rewriting(response: Column) -> Column:
    """Inner text of the last rewriting tag; null without one."""
    return F.try_element_at(_all(response, REWRITING), F.lit(-1))


def review_text(response: Column) -> Column:
    """Inner text of the last review tag, else the whole response."""
    return F.coalesce(F.try_element_at(_all(response, REVIEW), F.lit(-1)), response)


def rewrite_status(
    response: Column, finish_reason: Column, detected_language: Column, diary_language: Column
) -> Column:
    return (
        F.when(last_rewriting(response).isNull(), F.lit("xml_error"))
        .when(finish_reason == "length", F.lit("insufficient_length"))
        .when(~detected_language.eqNullSafe(diary_language), F.lit("incorrect_language"))
        .otherwise(F.lit("success"))
    )


def rewriting_text(response: Column, status: Column) -> Column:
    """The accepted text without square brackets; otherwise the full response."""
    return F.when(
        status == "success", drop_square_brackets(last_rewriting(response))
    ).otherwise(response)


def without_prompt(response: Column, prompt: Column) -> Column:
    """The response without the echoed prompt, trimmed."""
    return strip(F.replace(response, prompt, F.lit("")))


def finish_reason(
    output_ids: Column, input_ids: Column, max_new_tokens: Column, eos_token_id: Column
) -> Column:
    """Why a generation ended, from its token ids (the output holds the prompt ids too)."""
    return (
        F.when(F.try_element_at(output_ids, F.lit(-1)) == eos_token_id, F.lit("stop"))
        .when(F.size(output_ids) - F.size(input_ids) >= max_new_tokens, F.lit("length"))
        .otherwise(F.lit("unknown"))
    )


def done_reason(reported: Column) -> Column:
    """A server's own reason; nothing reported means a normal stop."""
    return F.when(F.length(reported) > 0, reported).otherwise(F.lit("stop"))


def total_tokens(prompt_tokens: Column, completion_tokens: Column) -> Column:
    return F.coalesce(prompt_tokens, F.lit(0)) + F.coalesce(completion_tokens, F.lit(0))
