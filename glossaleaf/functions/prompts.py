"""Prompt rendering and request payloads as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The prompt texts. {name} marks a slot.
TRANSLATOR_SYSTEM = "You are a translator from {annotation_name} to {diary_name}."
TRANSLATOR_USER = """Task:
Translate text in bracketed [text] one by one. The bracketed text is written in {annotation_name}. The translation target language is {diary_name}.
IMPORTANT: Return the result ONLY as XML in the following structure:

        <bracket>[text]</bracket><translation>corresponding translation</translation>
    

INPUT: {expressions}"""
ARCHIVIST_SYSTEM = "You are a strict language grammarian of {diary_code}."
ARCHIVIST_USER = """Task: Identify ALL grammatical, vocabulary, or spelling errors in the user's draft.
For EACH error, output an XML block exactly like this:

<error>
  <rule>The specific rule violated</rule>
  <phrase>The incorrect phrase from text</phrase>
  <correction>The corrected phrase</correction>
  <category>Grammar OR Vocabulary OR Spelling</category>
</error>

If there are no errors, output: <no_errors/>

Draft: {draft}"""
REWRITER_SYSTEM = "You are an expert {diary_name} editor."
REWRITER_USER = """Task:
1. Rewrite the following text (in the {level} level of the CEFR). The rewriting language must stick with language={diary_name}
IMPORTANT: Return the result ONLY as XML in the following structure:
<rewriting>rewritten text</rewriting>

Input: {draft}"""
REWRITER_RETRY = """IMPORTANT: Return the result ONLY as XML in the following structure:
<rewriting>rewritten text</rewriting>
"""
REVIEWER_SYSTEM = 'You are a "Memory Coach" for a language learner. Your goal is to analyze the user CURRENT MISTAKES and compare them against their ERROR HISTORY.'
REVIEWER_USER = """1. **Current Mistakes:** A list of errors found in the user's latest diary entry.
2. **Error History:** A list of similar errors the user made in the past (retrieved from database). 
### INSTRUCTIONS
Step 1: Compare the "Current Mistakes" with the "Error History".
Step 2: Classify the situation into one of two categories:
   - **"RECURRING"**: The user made a mistake similar to one in history (e.g., gender agreement again, same vocabulary word).
   - **"NEW"**: These are fresh mistakes not seen in the provided history.
Step 3: Generate a short, helpful message.
   - If RECURRING: Be firm but encouraging. Remind them of the specific rule they forgot.
   - If NEW: Be gentle. Explain the new concept briefly.
   - The user's target learning level is {level}
IMPORTANT: Return the result ONLY as XML in the following structure:
<review>review contents</review>

Current Mistakes: {mistakes}
Error History: {history}
Vocabularies that user does not know: {expressions}"""


def render(template: str, **slots: Column) -> Column:
    """The template as a concat of its fixed parts and the slot columns."""
    parts: list[Column] = []
    rest = template
    while rest:
        starts = [(rest.find("{" + name + "}"), name) for name in slots]
        hits = [hit for hit in starts if hit[0] >= 0]
        if not hits:
            parts.append(F.lit(rest))
            break
        at, name = min(hits)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(slots[name])
        rest = rest[at + len(name) + 2:]
    return F.concat(*parts)


# The short escapes of JSON.
SHORT_ESCAPES = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def json_string(value: Column) -> Column:
    """A JSON string in plain ASCII: other characters become short or ``\\uXXXX`` escapes."""
    short = F.create_map(*[F.lit(x) for pair in SHORT_ESCAPES.items() for x in pair])

    def unit(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(code.cast("long")), 4, "0")))

    def escape(ch: Column) -> Column:
        code = F.ascii(ch)
        over = code - 0x10000
        pair = F.concat(
            unit(F.shiftright(over, 10) + 0xD800), unit(over.bitwiseAND(F.lit(0x3FF)) + 0xDC00)
        )
        return F.coalesce(F.try_element_at(short, ch), F.when(code >= 0x10000, pair).otherwise(unit(code)))

    body = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    # only the other characters become array items, however long the text
    other = r"[^\x20-\x7E]"
    escaped = F.transform(F.regexp_extract_all(body, F.lit(other), F.lit(0)), escape)
    endings = F.array_append(escaped, F.lit(""))
    pieces = F.zip_with(F.split(body, other), endings, lambda piece, ending: F.concat(piece, ending))
    ascii_body = F.when(F.regexp_like(body, F.lit(other)), F.array_join(pieces, "")).otherwise(body)
    return F.concat(F.lit('"'), ascii_body, F.lit('"'))


def json_list(values: Column) -> Column:
    """A string array as JSON text with ``", "`` between the items."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, json_string), ", "), F.lit("]"))


def translator_prompt(annotation_name: Column, diary_name: Column, expressions: Column) -> Column:
    slots = {"annotation_name": annotation_name, "diary_name": diary_name}
    return F.struct(
        render(TRANSLATOR_SYSTEM, **slots).alias("system"),
        render(TRANSLATOR_USER, **slots, expressions=json_list(expressions)).alias("user"),
    )


def archivist_prompt(diary_code: Column, draft: Column) -> Column:
    return F.struct(
        render(ARCHIVIST_SYSTEM, diary_code=diary_code).alias("system"),
        render(ARCHIVIST_USER, draft=draft).alias("user"),
    )


def rewriter_prompt(
    diary_name: Column, level: Column, draft: Column, failed_parses: Column | None = None
) -> Column:
    """``failed_parses`` earlier answers without a tag each repeat the format demand."""
    user = render(REWRITER_USER, diary_name=diary_name, level=level, draft=draft)
    if failed_parses is not None:
        user = F.concat(user, F.repeat(F.lit(REWRITER_RETRY), failed_parses))
    return F.struct(render(REWRITER_SYSTEM, diary_name=diary_name).alias("system"), user.alias("user"))


def reviewer_prompt(level: Column, mistakes: Column, history: Column, expressions: Column) -> Column:
    return F.struct(
        F.lit(REVIEWER_SYSTEM).alias("system"),
        render(
            REVIEWER_USER, level=level, mistakes=mistakes, history=history, expressions=expressions
        ).alias("user"),
    )


def chat_role(kind: Column) -> Column:
    """Message kinds to chat roles; anything unknown speaks as the user."""
    return (
        F.when(kind == "system", F.lit("system"))
        .when(kind == "human", F.lit("user"))
        .when(kind == "ai", F.lit("assistant"))
        .otherwise(F.lit("user"))
    )


def chat_message(role: Column, content: Column) -> Column:
    return F.concat(
        F.lit('{"role": '), json_string(role), F.lit(', "content": '), json_string(content), F.lit("}")
    )


def chat_json(prompt: Column) -> Column:
    """A system/user prompt struct as the JSON chat a model server takes."""
    return F.concat(
        F.lit("["),
        chat_message(F.lit("system"), prompt["system"]),
        F.lit(", "),
        chat_message(F.lit("user"), prompt["user"]),
        F.lit("]"),
    )


def generate_request(
    prompt: Column,
    max_length: Column | None = None,
    temperature: Column | None = None,
    enable_thinking: Column | None = None,
) -> Column:
    """Request body of a server that takes the chat as one text."""
    return F.to_json(
        F.struct(
            prompt.alias("prompt"),
            with_default(max_length, 512).alias("max_length"),
            with_default(temperature, 0.7).alias("temperature"),
            with_default(enable_thinking, True).alias("enable_thinking"),
        )
    )


def chat_request(
    model: Column,
    prompt: Column,
    max_tokens: Column | None = None,
    max_length: Column | None = None,
    temperature: Column | None = None,
    top_p: Column | None = None,
    stop: Column | None = None,
) -> Column:
    """Request body of a server that takes messages and options; max_tokens goes before
    max_length. ``stop`` is an array of texts at which the server ends its answer; a null or
    empty one is left out."""
    limits = [c for c in (max_tokens, max_length) if c is not None]
    messages = [
        F.struct(F.lit(role).alias("role"), prompt[role].alias("content")) for role in ("system", "user")
    ]
    return F.to_json(
        F.struct(
            model.alias("model"),
            F.array(*messages).alias("messages"),
            F.lit(False).alias("stream"),
            F.struct(
                with_default(temperature, 0.7).alias("temperature"),
                F.coalesce(*limits, F.lit(512)).alias("num_predict"),
                with_default(top_p, 0.9).alias("top_p"),
                *([] if stop is None else [F.when(F.size(stop) > 0, stop).alias("stop")]),
            ).alias("options"),
        )
    )


def with_default(value: Column | None, default) -> Column:
    return F.lit(default) if value is None else F.coalesce(value, F.lit(default))


def token_budget(draft: Column, enable_thinking: Column) -> Column:
    """Draft length plus 512, twice that when the model may think."""
    room = F.length(draft) + 512
    return F.when(F.coalesce(enable_thinking, F.lit(False)), room * 2).otherwise(room)


def task_settings(
    is_execute: Column | None, max_tokens: Column | None, enable_thinking: Column | None, always: bool
) -> Column:
    """One task's settings with defaults; ``always`` tasks run whatever was submitted."""
    runs = F.lit(True) if always else with_default(is_execute, False)
    return F.struct(
        runs.alias("is_execute"),
        with_default(max_tokens, 512).alias("max_tokens"),
        with_default(enable_thinking, False).alias("enable_thinking"),
    )
