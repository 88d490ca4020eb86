"""Every registered query: (spark, sf_dir) -> DataFrame over the whole given tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaleaf.functions import keys, prompts, responses, text
from glossaleaf.functions.rows import explode_rows
from glossaleaf.languages import Languages
from glossaleaf.operators import (
    errors, intake, langid, line_edits, memory, models, pivot_search, rewriting, store, translation, vector_index, versions,
    views,
)
from glossaleaf.plans import analysis
from glossaleaf.session import fresh_path, materialize
from glossaleaf.sources import given, keyed_table
from glossaleaf.sources.tables import spread
from glossaleaf.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# the entry whose expressions the lookup query shows
LOOKUP_DOC = 7
RECURRING_WITHIN = 0.5
# the given vectors hardly cluster, so most lists must be asked for nine of ten hits
INDEX_LISTS, INDEX_PROBES = 16, 13
# minutes until a job without an end counts as failed
STUCK_AFTER = 600


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# ---- text extraction ----


@query
def brackets(spark, sf):
    return explode_rows(given.drafts(spark, sf), ["doc_id"], "expressions", "ordinal", "expression")


@query
def draft_without_brackets(spark, sf):
    body = text.without_brackets(F.col("draft"))
    cut = text.without_brackets(F.col("draft"), greedy=True)
    return given.drafts(spark, sf).select("doc_id", body.alias("body"), cut.alias("greedy_body"))


@query
def annotation_text(spark, sf):
    return given.drafts(spark, sf).select("doc_id", text.annotation_text(F.col("expressions")).alias("annotation"))


# ---- translation ----


@query
def response_tail(spark, sf):
    return given.translator_responses(spark, sf).select(
        "doc_id", responses.response_tail(F.col("response")).alias("tail")
    )


@query
def translation_pairs(spark, sf):
    pairs = translation.with_pairs(given.translator_responses(spark, sf))
    return explode_rows(pairs, ["doc_id"], "pairs", "ordinal", "pair").select("doc_id", "ordinal", "pair.*")


@query
def translate_ok(spark, sf):
    return given.translated(spark, sf).select("doc_id", "n_expected", "n_parsed", "translate_status")


@query
def draft_replaced(spark, sf):
    return given.translated(spark, sf).select("doc_id", "draft_replaced")


@query
def draft_replaced_by_pattern(spark, sf):
    pairs = translation.with_pairs(given.translator_responses(spark, sf))
    return translation.with_substitution(pairs, strict=False).select("doc_id", "translate_status", "draft_replaced")


@query
def pair_spans(spark, sf):
    placed = explode_rows(given.translated(spark, sf), ["doc_id"], "spans", "ordinal", "s")
    return placed.select(
        "doc_id",
        "ordinal",
        "s.expression_original",
        "s.expression_translation",
        F.col("s.span_original.start").alias("original_start"),
        F.col("s.span_original.end").alias("original_end"),
        F.col("s.span_translation.start").alias("translation_start"),
        F.col("s.span_translation.end").alias("translation_end"),
    )


def _flat_spans(df: DataFrame) -> DataFrame:
    return df.withColumns({c: keys.span_to_text(F.col(c)) for c in ("span_original", "span_translation")})


@query
def pairs_to_expressions(spark, sf):
    return _flat_spans(given.unknown_expressions(spark, sf))


@query
def expression_keys(spark, sf):
    d = explode_rows(given.drafts(spark, sf), ["primary_id", "created_at"], "expressions", "_n", "expression")
    key = keys.expression_key(F.col("primary_id"), F.col("expression"), F.col("created_at"))
    return d.select(F.col("primary_id").alias("entry"), "expression", key.alias("expression_id"))


@query
def span_codec(spark, sf):
    spans = given.unknown_expressions(spark, sf).select(
        "primary_id", keys.span_to_text(F.col("span_original")).alias("span_text")
    )
    back = spans.withColumn("span", keys.span_from_text(F.col("span_text")))
    return back.select(
        "primary_id", "span_text", F.col("span.start").alias("span_start"), F.col("span.end").alias("span_end")
    )


@query
def vocabulary(spark, sf):
    return views.vocabulary(given.unknown_expressions(spark, sf))


@query
def expressions_for_entry(spark, sf):
    entry = spark.range(1).select(given.diary_key(F.lit(LOOKUP_DOC))).first()[0]
    found = views.expressions(given.unknown_expressions(spark, sf), entry)
    return found.select("primary_id", "expression", "expression_translation")


@query
def delete_expressions(spark, sf):
    table = given.unknown_expressions(spark, sf)
    hidden = given.diary_entries(spark, sf).filter("not is_show").select(F.col("primary_id").alias("hidden_id"))
    removed = table.join(hidden, F.col("primary_id_DiaryEntry") == F.col("hidden_id"), "left_semi")
    return store.delete_rows(table, removed).select("primary_id", "expression")


@query
def expression_changes(spark, sf):
    table = given.unknown_expressions(spark, sf)
    args = (F.col("primary_id"), F.col("expression"), F.col("expression_translation"))
    added = versions.expression_change("add", *args)
    deleted = versions.expression_change("delete", *args)
    return table.select("primary_id", added.alias("add_change"), deleted.alias("delete_change"))


@query
def added_by_hand(spark, sf):
    """Expressions entered by hand for every visible entry: no position, a new version."""
    shown = views.entries(given.diary_entries(spark, sf))
    made = shown.select(
        F.col("primary_id").alias("primary_id_DiaryEntry"),
        F.col("title_diary").alias("expression"),
        F.col("model_id_tutor").alias("expression_translation"),
        keys.by_hand().alias("span_original"),
        keys.by_hand().alias("span_translation"),
        keys.expression_key(F.col("primary_id"), F.col("title_diary"), F.col("created_at")).alias("primary_id"),
    )
    return _flat_spans(made)


# ---- errors ----


def _checked_errors(spark, sf):
    return errors.with_validity(errors.error_rows(given.error_source(spark, sf)), Languages(spark))


@query
def error_blocks(spark, sf):
    return errors.error_rows(given.error_source(spark, sf)).select(
        "primary_id_DiaryEntry", "error_no", "error_rule", "example_phrase", "correction", "category"
    )


@query
def errors_valid(spark, sf):
    return errors.valid(_checked_errors(spark, sf))


@query
def errors_rejected(spark, sf):
    return errors.rejected(_checked_errors(spark, sf)).select("primary_id_DiaryEntry", "error_no", "reject_reason")


@query
def errors_noop_dropped(spark, sf):
    return errors.without_noops(errors.valid(_checked_errors(spark, sf))).select(
        "primary_id_DiaryEntry", "error_no", "example_phrase", "correction"
    )


@query
def error_memory(spark, sf):
    found = errors.without_noops(errors.valid(_checked_errors(spark, sf)))
    return memory.to_memory(found).drop("error_no")


def letter_counts(texts: list[str]) -> list[list[float]]:
    """A stand-in for an embedding model: how often each vowel occurs."""
    return [[float(t.count(letter)) for letter in "aeiou"] for t in texts]


@query
def embedded_errors(spark, sf):
    stored = memory.to_memory(given.error_memory(spark, sf).drop("embedding"))
    vector = models.embed(stored, "page_content", letter_counts)
    cells = [F.get("embedding", i).alias(f"v{i}") for i in range(5)]
    return vector.select("error_id", "page_content", *cells)


@query
def errors_for_entry(spark, sf):
    languages = Languages(spark)
    shown = views.entries(given.diary_entries(spark, sf))
    found = views.errors_of(given.error_memory(spark, sf), shown)
    return errors.valid(errors.with_validity(found, languages)).select("error_id", *errors.RECORD)


@query
def errors_by_lang(spark, sf):
    chosen = views.errors_by_language(given.error_memory(spark, sf), ["fra", "spa"])
    return chosen.select("error_id", "language_diary_text", "error_rule")


@query
def error_languages(spark, sf):
    return views.error_languages(given.error_memory(spark, sf))


@query
def recurring_errors(spark, sf):
    return memory.recurring(_valid_errors(spark, sf), given.error_memory(spark, sf)).select(
        "primary_id_DiaryEntry", "error_no", "error_rule", "category"
    )


@query
def new_errors(spark, sf):
    return memory.fresh(_valid_errors(spark, sf), given.error_memory(spark, sf)).select(
        "primary_id_DiaryEntry", "error_no", "error_rule", "category"
    )


def _valid_errors(spark, sf):
    return errors.valid(_checked_errors(spark, sf))


def _similar(spark, sf, search=memory.similar_errors, k=10):
    stored = given.error_memory(spark, sf)
    asked = stored.withColumnRenamed("error_id", "query_id")
    return asked, search(asked, stored, k=k, exclude_same_id=True)


@query
def similar_errors_topk(spark, sf):
    _, found = _similar(spark, sf)
    hits = memory.with_texts(found, memory.to_memory(given.error_memory(spark, sf)))
    return hits.select("query_id", "rank", "error_id", F.round("distance", 5).alias("distance"), "page_content")


@query
def similar_errors_approx(spark, sf):
    _, found = _similar(spark, sf, memory.similar_errors_approx)
    return found


@query
def similar_errors_approx_recall(spark, sf):
    """Whether the hashed search finds nine of ten of the exact hits."""
    _, exact = _similar(spark, sf)
    _, found = _similar(spark, sf, memory.similar_errors_approx)
    return vector_index.recall(found, exact).select("n_exact", (F.col("n_found") >= 0.9 * F.col("n_exact")).alias("reached"))


@query
def similar_errors_one_cell(spark, sf):
    """The hashed search with all vectors in one cell, which makes it exact."""
    def search(asked, stored, **options):
        return memory.similar_errors_approx(asked, stored, tables=1, bits=0, **options)

    _, found = _similar(spark, sf, search)
    return found.select("query_id", "rank", "error_id", F.round("distance", 5).alias("distance"))


@query
def similar_errors_pruned(spark, sf):
    """The exact search that leaves out blocks by pivots."""
    _, found = _similar(spark, sf, pivot_search.similar_errors)
    return found.select("query_id", "rank", "error_id", F.round("distance", 5).alias("distance"))


def _stored_index(spark, sf):
    """The error memory as a stored index, appended in two rounds."""
    stored = given.error_memory(spark, sf)
    path = fresh_path(spark, "error-index")
    vector_index.create(stored, path, INDEX_LISTS)
    for odd in (0, 1):
        vector_index.append(path, stored.filter(F.col("error_id") % 2 == odd))
    return path


@query
def stored_index_search(spark, sf):
    """All lists asked and hundreds of codes re-ranked for each hit."""
    path = _stored_index(spark, sf)

    def search(asked, stored, **options):
        return vector_index.search(path, asked, probes=INDEX_LISTS, again=100, **options)

    _, found = _similar(spark, sf, search)
    return found.select("query_id", "rank", "error_id", F.round("distance", 5).alias("distance"))


@query
def stored_index_recall(spark, sf):
    """Some of the lists asked: whether nine of ten of the exact hits are found."""
    path = _stored_index(spark, sf)

    def search(asked, stored, **options):
        return vector_index.search(path, asked, probes=INDEX_PROBES, **options)

    _, exact = _similar(spark, sf)
    _, found = _similar(spark, sf, search)
    return vector_index.recall(found, exact).select("n_exact", (F.col("n_found") >= 0.9 * F.col("n_exact")).alias("reached"))


@query
def recurring_by_distance(spark, sf):
    asked, found = _similar(spark, sf, k=1)
    return memory.label_by_distance(asked, found, RECURRING_WITHIN)


# ---- rewriting and review ----


def _attempts(spark, sf):
    return rewriting.classify_attempts(given.rewriter_attempts(spark, sf))


@query
def rewrite_status(spark, sf):
    return _attempts(spark, sf).select("doc_id", "attempt", "status")


@query
def rewriting_text(spark, sf):
    return _attempts(spark, sf).select("doc_id", "attempt", "rewriting")


@query
def rewrite_attempts(spark, sf):
    return rewriting.chosen_attempts(_attempts(spark, sf), "doc_id")


@query
def review_text(spark, sf):
    answers = given.review_answers(spark, sf)
    return answers.select("doc_id", responses.review_text(F.col("response")).alias("review"))


# ---- prompts, settings, generation logs ----


def _named_drafts(spark, sf):
    languages = Languages(spark)
    named = languages.named(given.drafts(spark, sf), "language_source", "diary_name")
    return languages.named(named, "language_annotation", "annotation_name")


@query
def lang_names(spark, sf):
    return _named_drafts(spark, sf).select(
        "doc_id", "language_source", "diary_name", "language_annotation", "annotation_name"
    )


def _prompt(df: DataFrame, prompt) -> DataFrame:
    return df.select("doc_id", prompt.alias("p")).select("doc_id", "p.system", "p.user")


def _translator_prompts(spark, sf):
    return prompts.translator_prompt(F.col("annotation_name"), F.col("diary_name"), F.col("expressions"))


@query
def prompt_translator(spark, sf):
    return _prompt(_named_drafts(spark, sf), _translator_prompts(spark, sf))


@query
def prompt_archivist(spark, sf):
    d = given.translated(spark, sf).filter("translate_status = 'ok'")
    return _prompt(d, prompts.archivist_prompt(F.col("language_source"), F.col("draft_replaced")))


@query
def prompt_rewriter(spark, sf):
    d = Languages(spark).named(
        given.translated(spark, sf).filter("translate_status = 'ok'"), "language_source", "diary_name"
    )
    return _prompt(d, prompts.rewriter_prompt(F.col("diary_name"), F.col("level_rewriting"), F.col("draft_replaced")))


@query
def prompt_reviewer(spark, sf):
    d = given.archivist_responses(spark, sf)
    mistakes = F.to_json(responses.error_blocks(F.col("response")))
    return _prompt(
        d,
        prompts.reviewer_prompt(
            F.col("level_rewriting"), mistakes, F.lit("[]"), prompts.json_list(F.col("expressions"))
        ),
    )


@query
def prompt_reviewer_history(spark, sf):
    """Reviewer prompts with the past errors that resemble the draft's own."""
    own = errors.without_noops(errors.valid(_checked_errors(spark, sf)))
    own = own.withColumn("query_id", F.xxhash64("primary_id_DiaryEntry", "error_no"))
    asked = models.embed(memory.to_memory(own), "page_content", letter_counts)
    stored = models.embed(memory.to_memory(given.error_memory(spark, sf).drop("embedding")), "page_content", letter_counts)
    # vectors have several readers; the model is asked once
    asked, stored = materialize(asked, "asked"), materialize(stored, "stored")
    past = memory.past_errors(asked, stored, "primary_id_DiaryEntry").withColumnRenamed("primary_id_DiaryEntry", "primary_id")
    d = given.archivist_responses(spark, sf).join(past, "primary_id", "left")
    history = prompts.json_list(F.coalesce("past", F.array().cast("array<string>")))
    mistakes = F.to_json(responses.error_blocks(F.col("response")))
    return _prompt(d, prompts.reviewer_prompt(F.col("level_rewriting"), mistakes, history, prompts.json_list(F.col("expressions"))))


@query
def chat_payload(spark, sf):
    d = _named_drafts(spark, sf).withColumn("p", _translator_prompts(spark, sf))
    return d.select(
        "doc_id",
        prompts.chat_json(F.col("p")).alias("prompt"),
        prompts.with_default(F.when(given.case("doc_id", 2, 0), 900), 512).alias("max_length"),
        prompts.with_default(None, 0.7).alias("temperature"),
        prompts.with_default(F.when(given.case("doc_id", 3, 0), F.lit(False)), True).alias("enable_thinking"),
        prompts.with_default(None, 0.9).alias("top_p"),
    )


@query
def request_bodies(spark, sf):
    d = _named_drafts(spark, sf).withColumn("p", _translator_prompts(spark, sf))
    limit = F.when(given.case("doc_id", 2, 0), 900)
    return d.select(
        "doc_id",
        prompts.generate_request(prompts.chat_json(F.col("p")), limit).alias("generate_body"),
        prompts.chat_request(F.lit("tutor"), F.col("p"), None, limit).alias("chat_body"),
    )


@query
def request_bodies_with_stop(spark, sf):
    """Chat requests that end at a closing tag; every third asks for no stop."""
    d = _named_drafts(spark, sf).withColumn("p", _translator_prompts(spark, sf))
    stop = F.when(~given.case("doc_id", 3, 0), F.array(F.lit("</answer>"), F.lit("\n\n")))
    return d.select("doc_id", prompts.chat_request(F.lit("tutor"), F.col("p"), stop=stop).alias("chat_body"))


@query
def chat_messages(spark, sf):
    turns = given.table(spark, sf, "conversations")
    kind = F.when(F.col("role") == "assistant", "ai").when(F.col("role") == "user", "human").otherwise(F.col("role"))
    return turns.select(
        "conv_id", "turn", prompts.chat_message(prompts.chat_role(kind), F.col("text")).alias("message")
    )


def echo_translator(chats: list[str]) -> list[dict]:
    """A stand-in for a text model: answers each bracket of the chat's input list."""
    answers = []
    for chat in chats:
        asked = json.loads(json.loads(chat)[-1]["content"].rsplit("INPUT: ", 1)[-1])
        found = [expression.strip("[]") for expression in asked]
        pairs = [f"<bracket>[{w}]</bracket><translation>t_{w}</translation>" for w in found]
        answers.append({"content": "".join(pairs), "finish_reason": "stop", "completion_tokens": len(found)})
    return answers


@query
def generated_translations(spark, sf):
    d = _named_drafts(spark, sf).withColumn("p", _translator_prompts(spark, sf))
    requests = d.select("doc_id", prompts.chat_json(F.col("p")).alias("chat"))
    answered = models.generate(requests, echo_translator)
    return answered.select("doc_id", "response", "finish_reason", "completion_tokens", "error")


@query
def token_budget(spark, sf):
    d = given.drafts(spark, sf)
    thinks = given.case("doc_id", 2, 0)
    return d.select("doc_id", prompts.token_budget(F.col("draft"), thinks).alias("max_tokens"))


@query
def task_settings(spark, sf):
    settings = intake.with_settings(given.submissions(spark, sf))
    fields = ["is_execute", "max_tokens", "enable_thinking"]
    return settings.select(
        "doc_id",
        *[F.col(f"config_{t}.{f}").alias(f"{t}_{f}") for t in ("translator", "archivist", "rewriter", "reviewer") for f in fields],
    )


@query
def step_gates(spark, sf):
    d = given.translated(spark, sf)
    success = F.col("translate_status") == "ok"
    runs = given.case("n_chars", 2, 0)
    return d.select(
        "doc_id",
        intake.gate(success, F.lit(True), F.lit("list errors")).alias("archivist"),
        intake.gate(success, runs, F.lit("rewrite")).alias("rewriter"),
        intake.gate(success, ~runs, F.lit("review")).alias("reviewer"),
    )


@query
def response_clean(spark, sf):
    turns = given.table(spark, sf, "conversations")
    prompt = F.substring_index("text", ".", 1)
    return turns.select("conv_id", "turn", responses.without_prompt(F.col("text"), prompt).alias("answer"))


@query
def finish_reason(spark, sf):
    log = given.generation_log(spark, sf)
    reason = responses.finish_reason(
        F.col("output_ids"), F.col("input_ids"), F.col("max_new_tokens"), F.col("eos_token_id")
    )
    reported = F.when(F.col("turn") == 0, "").when(F.col("turn") == 1, "length")
    return log.select("conv_id", "turn", reason.alias("reason"), responses.done_reason(reported).alias("done_reason"))


@query
def token_usage(spark, sf):
    total = responses.total_tokens(F.col("prompt_eval_count"), F.col("eval_count"))
    return given.generation_log(spark, sf).groupBy("model_name").agg(
        F.sum(F.coalesce("prompt_eval_count", F.lit(0))).alias("prompt_tokens"),
        F.sum(F.coalesce("eval_count", F.lit(0))).alias("completion_tokens"),
        F.sum(total).alias("total_tokens"),
    )


# ---- intake ----


def _checked_submissions(spark, sf):
    return intake.checked(given.submissions(spark, sf), Languages(spark))


@query
def intake_valid(spark, sf):
    good = intake.with_codes(intake.with_keys(intake.valid(_checked_submissions(spark, sf))))
    return good.select("job_id", "primary_id", "title_diary", "language_source", "language_annotation", "level_rewriting")


@query
def intake_rejected(spark, sf):
    return intake.rejected(_checked_submissions(spark, sf)).select("job_id", "reject_reason")


@query
def initial_status(spark, sf):
    return intake.initial_status(intake.with_keys(intake.valid(_checked_submissions(spark, sf))))


@query
def job_failures(spark, sf):
    """The state in which rejected jobs end, with its message."""
    checked = intake.checked(given.submissions(spark, sf), Languages(spark))
    return intake.failure_status(intake.with_keys(intake.rejected(checked)))


@query
def lang_code_invalid(spark, sf):
    code = text.strip(F.col("lang_diary_body"))
    flagged = Languages(spark).flag(given.submissions(spark, sf).withColumn("code", code), "code", "known")
    return flagged.filter(~F.col("known") & (F.col("code") != "")).select("job_id", "code")


@query
def entry_keys(spark, sf):
    d = given.drafts(spark, sf)
    day = F.to_date("created_at")
    return d.select(
        "doc_id",
        keys.entry_key(day, F.col("created_at")).alias("run_key"),
        keys.entry_key(day, F.col("created_at"), "-").alias("record_key"),
    )


@query
def lang_ident(spark, sf):
    texts = spread(given.base(spark, sf), "doc_id")
    return langid.detect(texts, "doc_id", "text", langid.train(texts, "text", "language_source"))


# ---- store and views ----


@query
def scan_diary(spark, sf):
    return views.as_records(given.diary_entries(spark, sf))


@query
def append_diary(spark, sf):
    from glossaleaf.schemas import DIARY_ENTRIES
    from glossaleaf.sources import tables

    path = fresh_path(spark, "diary")
    entries = given.diary_entries(spark, sf)
    before = tables.read_table(spark, path, DIARY_ENTRIES)
    accepted, _ = store.append_new(entries, before, "primary_id", ["created_at"])
    tables.append_table(accepted, path, DIARY_ENTRIES, ["language_source"])
    return views.as_records(tables.read_table(spark, path, DIARY_ENTRIES))


@query
def append_duplicate_keys(spark, sf):
    """Submissions of which some come twice with one key and time, against some stored ones."""
    keyed = intake.with_keys(given.submissions_with_repeats(spark, sf)).select("job_id", "primary_id", "created_at", "title_diary")
    stored = given.diary_entries(spark, sf).filter("not is_show").select("primary_id")
    accepted, refused = store.append_new(keyed, stored, "primary_id", ["created_at", "job_id"])
    outcome = accepted.withColumn("outcome", F.lit("accepted")).unionByName(refused.withColumn("outcome", F.lit("refused")))
    return outcome.select("job_id", "primary_id", "outcome")


@query
def append_expressions(spark, sf):
    """Expression rows appended to their stored table and read back."""
    from glossaleaf.schemas import UNKNOWN_EXPRESSIONS

    return _flat_spans(_appended(spark, given.unknown_expressions(spark, sf), "expressions", UNKNOWN_EXPRESSIONS, ["created_at"]))


@query
def append_history(spark, sf):
    """Version records appended to their stored table and read back."""
    from glossaleaf.schemas import VERSION_HISTORY

    return _appended(spark, version_history(spark, sf), "history", VERSION_HISTORY, ["created_at"], "history_id")


@query
def append_error_memory(spark, sf):
    """Errors embedded, appended to the memory, read back and searched: each finds its like."""
    from glossaleaf.schemas import ERROR_MEMORY

    stored = memory.to_memory(given.error_memory(spark, sf).drop("embedding"))
    made = models.embed(stored, "page_content", letter_counts).withColumn("category", F.col("category"))
    back = _appended(spark, made, "memory", ERROR_MEMORY, ["error_rule"], "example_phrase")
    cells = [F.get("embedding", i).alias(f"v{i}") for i in range(5)]
    return back.select("primary_id_DiaryEntry", "example_phrase", "page_content", *cells)


def _appended(spark, rows, name, schema, order, key="primary_id"):
    from glossaleaf.sources import tables

    path = fresh_path(spark, name)
    accepted, _ = store.append_new(rows, tables.read_table(spark, path, schema), key, order)
    tables.append_table(accepted, path, schema)
    return tables.read_table(spark, path, schema)


@query
def append_new_only(spark, sf):
    events = given.status_events(spark, sf)
    stored = events.filter(F.col("message").endswith("7")).select("job_id").distinct()
    accepted, refused = store.append_new(events, stored, "job_id", ["ts"])
    both = accepted.withColumn("outcome", F.lit("accepted")).unionByName(
        refused.withColumn("outcome", F.lit("refused"))
    )
    return both.groupBy("outcome").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query
def append_null_order(spark, sf):
    """Rows without a time come first of their key, and are accepted like others."""
    events = given.status_events(spark, sf)
    stored = events.filter(F.col("message").endswith("7")).select("job_id").distinct()
    timed = events.withColumn("ts", F.when(F.col("status") != "error", F.col("ts")))
    accepted, refused = store.append_new(timed, stored, "job_id", ["ts", "message"])
    both = accepted.withColumn("outcome", F.lit("accepted")).unionByName(refused.withColumn("outcome", F.lit("refused")))
    return both.select("job_id", "ts", "message", "outcome")


@query
def filter_diary_lang(spark, sf):
    found = views.entries(given.diary_entries(spark, sf), "fra", "eng")
    return found.select("primary_id", "language_source", "language_annotation", "title_diary")


@query
def filter_diary_visible(spark, sf):
    return views.entries(given.diary_entries(spark, sf)).select("primary_id", "is_show", "diary_original")


@query
def diary_list(spark, sf):
    return views.diary_list(given.diary_entries(spark, sf), given.status_events(spark, sf))


@query
def diary_detail(spark, sf):
    errors_table = memory.to_memory(given.error_memory(spark, sf)).drop("embedding", "error_id")
    expression_table = _flat_spans(given.unknown_expressions(spark, sf))
    return views.diary_detail(given.diary_entries(spark, sf), expression_table, errors_table)


@query
def diary_error_join(spark, sf):
    return views.entries_with_errors(given.diary_entries(spark, sf), given.error_memory(spark, sf)).select(
        "primary_id", "error_id", "error_rule", "category", "diary_original", "date_diary", "language_diary_text"
    )


@query
def soft_delete(spark, sf):
    entries = given.diary_entries(spark, sf)
    hidden = given.status_events(spark, sf).filter("status = 'error'").select(F.col("diary_id").alias("primary_id"))
    return store.soft_delete(entries, hidden).select("primary_id", "is_show", "title_diary")


@query
def apply_results(spark, sf):
    done = given.translated(spark, sf).select("primary_id", "created_at", F.col("draft_replaced").alias("diary_replaced"))
    updated = store.apply_updates(
        given.diary_entries(spark, sf), done, "primary_id", ["created_at"], ["diary_replaced"]
    )
    return updated.select("primary_id", "diary_original", "diary_replaced", "is_show")


@query
def merge_latest_wins(spark, sf):
    changes = given.status_events(spark, sf).select(
        F.col("diary_id").alias("primary_id"),
        "ts",
        F.when(F.col("status") == "completed", "C2").alias("level_rewriting"),
        F.minute("ts").alias("current_version"),
    )
    merged = store.apply_updates(
        given.diary_entries(spark, sf), changes, "primary_id", ["ts"], ["level_rewriting", "current_version"]
    )
    return merged.select(
        "primary_id", "level_rewriting", F.coalesce("current_version", F.lit(0)).alias("current_version")
    )


@query
def keyed_table_rounds(spark, sf):
    """A stored table after an update, a soft delete and a delete, each of which writes only the buckets it
    touches."""
    path = fresh_path(spark, "keyed-entries")
    keyed_table.create(given.diary_entries(spark, sf).select("primary_id", "diary_replaced", "is_show"), path, "primary_id")
    done = given.translated(spark, sf).select("primary_id", "created_at", F.col("draft_replaced").alias("diary_replaced"))
    keyed_table.change(path, done, order=["created_at"])
    events = given.status_events(spark, sf)
    hidden = events.filter("status = 'error'").select(F.col("diary_id").alias("primary_id"), F.lit(False).alias("is_show"))
    keyed_table.change(path, hidden)
    gone = events.filter((F.col("status") == "completed") & (F.minute("ts") == 7)).select(F.col("diary_id").alias("primary_id"))
    keyed_table.change(path, deletes=gone)
    return keyed_table.read(spark, path)


@query
def dup_keys(spark, sf):
    return store.repeated_keys(given.status_events(spark, sf), "job_id")


@query
def job_status_latest(spark, sf):
    return views.current_status(given.status_events(spark, sf))


# ---- versions ----


@query
def version_numbers(spark, sf):
    changes = given.status_events(spark, sf).select("diary_id", "ts", "status")
    return versions.version_numbers(changes, "diary_id", ["ts"])


@query
def version_pairs(spark, sf):
    return versions.version_pairs(given.versions(spark, sf), "conv_id", ["turn"], "text")


@query
def version_line_changes(spark, sf):
    return versions.line_changes(given.versions(spark, sf), "conv_id", ["turn"], "text")


@query
def version_diff(spark, sf):
    pairs = versions.version_pairs(given.versions(spark, sf), "conv_id", ["turn"], "text")
    return versions.text_changes(pairs, "diary_rewritten").select("conv_id", "version_from", "version_to", "changes")


@query
def version_line_edits(spark, sf):
    """Lines deleted and inserted at each step, with their places."""
    pairs = versions.version_pairs(given.versions(spark, sf), "conv_id", ["turn"], "text")
    # the pairs have two readers, the texts and the lines
    return line_edits.line_edits(materialize(pairs, "pairs"), ["conv_id", "version_to"])


@query
def version_edits_replayed(spark, sf):
    """Each version's text made anew from the one before it and the line edits."""
    pairs = materialize(versions.version_pairs(given.versions(spark, sf), "conv_id", ["turn"], "text"), "pairs")
    pair = ["conv_id", "version_to"]
    edits = materialize(line_edits.line_edits(pairs, pair), "edits")
    counts = edits.groupBy(*pair).agg(
        (F.count_if(F.col("op") == "insert") - F.count_if(F.col("op") == "delete")).alias("more_lines")
    )
    return line_edits.replay(pairs, edits, pair).join(counts, pair)


@query
def version_history(spark, sf):
    table = given.unknown_expressions(spark, sf)
    change = versions.expression_change(
        "add", F.col("primary_id"), F.col("expression"), F.col("expression_translation")
    )
    changes = table.select("primary_id_DiaryEntry", "created_at", F.col("primary_id").alias("change_id"), change.alias("changes"))
    return versions.history_rows(changes, ["created_at", "change_id"])


@query
def current_versions(spark, sf):
    """Added expressions raise the version of their entry."""
    table = given.unknown_expressions(spark, sf)
    changes = table.select("primary_id_DiaryEntry", "created_at", F.col("primary_id").alias("change_id"), F.lit("{}").alias("changes"))
    history = versions.history_rows(changes, ["created_at", "change_id"])
    raised = versions.apply_versions(views.as_records(given.diary_entries(spark, sf)), history)
    return raised.select("primary_id", "current_version", "title_diary")


@query
def edit_texts(spark, sf):
    entries = views.as_records(given.diary_entries(spark, sf))
    updated, _ = versions.edit_texts(entries, given.text_edits(spark, sf), "diary_rewritten")
    return updated.select("primary_id", "diary_rewritten", "current_version")


@query
def edit_history(spark, sf):
    entries = views.as_records(given.diary_entries(spark, sf))
    _, records = versions.edit_texts(entries, given.text_edits(spark, sf), "diary_rewritten")
    return records


@query
def edit_records(spark, sf):
    """The records of the edits without their diffs."""
    return edit_history(spark, sf).drop("changes")


@query
def edits_replayed(spark, sf):
    """The texts of an entry's versions, each made from the one before and the record's payload."""
    entries = views.as_records(given.diary_entries(spark, sf))
    edits = given.text_edits(spark, sf)
    _, records = versions.edit_texts(entries, edits, "diary_rewritten", by_line=True)
    texts = entries.select("primary_id", F.lit(None).cast("timestamp").alias("at"), F.col("diary_rewritten").alias("text"))
    known = edits.filter("text is not null").join(entries.select("primary_id"), "primary_id", "left_semi")
    pairs = versions.version_pairs(texts.unionByName(known), "primary_id", ["at"], "text")
    steps = line_edits.from_payloads(
        records.withColumnRenamed("primary_id_DiaryEntry", "primary_id"), ["primary_id", "version_to"], "diary_rewritten"
    )
    return line_edits.replay(pairs, steps, ["primary_id", "version_to"])


@query
def edit_from_stored_version(spark, sf):
    """Edits and added expressions of entries that have versions already."""
    entries = given.stored_entries(spark, sf)
    updated, records = versions.edit_texts(entries, given.text_edits(spark, sf), "diary_rewritten")
    seen = records.groupBy(F.col("primary_id_DiaryEntry").alias("primary_id")).agg(
        F.min("version_from").alias("first_from"), F.max("version_to").alias("last_to")
    )
    return updated.join(seen, "primary_id", "left").select("primary_id", "current_version", "first_from", "last_to")


@query
def history_from_stored_version(spark, sf):
    table = given.unknown_expressions(spark, sf)
    changes = table.select("primary_id_DiaryEntry", "created_at", F.col("primary_id").alias("change_id"), F.lit("{}").alias("changes"))
    rows = versions.history_rows(changes, ["created_at", "change_id"], entries=given.stored_entries(spark, sf))
    return rows.select("history_id", "primary_id_DiaryEntry", "version_from", "version_to")


# ---- the whole chain ----


def _chain(spark, sf, submissions=None, stored=None, embedder="embedder", **options):
    answers = [given.translator_responses(spark, sf), given.archivist_responses(spark, sf)]
    return analysis.analyse(
        given.submissions_with_repeats(spark, sf) if submissions is None else submissions,
        *[a.select("primary_id", "response") for a in answers],
        given.rewriter_attempts(spark, sf).select("primary_id", "attempt", "response", "finish_reason", "detected_language"),
        given.review_answers(spark, sf).select("primary_id", "response"),
        Languages(spark),
        "tutor",
        embedder,
        stored=stored,
        **options,
    )


def _stream_chain(spark, sf, name, remember=False):
    """The chain over submissions that arrive in two parts, with a restart between; those that come
    again are in the second. The tests hold all eight tables against the batch chain."""
    rows = given.submissions_with_repeats(spark, sf)
    late = F.col("job_id").endswith("-again") | (F.pmod(F.xxhash64("job_id"), F.lit(3)) == 0)
    parts = [rows.filter(~late), rows.filter(late)]

    def analyse(submissions, stored, remembered=None):
        return _chain(spark, sf, submissions, stored, embed=letter_counts if remember else None, remembered=remembered)

    return jobs.chain_by_stream(spark, parts, analyse, name, remember)


@query
def stream_chain_memory(spark, sf):
    """The error memory that the stream's batches leave behind."""
    cells = [F.get("embedding", i).alias(f"v{i}") for i in range(5)]
    return _stream_chain(spark, sf, "errors", remember=True).select("primary_id_DiaryEntry", "page_content", *cells)


@query
def chain_past_errors(spark, sf):
    """The remembered errors that resemble an entry's own, as the reviewer is told them."""
    known = memory.to_memory(given.error_memory(spark, sf).drop("embedding"))
    known = materialize(models.embed(known, "page_content", letter_counts), "remembered")
    done = _chain(spark, sf, embedder="model-0", embed=letter_counts, remembered=known)
    return done.past.select("primary_id_DiaryEntry", prompts.json_list(F.col("past")).alias("history"))


@query
def chain_detected(spark, sf):
    """The chain's languages where blank codes are detected."""
    profile = langid.train(given.base(spark, sf), "text", "language_source")
    entries = _chain(spark, sf, profile=profile).entries
    return entries.select("primary_id", "language_source", "language_annotation")


@query
def stream_chain_entries(spark, sf):
    return views.as_records(_stream_chain(spark, sf, "entries"))


@query
def stream_chain_status(spark, sf):
    return _stream_chain(spark, sf, "status")


@query
def chain_entries(spark, sf):
    return views.as_records(_chain(spark, sf).entries)


@query
def chain_expressions(spark, sf):
    return _flat_spans(_chain(spark, sf).expressions)


@query
def chain_errors(spark, sf):
    return _chain(spark, sf).errors.drop("error_no")


@query
def chain_reviews(spark, sf):
    return _chain(spark, sf).reviews


@query
def chain_status(spark, sf):
    return _chain(spark, sf).status


# ---- streams ----


@query
def stream_job_status(spark, sf):
    return jobs.status_by_stream(spark, sf)


@query
def stream_key_sketch(spark, sf):
    return jobs.first_in_many_batches(spark, sf, sketched=True)


@query
def stream_kept_states(spark, sf):
    return jobs.kept_states_by_stream(spark, sf, STUCK_AFTER, "1 day")


@query
def stream_submissions(spark, sf):
    return jobs.intake_by_stream(spark, sf)


@query
def stream_unique_jobs(spark, sf):
    return jobs.unique_by_stream(spark, sf)


@query
def stream_first_submissions(spark, sf):
    return jobs.first_by_stream(spark, sf)


@query
def stream_key_refusal(spark, sf):
    return jobs.first_in_many_batches(spark, sf)
