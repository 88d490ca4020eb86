"""The whole analysis of submissions as one chain of DataFrame transforms."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaleaf.functions import responses, text
from glossaleaf.languages import Languages
from glossaleaf.operators import errors as error_ops
from glossaleaf.operators import intake, langid, memory, models, rewriting, store, translation
from glossaleaf.session import materialize

KEY_TAKEN = "entry key already stored"


@dataclass
class Analysis:
    entries: DataFrame
    expressions: DataFrame
    errors: DataFrame
    errors_rejected: DataFrame
    reviews: DataFrame
    status: DataFrame
    rejected: DataFrame
    refused: DataFrame
    past: DataFrame | None = None  # with an embedding model only


def with_languages(submissions: DataFrame, profile: langid.Profile | None) -> DataFrame:
    """Submitted codes, or detected ones where a code is blank: the diary language from
    the draft without brackets, the annotation language from the bracketed text."""
    coded = intake.with_codes(submissions)
    if profile is None:
        return coded
    blank = coded.filter("language_source is null")
    body = langid.detect(
        blank.select("primary_id", text.without_brackets(F.col("draft_text")).alias("_t")),
        "primary_id", "_t", profile, "_body",
    )
    notes = langid.detect(
        blank.select("primary_id", text.annotation_text(text.brackets(F.col("draft_text"))).alias("_t")),
        "primary_id", "_t", profile, "_notes",
    )
    return (
        coded.join(body, "primary_id", "left")
        .join(notes, "primary_id", "left")
        .withColumn("language_source", F.coalesce("language_source", "_body"))
        .withColumn("language_annotation", F.coalesce("language_annotation", "_notes"))
        .drop("_body", "_notes")
    )


def analyse(
    submissions: DataFrame,
    translator: DataFrame,
    archivist: DataFrame,
    attempts: DataFrame,
    reviews: DataFrame,
    languages: Languages,
    tutor_model: str,
    embedding_model: str,
    profile: langid.Profile | None = None,
    strict: bool = True,
    stored: DataFrame | None = None,
    embed: Callable[[list[str]], list[list[float]]] | None = None,
    remembered: DataFrame | None = None,
    k: int = 10,
) -> Analysis:
    """Submissions and the models' answers (each keyed by primary_id) to the stored tables.

    ``attempts`` also has attempt, finish_reason and detected_language (see
    ``rewriting.with_detected_language``). All joins are on primary_id; a submission whose
    key is in ``stored`` or came earlier is refused before the first of them, so that no join
    multiplies rows. Every job ends with a state: a rejected or refused one as ``error``. An
    empty draft makes no job.

    With a model ``embed`` the errors carry their vectors, ready to be appended to the memory, and
    ``past`` has for each entry with any the texts of the ``remembered`` errors (records with
    page_content and embedding) that are among the ``k`` nearest of one of its own, nearest first. A
    text that the model fails on gets an empty vector, is stored and found by no search.
    """
    checked = intake.with_keys(intake.checked(submissions, languages))
    valid = intake.valid(checked)
    known = (valid.limit(0) if stored is None else stored).select("primary_id")
    accepted, refused = store.append_new(valid, known, "primary_id", ["created_at", "job_id"])
    entries = intake.with_settings(with_languages(accepted, profile))

    answered = entries.join(translator.select("primary_id", "response"), "primary_id", "left")
    answered = answered.withColumn("response", F.coalesce("response", F.lit("")))
    # every table below starts from the translated drafts: written once, read by column
    done = materialize(translation.translate(answered, "draft_text", strict=strict), "translated")
    ok = F.col("translate_status") == "ok"

    found = error_ops.error_rows(
        done.filter(ok)
        .select(
            F.col("primary_id").alias("primary_id_DiaryEntry"),
            F.lit(embedding_model).alias("model_id_embedding"),
            F.col("language_source").alias("language_diary_text"),
            F.col("language_annotation").alias("language_annotation_text"),
        )
        .join(archivist.select(F.col("primary_id").alias("primary_id_DiaryEntry"), "response"), "primary_id_DiaryEntry")
    )
    validity = error_ops.with_validity(found, languages)
    learned, past = memory.to_memory(error_ops.without_noops(error_ops.valid(validity))), None
    if embed is not None:
        # the search and the append read the vectors: the model is asked once
        learned = materialize(models.embed(learned, "page_content", embed, empty_on_error=True), "embedded")
        asked = learned.withColumn("query_id", F.xxhash64("primary_id_DiaryEntry", "error_no"))
        before = memory.identified(learned.limit(0) if remembered is None else remembered)
        past = memory.past_errors(asked, before, "primary_id_DiaryEntry", k)

    tries = attempts.join(done.filter(ok).select("primary_id", "language_source"), "primary_id")
    chosen = rewriting.chosen_attempts(rewriting.classify_attempts(tries), "primary_id")
    rewritten = done.join(chosen.select("primary_id", "rewriting"), "primary_id", "left")
    rewriting_text = intake.gate(ok, F.col("config_rewriter.is_execute"), F.coalesce("rewriting", F.lit("")))
    reviewed = done.select("primary_id", ok.alias("_ok"), "config_reviewer").join(
        reviews.select("primary_id", "response"), "primary_id", "left"
    )
    return Analysis(
        entries=intake.entry_rows(rewritten, tutor_model, F.col("draft_replaced"), rewriting_text),
        expressions=translation.expression_rows(done),
        errors=learned,
        errors_rejected=error_ops.rejected(validity),
        reviews=reviewed.select(
            "primary_id",
            intake.gate(
                F.col("_ok"),
                F.col("config_reviewer.is_execute"),
                F.coalesce(responses.review_text(F.col("response")), F.lit("")),
            ).alias("total_review"),
        ),
        status=done.select(
            "job_id",
            F.col("primary_id").alias("diary_id"),
            F.when(F.col("translate_status") == "span_mismatch", "error").otherwise("completed").alias("status"),
            F.when(F.col("translate_status") == "span_mismatch", "Invalid extraction").otherwise("").alias("message"),
        )
        .unionByName(_failed(intake.jobs(intake.rejected(checked)), F.col("reject_reason")))
        .unionByName(_failed(refused, F.lit(KEY_TAKEN))),
        rejected=intake.rejected(checked),
        refused=refused,
        past=past,
    )


def _failed(jobs: DataFrame, message: Column) -> DataFrame:
    return jobs.select(
        "job_id", F.col("primary_id").alias("diary_id"), F.lit("error").alias("status"), message.alias("message")
    )


def save_new(existing: DataFrame, analysis: Analysis) -> tuple[DataFrame, DataFrame]:
    """Entries whose key is free, and those refused."""
    return store.append_new(analysis.entries, existing, "primary_id", ["created_at"])
