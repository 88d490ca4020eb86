"""The diary tables, derived row by row from the given parquet tables.

Every function reads whole tables and whole texts. Cases (a missing tag, a blank code,
a short answer) are chosen by the remainder of a column so that both engines make the
same ones; no row is left out for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaleaf.functions import keys, text
from glossaleaf.operators import translation
from glossaleaf.schemas import CEFR_LEVELS, ERROR_CATEGORIES
from glossaleaf.sources.tables import spread

# long words become the bracketed expressions of a draft
LONG_WORD = r"([^\s,.;:|\[\]]{12,})"
CODES = {"en": "eng", "fr": "fra", "de": "deu", "es": "spa"}
START_MICROS = 1_704_067_200_000_000  # 2024-01-01
START = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def case(column: str, modulus: int, remainder: int) -> Column:
    return F.col(column) % modulus == remainder


def code3(lang: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    return F.try_element_at(mapping, lang)


def created_at(number: Column) -> Column:
    seconds = number.cast("decimal(18,6)") * 977 + (number % 3).cast("decimal(18,6)") * F.lit(0.25).cast("decimal(3,2)")
    return F.to_timestamp_ntz(F.lit(START)) + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def diary_key(number: Column) -> Column:
    at = created_at(number)
    return keys.entry_key(F.to_date(at), at)


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base_of(table(spark, sf_dir, "documents"))


def base_of(documents: DataFrame) -> DataFrame:
    return documents.select(
        "doc_id",
        "text",
        "source",
        "n_chars",
        code3(F.col("lang")).alias("language_source"),
        F.when(F.col("lang") == "en", "fra").otherwise("eng").alias("language_annotation"),
        created_at(F.col("doc_id")).alias("created_at"),
        diary_key(F.col("doc_id")).alias("primary_id"),
        _pick(CEFR_LEVELS, F.col("n_chars") % 6).alias("level_rewriting"),
        F.when(~case("n_chars", 5, 0), F.concat(F.lit("Entry "), "doc_id")).alias("title_diary"),
    )


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as drafts with their long words in brackets, and those words."""
    return drafts_of(spread(table(spark, sf_dir, "documents"), "doc_id"))


def drafts_of(documents: DataFrame) -> DataFrame:
    draft = F.regexp_replace("text", LONG_WORD, "[$1]")
    return translation.with_brackets(base_of(documents).withColumn("draft", draft))


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return submissions_of(spread(table(spark, sf_dir, "documents"), "doc_id"))


def submissions_of(documents: DataFrame) -> DataFrame:
    code, other = F.col("language_source"), F.col("language_annotation")
    return drafts_of(documents).select(
        "doc_id",
        F.concat(F.lit("job-"), "doc_id").alias("job_id"),
        F.col("created_at").alias("submitted_at"),
        F.when(case("n_chars", 23, 0), "").otherwise(F.col("draft")).alias("draft_text"),
        F.when(case("n_chars", 6, 0), "")
        .when(case("n_chars", 6, 1), F.concat(F.lit(" "), code, F.lit("\t")))
        .when(case("n_chars", 6, 2), "xx")
        .otherwise(code)
        .alias("lang_diary_body"),
        F.when(~case("n_chars", 29, 0), F.concat(F.lit("\n"), other)).alias("lang_annotation"),
        F.when(case("n_chars", 19, 0), "D1").otherwise(F.col("level_rewriting")).alias("level_rewriting"),
        F.coalesce("title_diary", F.lit("")).alias("title_diary"),
        F.when(case("n_chars", 4, 1), F.lit(True)).when(case("n_chars", 4, 2), F.lit(False)).alias("rewriter_is_execute"),
        F.when(case("n_chars", 3, 1), F.lit(True)).alias("reviewer_is_execute"),
        F.when(case("n_chars", 2, 1), F.lit(True)).alias("translator_enable_thinking"),
        "n_chars",
    )


def submissions_with_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions, some of which come a second time as another job with the same key."""
    rows = submissions(spark, sf_dir)
    jobs = F.array(F.col("job_id"), F.when(case("n_chars", 10, 1), F.concat("job_id", F.lit("-again"))))
    return rows.withColumn("job_id", F.explode(F.array_compact(jobs)))


def review_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reviewer's answer per draft; every third has no tag."""
    answer = F.when(case("doc_id", 3, 0), F.col("text")).otherwise(
        F.concat(F.lit("<review>first</review>\n<review>"), "text", F.lit("</review> end"))
    )
    return drafts(spark, sf_dir).withColumn("response", answer)


def translator_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts with a translator's answer: echoed template, one pair per bracket, some short."""
    d = drafts(spark, sf_dir)
    e = F.col("expressions")
    kept = (
        F.when(case("doc_id", 7, 3), F.slice(e, F.lit(1), F.greatest(F.size(e) - 1, F.lit(0))))
        .when(case("doc_id", 11, 5), F.slice(e, 1, 1))
        .otherwise(e)
    )
    pair = lambda x: F.concat(
        F.lit("<bracket> "), x, F.lit("</bracket>\n<translation>t_"),
        text.drop_square_brackets(x), F.lit("</translation>"),
    )
    echo = "<bracket>[text]</bracket><translation>corresponding translation</translation>\n"
    response = F.concat(
        F.when(case("doc_id", 5, 0), "You are a translator.<|assistant|>").otherwise(""),
        F.when(case("doc_id", 17, 8), "").otherwise(echo),
        F.array_join(F.transform(kept, pair), "\n"),
        F.when(case("doc_id", 13, 6), "<no_errors/> <no_errors/>").otherwise(""),
    )
    return d.withColumn("response", response)


def archivist_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An error block per bracket after the echoed one; the word length picks the flaws."""
    def block(x: Column) -> Column:
        word, n = text.drop_square_brackets(x), F.length(x)
        return F.concat(
            F.lit("<error>\n  <rule> rule "), (n % 12).cast("string"), F.lit("</rule>\n"),
            F.when(n % 9 != 0, F.concat(F.lit("  <phrase>"), word, F.lit("</phrase>\n"))).otherwise(""),
            F.when(n % 7 != 0, F.concat(
                F.lit("  <correction>"),
                F.when(n % 6 == 0, word).otherwise(F.concat(F.lit("c_"), word)),
                F.lit("</correction>\n"),
            )).otherwise(""),
            F.when(n % 5 != 0, F.concat(
                F.lit("  <category>"),
                _pick(["Grammar", "Vocabulary", "Spelling", "Style"], n % 4),
                F.lit("</category>\n"),
            )).otherwise(""),
            F.lit("</error>"),
        )

    echo = "<error>\n  <rule>The specific rule violated</rule>\n  <correction>The corrected phrase</correction>\n</error>\n"
    response = F.concat(
        F.lit(echo),
        F.array_join(F.transform(F.col("expressions"), block), "\n"),
        F.when(case("doc_id", 13, 6), "<no_errors/><no_errors/>").otherwise(""),
    )
    return drafts(spark, sf_dir).withColumn("response", response)


def error_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archivist answers with the key columns of an error record."""
    return archivist_responses(spark, sf_dir).select(
        F.col("primary_id").alias("primary_id_DiaryEntry"),
        F.lit("model-0").alias("model_id_embedding"),
        F.when(case("doc_id", 31, 4), "xx").otherwise(F.col("language_source")).alias("language_diary_text"),
        F.col("language_annotation").alias("language_annotation_text"),
        "response",
    )


def rewriter_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to seven attempts per draft: tag missing, cut off, wrong language, or good."""
    d = drafts(spark, sf_dir).select("doc_id", "primary_id", "language_source", "draft")
    tries = d.withColumn("attempt", F.explode(F.sequence(F.lit(1), (F.col("doc_id") % 7 + 1).cast("int"))))
    turn = F.col("doc_id") + F.col("attempt")
    tagged = F.concat(
        F.lit("<rewriting>rewritten text</rewriting>\n<rewriting>"), F.col("draft"), F.lit("</rewriting>")
    )
    return tries.select(
        "doc_id",
        "primary_id",
        "language_source",
        "attempt",
        F.when(turn % 2 == 0, F.col("draft")).otherwise(tagged).alias("response"),
        F.when(turn % 5 == 0, "length").otherwise("stop").alias("finish_reason"),
        F.when(turn % 3 == 0, F.lit("ita")).when(turn % 7 != 0, F.col("language_source")).alias("detected_language"),
    )


def diary_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select(
        "primary_id",
        "created_at",
        F.to_date("created_at").alias("date_diary"),
        "language_source",
        "language_annotation",
        F.col("text").alias("diary_original"),
        F.lit("").alias("diary_replaced"),
        F.concat(F.lit("rewritten: "), "text").alias("diary_rewritten"),
        "level_rewriting",
        F.col("source").alias("model_id_tutor"),
        F.coalesce("title_diary", F.lit("")).alias("title_diary"),
        F.when(~case("n_chars", 4, 0), F.lit(0)).alias("current_version"),
        (F.col("doc_id") % 10 != 0).alias("is_show"),
    )


def stored_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diary entries that have been edited before: stored versions 0 to 5, some null."""
    return diary_entries(spark, sf_dir).withColumn(
        "current_version", F.when(F.col("current_version").isNotNull(), (F.length("diary_original") % 6).cast("int"))
    )


def translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return translation.with_substitution(translation.with_pairs(translator_responses(spark, sf_dir)))


def unknown_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return translation.expression_rows(translated(spark, sf_dir))


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as job status records: three jobs per user, one diary entry per user."""
    return status_of(table(spark, sf_dir, "events"))


def status_of(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "completed").when(kind == "error", "error").otherwise("processing")
    return events.select(
        F.concat(F.lit("job-"), "user_id", F.lit("-"), F.col("event_id") % 3).alias("job_id"),
        diary_key(F.col("user_id")).alias("diary_id"),
        "ts",
        status.alias("status"),
        F.when(kind == "error", F.concat(F.lit("failed at "), "event_id")).otherwise("").alias("message"),
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as one entry, each turn as its next text."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")


def text_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation turn, whole, as an edit of one entry. After some turns the same text
    or no text is submitted once more, a minute later."""
    turns = table(spark, sf_dir, "conversations")
    at, later = created_at(F.col("turn")), created_at(F.col("turn")) + F.expr("INTERVAL 1 MINUTE")
    again = F.when(case("turn", 4, 2), F.col("text"))
    edits = F.array(
        F.struct(at.alias("at"), F.col("text").alias("text")),
        F.when(F.col("turn") % 4 >= 2, F.struct(later.alias("at"), again.alias("text"))),
    )
    rows = turns.select(diary_key(F.col("conv_id")).alias("primary_id"), F.explode(F.array_compact(edits)).alias("e"))
    return rows.select("primary_id", "e.at", "e.text")


def error_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("error_id"),
        diary_key(F.col("vec_id")).alias("primary_id_DiaryEntry"),
        F.concat(F.lit("model-"), F.col("vec_id") % 2).alias("model_id_embedding"),
        _pick([*CODES.values(), "xx"], label % 5).alias("language_diary_text"),
        F.when(label % 5 == 0, "fra").otherwise("eng").alias("language_annotation_text"),
        F.concat(F.lit("rule "), label).alias("error_rule"),
        F.concat(F.lit("phrase "), "vec_id").alias("example_phrase"),
        F.concat(F.lit("correction "), "vec_id").alias("correction"),
        _pick(ERROR_CATEGORIES, label % 4).alias("category"),
        "embedding",
    )


def generation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as a model server's log: word lengths stand for token ids."""
    words = F.transform(F.split("text", " "), lambda w: F.length(w))
    turns = table(spark, sf_dir, "conversations").withColumn("output_ids", words)
    return turns.select(
        "conv_id",
        "turn",
        "role",
        "text",
        "output_ids",
        F.slice("output_ids", F.lit(1), (F.col("turn") + 1).cast("int")).alias("input_ids"),
        F.lit(40).alias("max_new_tokens"),
        F.lit(4).alias("eos_token_id"),
        F.when(F.col("turn") % 3 != 0, F.length("text")).alias("prompt_eval_count"),
        F.when(F.col("conv_id") % 4 != 0, F.size("output_ids")).alias("eval_count"),
        F.concat(F.lit("model-"), F.col("conv_id") % 3).alias("model_name"),
    )
