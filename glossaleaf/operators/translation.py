"""Bracket extraction, pair parsing, substitution and spans over a table of drafts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossaleaf.functions import keys, responses, text
from glossaleaf.functions.rows import explode_rows, settled
from glossaleaf.schemas import SPAN


def with_brackets(drafts: DataFrame, draft: str = "draft") -> DataFrame:
    return drafts.withColumn("expressions", text.brackets(F.col(draft)))


def with_pairs(df: DataFrame, skip_first: bool = True) -> DataFrame:
    """Reads ``response`` into ``pairs``, one per entry of ``expressions`` if all went well."""
    tail = responses.response_tail(F.col("response"))
    df = df.withColumn("_all_pairs", responses.all_pairs(tail))
    kept = responses.keep_answers(tail, F.col("_all_pairs"), F.size("expressions"), skip_first)
    return (
        df.withColumn("pairs", F.coalesce(kept, F.array().cast(responses.PAIRS_TYPE)))
        .withColumn("n_expected", F.size("expressions"))
        .withColumn("n_parsed", F.size("pairs"))
        .drop("_all_pairs")
    )


def _phrase(pair: Column) -> Column:
    return text.drop_square_brackets(pair["expression_original"])


def _substituted(draft: Column, pairs: Column) -> Column:
    """Each original replaced by its translation, in order, at all its places."""
    return F.aggregate(
        pairs,
        draft,
        lambda acc, p: F.replace(acc, p["expression_original"], p["expression_translation"]),
    )


def with_substitution(df: DataFrame, draft: str = "draft", strict: bool = True) -> DataFrame:
    """Adds ``translate_status``, ``draft_replaced`` and ``spans``.

    Strict: every phrase must occur exactly once in the draft (white space is
    interchangeable) and every translation exactly once in the result. With
    ``strict=False`` phrases and translations act as patterns and only the total number
    of matches must agree.
    """
    found = _strict_spans(df, draft) if strict else _pattern_spans(df, draft)
    ok = F.col("translate_status") == "ok"
    spans = F.transform(
        F.arrays_zip("pairs", "_before", "_after"),
        lambda z: F.struct(
            z["pairs"]["expression_original"].alias("expression_original"),
            z["pairs"]["expression_translation"].alias("expression_translation"),
            z["_before"].alias("span_original"),
            z["_after"].alias("span_translation"),
        ),
    )
    empty = F.array().cast(
        "array<struct<expression_original:string,expression_translation:string,"
        "span_original:struct<start:int,end:int>,span_translation:struct<start:int,end:int>>>"
    )
    return settled(
        found,
        translate_status=F.col("translate_status"),
        draft_replaced=F.when(ok, F.col("_replaced")).otherwise(F.lit("")),
        spans=F.when(ok, spans).otherwise(empty),
    ).drop("_replaced", "_before", "_after")


def _status(places_ok: Column, spans_ok: Column) -> Column:
    return (
        F.when(~F.coalesce(places_ok, F.lit(False)), F.lit("position_mismatch"))
        .when(~F.coalesce(spans_ok, F.lit(False)), F.lit("span_mismatch"))
        .otherwise(F.lit("ok"))
    )


def _strict_spans(df: DataFrame, draft: str) -> DataFrame:
    """One Python step for each batch of drafts; a draft that failed is not substituted at all."""
    old, new = (F.transform("pairs", lambda p: p[name]) for name in ("expression_original", "expression_translation"))
    made = text.substituted(F.col(draft), old, new)
    return (
        df.withColumn("_made", made)
        .withColumns({"_before": F.col("_made.before"), "_replaced": F.col("_made.replaced"), "_after": F.col("_made.after")})
        .withColumn("translate_status", _status(text.all_found(F.col("_before")), text.all_found(F.col("_after"))))
        .drop("_made")
    )


def _pattern_spans(df: DataFrame, draft: str) -> DataFrame:
    patterns = F.transform("pairs", lambda p: F.replace(_phrase(p), F.lit(" "), F.lit(r"\s")))
    translations = F.transform("pairs", lambda p: p["expression_translation"])
    return (
        df.withColumn("_hits", match_spans(F.col(draft), patterns))
        .withColumn("_placed", F.size("_hits") == F.col("n_parsed"))
        # a pair is substituted once per match of its phrase, so one without a match is not
        .withColumn("_found", F.transform("_hits", lambda h: F.element_at("pairs", h["pair"] + 1)))
        .withColumn("_replaced", F.when(F.col("_placed"), _substituted(F.col(draft), F.col("_found"))))
        .withColumn("_new_hits", match_spans(F.col("_replaced"), translations))
        .withColumn("translate_status", _status(F.col("_placed"), F.size("_new_hits") == F.col("n_parsed")))
        .withColumn("_before", F.transform("_hits", _span_of))
        .withColumn("_after", F.transform("_new_hits", _span_of))
        .drop("_hits", "_placed", "_found", "_new_hits")
    )


def _span_of(hit: Column) -> Column:
    return F.struct(hit["start"].alias("start"), hit["end"].alias("end"))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("pair", T.IntegerType()), *SPAN.fields])))
def match_spans(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Every match of every pattern, in order; null if a pattern is not valid.

    A draft counts only if there are as many matches as patterns, so the list stops one
    past that. The patterns come from the data, so a bad one must not fail the job; only Python's
    own ``re`` agrees with the pattern language the responses are written for.
    """

    def spans(body, patterns):
        if body is None or patterns is None:
            return None
        try:
            hits = (
                {"pair": i, "start": m.start(), "end": m.end()}
                for i, p in enumerate(patterns)
                for m in re.finditer(p, body, re.DOTALL)
            )
            return list(islice(hits, len(patterns) + 1))
        except re.error:
            return None

    for bodies, patterns in batches:
        yield pd.Series([spans(b, p) for b, p in zip(bodies, patterns)])


def translate(df: DataFrame, draft: str = "draft", skip_first: bool = True, strict: bool = True) -> DataFrame:
    """The whole step: drafts with a ``response`` each to replaced drafts with spans."""
    return with_substitution(with_pairs(with_brackets(df, draft), skip_first), draft, strict)


def expression_rows(translated: DataFrame, entry: str = "primary_id") -> DataFrame:
    """One unknown-expression record per placed pair, with a collision-free key."""
    originals = F.transform("spans", lambda s: s["expression_original"])
    repeats = F.size(F.array_distinct(originals)) < F.size(originals)
    keep = [
        F.col(entry).alias("primary_id_DiaryEntry"),
        "created_at",
        "language_source",
        "language_annotation",
        # only an entry that repeats an expression carries the list along
        F.when(repeats, originals).alias("_all"),
    ]
    rows = explode_rows(translated, keep, "spans", "_pos", "_span")
    so_far = F.slice("_all", F.lit(1), F.col("_pos") + 1)
    same = F.coalesce(
        F.size(F.filter(so_far, lambda e: e == F.col("_span.expression_original"))), F.lit(1)
    )
    return rows.select(
        keys.expression_key(
            F.col("primary_id_DiaryEntry"), F.col("_span.expression_original"), F.col("created_at"), same
        ).alias("primary_id"),
        "primary_id_DiaryEntry",
        "created_at",
        F.col("_span.expression_original").alias("expression"),
        F.col("_span.expression_translation").alias("expression_translation"),
        F.col("_span.span_original").alias("span_original"),
        F.col("_span.span_translation").alias("span_translation"),
        F.coalesce("language_source", F.lit("Unknown")).alias("language_source"),
        F.coalesce("language_annotation", F.lit("Unknown")).alias("language_annotation"),
    )
