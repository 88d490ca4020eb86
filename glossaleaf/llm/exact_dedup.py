"""Exact dedup by skew-safe combining, all in the JVM.

1. Every map task combines the equal texts it has read (partial aggregation).
2. What is left of a digest meets in salt groups. The salt is the number of the task modulo
   ``salts``, so a text that holds a third of all rows reaches a group once per task.
3. The winners of the salts are combined into one row per text.

Digest and full text are the key of the aggregation at every stage. Texts are equal if
they are the same after lower-casing A-Z.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossaleaf.llm.common import ascii_lower, id_key, packed, whole

SALTS = 16


def _groups(texts: DataFrame, salts: int) -> DataFrame:
    """(digest, length, keep_id, group_size) of texts (doc_id, digest, length, content).

    The length is a key beside the digest so that the look-up by both is dealt out anew: a
    digest with very many rows can then be split there."""
    salted = texts.drop("length").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    winners = salted.groupBy("digest", "salt", "content").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    )
    combined = winners.groupBy("digest", "content").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )
    # rows look their group up by digest alone; two contents under one digest must not pass
    checked: Column = F.when(F.count("*") > 1, F.raise_error(F.lit("two texts share a digest")).cast("long"))
    return combined.groupBy("digest").agg(
        F.max(F.octet_length("content")).alias("length"),
        F.max("keep_id").alias("keep_id"),
        F.coalesce(checked, F.max("group_size")).alias("group_size"),
    )


def _texts(docs: DataFrame, text: str) -> DataFrame:
    content = docs.select("doc_id", ascii_lower(whole(text)).alias("content"))
    return content.withColumns({"digest": F.sha2("content", 256), "length": F.octet_length("content")})


def mark(docs: DataFrame, text: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The largest doc_id of a group stays. Null texts count as empty. A null doc_id stays only
    if its group has no other; if rows repeat doc_id and text, one of them stays. Other
    columns of ``docs`` are left out. An empty table gives no rows; very long texts are compared whole.
    """
    texts = _texts(docs, text)
    again = Window.partitionBy("digest", "doc_id").orderBy(F.lit(1))
    rows = texts.select("doc_id", "digest", "length").withColumn("nth", F.row_number().over(again))
    return rows.join(_groups(texts, salts), ["digest", "length"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def kept_rows(docs: DataFrame, text: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; see :func:`mark`."""
    digest = F.sha2(ascii_lower(whole(text)), 256)
    rows = docs.select(packed(docs).alias("row"), digest.alias("digest"), id_key().alias("id_key"))
    best = _groups(_texts(docs, text), salts).select("digest", id_key("keep_id").alias("id_key"))
    # join and window have the same key, so the rows are dealt out once
    again = Window.partitionBy("digest", "id_key").orderBy(F.lit(1))
    stay = rows.join(best, ["digest", "id_key"], "left_semi").withColumn("nth", F.row_number().over(again))
    return stay.filter("nth = 1").select("row.*")
