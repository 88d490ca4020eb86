"""Version numbers, text diffs and the change history of entries."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossaleaf.functions import keys
from glossaleaf.functions.rows import settled
from glossaleaf.operators import line_edits, ordered, store
from glossaleaf.session import materialize

# hashes of 8 bytes that every task gets
MAX_BROADCAST_ENTRIES = 2_000_000


def version_numbers(
    changes: DataFrame, entry: str, order: list[str], spread: bool = True, stored: str | None = None
) -> DataFrame:
    """Adds version_from and version_to: each change raises the version by one.

    ``stored`` names a column with the version that the entry has already, null as 0."""
    numbered = ordered.with_previous(changes, entry, order, "version_to", spread=spread)
    if stored:
        numbered = numbered.withColumn("version_to", F.col("version_to") + F.coalesce(F.col(stored), F.lit(0)))
    return numbered.withColumn("version_from", F.col("version_to") - 1)


def with_stored_version(changes: DataFrame, entry: str, entries: DataFrame) -> DataFrame:
    """Adds ``_stored``, the current version of each change's entry; null if it is unknown."""
    known = entries.select(F.col("primary_id").alias("_id"), F.col("current_version").alias("_stored"))
    return changes.join(known, changes[entry] == known["_id"], "left").drop("_id")


def _with_several(rows: DataFrame, entry: str) -> DataFrame:
    """``rows`` without those of entries with one row, in which nothing can change.

    Hashes of the entries are compared; two entries with one hash only keep rows that could go.
    """
    hashes = rows.groupBy(F.xxhash64(entry).alias("_hash")).agg(F.count("*").alias("_rows"))
    several = materialize(hashes.filter("_rows > 1").select("_hash"), "several-versions")
    if several.limit(MAX_BROADCAST_ENTRIES + 1).count() > MAX_BROADCAST_ENTRIES:
        return rows
    return rows.join(F.broadcast(several), F.xxhash64(entry) == F.col("_hash"), "left_semi")


def version_pairs(
    versions: DataFrame, entry: str, order: list[str], text: str, spread: bool = True, stored: str | None = None
) -> DataFrame:
    """(entry, order..., version_from, version_to, old_text, new_text) of every real edit.

    The first text of an entry is version 0, or the version in the column ``stored``; an edit
    that changes nothing is no edit and raises no version.

    Texts are written once, those of entries with one text not at all. Only their SHA-256 digests are
    ordered, numbered and compared; the texts of real edits are then met by the number of their row.
    """
    kept = [entry, *order, *([stored] if stored else [])]
    rows = _with_several(versions.select(*kept, text), entry)
    rows = rows.withColumns({"_digest": F.unhex(F.sha2(text, 256)), "_row": F.monotonically_increasing_id()})
    # written once: a row's number must not change between its readers
    rows = materialize(rows, "version-texts")
    before, changes = {"_digest": "_old_digest", "_row": "_old_row"}, {"_digest": "version_to"}
    # rows alike in their order stay as they came
    paired = ordered.with_previous(rows.drop(text), entry, [*order, "_row"], "_n", before, spread, changes=changes)
    edits = paired.filter((F.col("_n") > 1) & (F.col("_old_digest") != F.col("_digest")))
    if stored:
        edits = edits.withColumn("version_to", F.col("version_to") + F.coalesce(F.col(stored), F.lit(0)))
    edits = edits.select(entry, *order, "version_to", F.col("_row").alias("_new_row"), "_old_row")
    # alike but for the names, so that the texts move once for both
    for side in ("new", "old"):
        edits = edits.join(rows.select(F.col("_row").alias(f"_{side}_row"), F.col(text).alias(f"{side}_text")), f"_{side}_row")
    return edits.select(
        entry, *order, "new_text", "old_text", "version_to", (F.col("version_to") - 1).alias("version_from")
    )


@F.pandas_udf(T.StringType())
def unified_diff(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Unified diff of two texts, lines kept with their ends; null if either is null."""

    def diff(old, new):
        if old is None or new is None:
            return None
        lines = difflib.unified_diff(
            old.splitlines(keepends=True), new.splitlines(keepends=True), "v_old", "v_new", lineterm=""
        )
        return "".join(lines)

    for olds, news in batches:
        yield pd.Series([diff(o, n) for o, n in zip(olds, news)], dtype=object)


def text_changes(pairs: DataFrame, field: str) -> DataFrame:
    """Adds ``changes``: JSON of the changed field and its diff."""
    made = settled(pairs, _diff=unified_diff(F.col("old_text"), F.col("new_text")))
    return made.withColumn("changes", F.to_json(F.create_map(F.lit(field), F.col("_diff")))).filter(
        F.length("_diff") > 0
    ).drop("_diff")


def expression_change(operation: str, primary_id: Column, original: Column, translation: Column) -> Column:
    """JSON of an added or deleted expression."""
    if operation not in ("add", "delete"):
        raise ValueError(f"operation must be 'add' or 'delete', not {operation!r}")
    return F.to_json(
        F.struct(
            primary_id.alias("primary_id"),
            F.lit(operation).alias("operation"),
            original.alias("expression_original"),
            translation.alias("expression_translation"),
        ),
        {"ignoreNullFields": "false"},
    )


def history_rows(
    changes: DataFrame, order: list[str], spread: bool = True, entries: DataFrame | None = None
) -> DataFrame:
    """Version records from (primary_id_DiaryEntry, created_at, changes, order...).

    With ``entries`` the versions go on from each entry's current one, else from 0."""
    entry = "primary_id_DiaryEntry"
    if entries is None:
        numbered = version_numbers(changes, entry, order, spread)
    else:
        numbered = version_numbers(with_stored_version(changes, entry, entries), entry, order, spread, "_stored")
    return numbered.select(
        keys.history_key(F.col(entry), F.col("version_to")).alias("history_id"),
        entry,
        "version_from",
        "version_to",
        "created_at",
        "changes",
    )


def apply_versions(entries: DataFrame, history: DataFrame) -> DataFrame:
    """Entries with current_version raised by their records, whatever kind of change."""
    changes = history.select(
        F.col("primary_id_DiaryEntry").alias("primary_id"), F.col("version_to").alias("current_version")
    )
    return store.apply_updates(entries, changes, "primary_id", ["current_version"], ["current_version"])


def edit_texts(
    entries: DataFrame, edits: DataFrame, field: str, spread: bool = True, by_line: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(entries after the edits, version records) for edits of one text column.

    A record holds a unified diff, or with ``by_line`` the line edits that ``line_edits.replay``
    can make again.

    Versions go on from the entry's current one. ``edits`` has primary_id, at and text; ``at`` is unique per entry. A null text is no
    edit, nor is one that repeats the text before it. Edits of unknown entries are left out.
    """
    start = entries.select("primary_id", F.lit(None).cast(edits.schema["at"].dataType).alias("at"), F.col(field).alias("text"), F.col("current_version").alias("_stored"))
    known = edits.filter("text is not null").join(
        entries.select("primary_id", F.col("current_version").alias("_stored")), "primary_id"
    )
    # the stored text sorts first: null comes before every time
    texts = start.unionByName(known.select("primary_id", "at", "text", "_stored"))
    # the records and the entries both come from the pairs
    pairs = materialize(version_pairs(texts, "primary_id", ["at"], "text", spread, "_stored"), "edit-pairs")
    if by_line:
        pair = ["primary_id", "version_to"]
        made = line_edits.payloads(line_edits.line_edits(pairs, pair), pair, field)
        changed = pairs.select(*pair, "version_from", "at").join(made, pair)
    else:
        changed = text_changes(pairs, field)
    records = changed.select(
        keys.history_key(F.col("primary_id"), F.col("version_to")).alias("history_id"),
        F.col("primary_id").alias("primary_id_DiaryEntry"),
        "version_from",
        "version_to",
        F.col("at").alias("created_at"),
        "changes",
    )
    updates = pairs.select(
        "primary_id", F.col("new_text").alias(field), F.col("version_to").alias("current_version")
    )
    updated = store.apply_updates(entries, updates, "primary_id", ["current_version"], [field, "current_version"])
    return updated, records


def line_changes(
    versions: DataFrame, entry: str, order: list[str], text: str, spread: bool = True
) -> DataFrame:
    """Lines added to and removed from each version, with their number.

    A version's lines count +1 for the step that led to it and -1 for the step away from
    it. What is left per line is the change, so no two texts ever have to meet in a row,
    and equal lines add up before the shuffle.
    """
    cols = versions.select(entry, *order, text)
    numbered = ordered.with_previous(cols, entry, order, "_n", spread=spread, total="_last")
    lines = numbered.select(entry, "_n", "_last", F.explode(F.split(text, "\n")).alias("line"))
    steps = F.array(
        F.struct((F.col("_n") - 1).alias("version_to"), F.lit(1).alias("sign")),
        F.struct(F.col("_n").alias("version_to"), F.lit(-1).alias("sign")),
    )
    signed = lines.select(entry, "line", "_last", F.inline(steps))
    real = signed.filter((F.col("version_to") >= 1) & (F.col("version_to") < F.col("_last")))
    net = real.groupBy(entry, "version_to", "line").agg(F.sum("sign").alias("net"))
    return net.filter("net <> 0").select(
        entry,
        "version_to",
        F.when(F.col("net") > 0, F.lit("added")).otherwise(F.lit("removed")).alias("change"),
        "line",
        F.abs("net").alias("n"),
    )
