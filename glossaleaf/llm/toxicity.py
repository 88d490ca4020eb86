"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams present in a text, hashed to ``BUCKETS``. For each, the ratio
r = log p(feature | toxic) - log p(feature | not toxic) is taken from smoothed document
counts; the features times r feed a logistic regression, in which a toxic document weighs
``TOXIC_WEIGHT`` others. Features whose |r| is below ``LEAST_RATIO``, or that fewer than
``LEAST_DOCUMENTS`` documents have, would get a weight near zero and are left out of the fit. It is
fitted on at most ``MOST_LABELLED`` labelled ids, one row each; every document is scored, whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaleaf.llm.common import whole
from glossaleaf.session import materialize

# lengths of the n-grams, ascending
SIZES = (4, 5, 6, 7)
BITS = 20
BUCKETS = 1 << BITS
SMOOTHING = 1.0
LEAST_RATIO = 1.0
LEAST_DOCUMENTS = 3
# bound of the fitting sample, in the order of a hash of the id
MOST_LABELLED = 20_000
PIECES = 16
STEPS = 150
RATE = 0.1
DECAY = 1e-2
TOXIC_WEIGHT = 20.0
# characters hashed at once
BLOCK = 1 << 18
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def _characters(text: str) -> np.ndarray:
    return np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), "<u4")


def _hashed(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(length, buckets) of the n-grams that start at each character; one length goes on from
    the one before."""
    h = np.zeros(len(codes) + 1, np.uint64)
    for n in range(1, min(max(SIZES), len(codes)) + 1):
        h = h[:-1] * np.uint64(0x100000001B3)
        h ^= codes[n - 1 :]
        if n in SIZES:
            mixed = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            mixed >>= np.uint64(64 - BITS)
            yield n, mixed.view(np.int64)


def present(texts: list[str], wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of each different wanted bucket in each text; ``wanted`` marks buckets.

    Short texts are hashed together up to a block, a long one in blocks; every text is in one
    of the results only, in order. An n-gram over the end of a text is left out.
    """
    i = 0
    while i < len(texts):
        parts = [_characters(texts[i])]
        size = len(parts[0])
        while i + len(parts) < len(texts) and size + len(texts[i + len(parts)]) < BLOCK:
            parts.append(_characters(texts[i + len(parts)]))
            size += len(parts[-1])
        codes, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        found = []
        for at in range(0, len(codes), BLOCK):
            for n, buckets in _hashed(codes[at : at + BLOCK + max(SIZES) - 1]):
                hits = np.flatnonzero(wanted[buckets[:BLOCK]])
                owner = np.searchsorted(ends, hits + at, "right")
                inside = owner == np.searchsorted(ends, hits + at + n - 1, "right")
                pairs = owner[inside] << BITS | buckets[hits[inside]]
                found.append(np.unique(pairs) if len(codes) > BLOCK else pairs)
        pairs = np.unique(np.concatenate([np.empty(0, np.int64), *found]))
        yield i + (pairs >> BITS), pairs & (BUCKETS - 1)
        i += len(parts)


def _labelled(docs: DataFrame, labels: DataFrame, text: str, most: int) -> DataFrame:
    """(doc_id, toxic, text) of the fitting sample, written once."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumnRenamed("doc_id", "labelled_id")
    texts = docs.select("doc_id", whole(text).alias("text"))
    joined = texts.join(F.broadcast(sample), F.col("doc_id") == F.col("labelled_id"))
    # of rows with one id the text that hashes lowest: the sample has as many rows as ids
    first = joined.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("_t"))
    # a bounded table in few pieces: each piece sends one row per bucket when counted
    return materialize(first.select("doc_id", "toxic", F.col("_t.text").alias("text")).repartition(PIECES, "doc_id"), "labelled")


def _counts(rows: DataFrame) -> DataFrame:
    """(b, n, p): documents that have each bucket, by label; the last bucket counts all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BUCKETS + 1), np.int64)
        every = np.ones(BUCKETS, bool)
        for batch in batches:
            toxic = batch.column(1).to_numpy()
            for label in (0, 1):
                seen[label, -1] += int((toxic == label).sum())
            for owner, buckets in present(batch.column(2).to_pylist(), every):
                for label in (0, 1):
                    seen[label, :-1] += np.bincount(buckets[toxic[owner] == label], minlength=BUCKETS)
        used = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[0, used]), pa.array(seen[1, used])], names=["b", "n", "p"])

    summed = rows.mapInArrow(run, "b long, n long, p long").groupBy("b").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    return materialize(summed, "ngram-counts")


def _chosen(counts: DataFrame, negatives: int, positives: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets with a marked ratio, ascending, and their ratios; only these leave the cluster."""

    def share(count: str, documents: int) -> Column:
        return F.log((F.col(count) + SMOOTHING) / (documents + 2 * SMOOTHING))

    ratios = counts.filter((F.col("b") < BUCKETS) & (F.col("n") + F.col("p") >= LEAST_DOCUMENTS)).select(
        "b", (share("p", positives) - share("n", negatives)).alias("ratio")
    )
    marked = sorted(tuple(r) for r in ratios.filter(F.abs("ratio") >= LEAST_RATIO).collect())
    return np.array([b for b, _ in marked], np.int64), np.array([r for _, r in marked])


def _features(rows: DataFrame, wanted: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Label and chosen buckets of each row of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = list(present(batch.column(2).to_pylist(), wanted))
            owner, buckets = (np.concatenate([np.empty(0, np.int64), *(p[k] for p in parts)]) for k in (0, 1))
            cuts = np.searchsorted(owner, np.arange(len(batch) + 1))
            lists = [buckets[x:y].astype("<i4").tobytes() for x, y in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.binary())], names=["doc_id", "toxic", "f"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    # at most MOST_LABELLED rows, four bytes for each chosen feature that a document has
    sample = rows.mapInArrow(run, f"doc_id {kind}, toxic int, f binary").collect()
    sample.sort(key=lambda r: str(r["doc_id"]))
    return np.array([r["toxic"] for r in sample], np.int64), [np.frombuffer(r["f"], "<i4") for r in sample]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", most: int = MOST_LABELLED) -> tuple[float, np.ndarray]:
    """(bias, weight of each bucket). Without labels of both kinds only the bias counts."""
    rows = _labelled(docs, labels, text, most)
    counts = _counts(rows)
    every = counts.filter(F.col("b") == BUCKETS).first()
    negatives, positives = (every.n, every.p) if every else (0, 0)
    bias = float(np.log((positives + 0.5) / (negatives + 1)))
    weights = np.zeros(BUCKETS)
    if not positives or not negatives:
        return bias, weights
    chosen, scale = _chosen(counts, negatives, positives)
    wanted = np.zeros(BUCKETS, bool)
    wanted[chosen] = True
    toxic, lists = _features(rows, wanted)
    row = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])
    column = np.searchsorted(chosen, np.concatenate(lists)).astype(np.int32)
    share = np.where(toxic == 1, TOXIC_WEIGHT, 1.0)
    share /= share.sum()
    w, w_seen, b_seen = np.zeros(len(chosen)), np.full(len(chosen), 1e-8), 1e-8
    for _ in range(STEPS):
        z = bias + np.bincount(row, weights=(w * scale)[column], minlength=len(toxic))
        error = (_sigmoid(z) - toxic) * share
        step = scale * np.bincount(column, weights=error[row], minlength=len(w)) + DECAY * w
        w_seen += step * step
        b_seen += error.sum() ** 2
        w -= RATE * step / np.sqrt(w_seen)
        bias -= RATE * float(error.sum()) / float(np.sqrt(b_seen))
    weights[chosen] = w * scale
    return bias, weights


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def score(docs: DataFrame, labels: DataFrame, text: str = "text", most: int = MOST_LABELLED) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Labels are learned only from rows that are not held out. Null and empty texts get the
    score of a text without any feature, an empty table gives no rows. Repeated rows are scored
    each; very long texts are hashed in blocks. Other columns of ``docs`` are left out.
    """
    bias, weights = fit(docs, labels, text, most)
    model = docs.sparkSession.sparkContext.broadcast((bias, weights))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, weights = model.value
        wanted = weights != 0
        for batch in batches:
            z = np.full(len(batch), bias)
            for owner, buckets in present(batch.column(1).to_pylist(), wanted):
                np.add.at(z, owner, weights[buckets])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_sigmoid(z))], names=["doc_id", "score"])

    rows = docs.select("doc_id", whole(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
