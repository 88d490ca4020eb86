"""Language identification by character trigrams, trained and applied as Spark jobs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossaleaf.session import materialize

WEIGHTS_AT_ONCE = 2_000_000  # trigrams times languages in a task's memory
MAX_LANGUAGES = 10_000  # more labels than there are languages mean a wrong column
# a zero-width match at every code point; group 1 is the trigram that starts there
TRIGRAM = r"(?s)(?![\uDC00-\uDFFF])(?=(...))"
CODE_POINTS_AT_ONCE = 1_000_000


def trigrams(text: Column) -> Column:
    """All overlapping trigrams of code points, in one pass over the text."""
    return F.regexp_extract_all(text, F.lit(TRIGRAM), F.lit(1))


@dataclass
class Profile:
    """Per trigram the weight of each language, and per language its offset.

    Add-one smoothed naive Bayes: the score of a text is
    sum(log(n_gram_lang + 1)) - n_grams * log(total_lang + vocabulary), so trigrams the
    training text never had add nothing and need no row.
    """

    grams: DataFrame
    offsets: dict[str, float]
    size: int

    def slices(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Packed trigrams in ascending order and their weights, a bounded part at a time."""
        n = max(1, -(-self.size * len(self.offsets) // WEIGHTS_AT_ONCE))
        for i in range(n):
            rows = self.grams.filter(F.pmod(F.xxhash64("gram"), F.lit(n)) == i).toPandas()
            packed = _packed(_code_points("".join(rows["gram"])))[::3] if len(rows) else np.empty(0, "int64")
            order = np.argsort(packed)
            yield packed[order], rows.drop(columns="gram").to_numpy("float64")[order]


def train(texts: DataFrame, text: str, language: str) -> Profile:
    """Counts trigrams per language; the counts combine before the shuffle.

    Only the totals come to the driver, one number per language; a null label is left out.
    """
    counts = (
        texts.filter(F.col(language).isNotNull())
        .select(F.col(language).alias("language"), F.explode(trigrams(F.col(text))).alias("gram"))
        .groupBy("gram", "language")
        .agg(F.count("*").alias("n"))
    )
    # read several times below, and far smaller than the texts
    counts = materialize(counts, "trigram-counts")
    totals = dict(counts.groupBy("language").agg(F.sum("n")).sort("language").limit(MAX_LANGUAGES + 1).collect())
    if len(totals) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels in column {language}")
    size = counts.select("gram").distinct().count()
    weights = [
        F.log(F.coalesce(F.sum(F.when(F.col("language") == name, F.col("n"))), F.lit(0)) + 1).alias(f"w{i}")
        for i, name in enumerate(totals)
    ]
    offsets = {name: math.log(total + size) for name, total in totals.items()}
    return Profile(counts.groupBy("gram").agg(*weights), offsets, size)


def detect(
    texts: DataFrame, key: str | list[str], text: str, profile: Profile, out: str = "detected_language"
) -> DataFrame:
    """(key..., language) for every row; null for a text without a trigram.

    Each text is scored where it lies, without a shuffle. A profile that is too large for a
    task's memory is taken in parts, with one pass over the texts for each; scores add up.
    """
    keys = [key] if isinstance(key, str) else key
    rows = texts.select(*keys, F.col(text).alias("_text"), F.lit(None).cast("array<double>").alias("_scores"))
    for i, (known, weights) in enumerate(profile.slices()):
        if i:
            rows = materialize(rows, "scores")  # one part of the profile in memory at a time
        scored = _scorer(known, weights, len(profile.offsets))(F.col("_text"))
        before = F.col("_scores")
        total = scored if not i else F.zip_with(before, scored, lambda a, b: a + b)
        rows = rows.withColumn("_scores", total)
    n_grams = F.char_length("_text") - 2
    ranked = F.array(
        *[
            F.struct((F.get("_scores", i) - n_grams * offset).alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("language"))
            for i, (name, offset) in enumerate(profile.offsets.items())
        ]
    )
    best = F.array_max(ranked)["language"] if profile.offsets else F.lit(None).cast("string")
    return rows.select(*keys, F.when(n_grams > 0, best).alias(out))


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="uint32").astype("int64")


def _packed(points: np.ndarray) -> np.ndarray:
    """Three code points of 21 bits as one number, for every position but the last two."""
    return (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]


def _scorer(known: np.ndarray, weights: np.ndarray, languages: int):
    """A batch function from texts to the sums of their trigrams' weights, by language.

    A lookup of packed trigrams in a sorted array costs about a tenth of exploding the
    text, hashing each trigram and adding up the rows again.
    """

    def score(text: str | None) -> np.ndarray:
        total = np.zeros(languages)
        if text is None or not len(known):
            return total
        points = _code_points(text)
        for at in range(0, len(points) - 2, CODE_POINTS_AT_ONCE):
            grams = _packed(points[at: at + CODE_POINTS_AT_ONCE + 2])
            place = np.minimum(np.searchsorted(known, grams), len(known) - 1)
            found = place[known[place] == grams]
            if len(found) < len(known):
                total += weights[found].sum(axis=0)
            else:
                total += np.bincount(found, minlength=len(known)) @ weights
        return total

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def sums(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([score(t) for t in batch], dtype=object)

    return sums
