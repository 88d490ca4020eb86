"""Quality rules: text counts and a hashed n-gram log-likelihood ratio, all in the JVM.

The n-grams are taken across word boundaries: the last three characters of a word, a space
and the first character of the next, hashed to ``buckets``. Two multinomials are
counted, one over trusted documents and one over the whole corpus. A document's score is the
mean over its n-grams of log p(trusted) - log p(corpus).

The verdict comes from the same ratio with equal texts weighed once in both multinomials, so
that copies of a text, which swell its n-grams in the corpus, cannot reject it: a document is
kept if no base rule fails and that ratio, ``score_once``, is not below ``threshold``, which
holds for every document alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaleaf.functions.rows import explode_rows, settled
from glossaleaf.llm.common import WHITE, let, packed, whole, words_of

# fixed values of the base rules
SYMBOLS = "[#*$%&|<>]"
LEAST_WORDS = 50
MOST_REPEATED = 50  # of 100 words

BUCKETS = 1 << 14
SMOOTHING = 1.0
# in nats for each n-gram; clean prose lies about 0, text of another make far below
THRESHOLD = -0.5


def _grams(words: Column, buckets: int) -> Column:
    def gram(word: Column, i: Column) -> Column:
        following = F.get(words, i + 1)
        return F.pmod(F.xxhash64(F.concat(F.substring(word, -3, 3), F.lit(" "), F.substring(following, 1, 1))), F.lit(buckets))

    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), gram)


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the text, the first included."""
    count = F.greatest(F.size(words) - 2, F.lit(0))

    def covered(starts: Column) -> Column:
        reach = F.transform(starts, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - p, F.lit(3))))
        return F.aggregate(reach, F.lit(0).cast("long"), lambda total, n: total + n)

    def repeated(ordered: Column) -> Column:
        def start(x: Column, k: Column) -> Column:
            same = (F.get(ordered, k + 1)["h"] == x["h"]) | (F.get(ordered, k - 1)["h"] == x["h"])
            return F.when(same, x["i"])

        return let(F.sort_array(F.array_compact(F.transform(ordered, start))), covered)

    def checked(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            let(F.array_sort(pairs), repeated)
        )

    windows = F.transform(
        F.slice(words, 1, count), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))
    )
    return let(windows, checked)


def _line_count(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def _worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.trim(line, F.lit(WHITE)) != "")


def weights(docs: DataFrame, trusted_ids: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """One row with the log ratio of every bucket, all 0 without trusted text: ``weights``
    counts every row, ``once`` counts equal texts once.

    All rows of ``docs`` count. Equal texts, those with one SHA-256, combine before the only
    shuffle of n-grams, so a task sends each of its texts once, as n-grams, however
    many copies it has; then a task sends one row per bucket at most. A text is trusted if one
    of its rows is. ``trusted_ids`` are distinct and may be any number: Spark broadcasts them
    while they are small and else shuffles them and the ids and digests of the rows, without their n-grams.
    """
    mark = trusted_ids.select(F.col("doc_id").alias("trusted_id"))
    grams = let(words_of(whole(text)), lambda words: _grams(words, buckets))
    grams = grams.cast("array<short>" if buckets <= 1 << 15 else "array<int>")
    digest = F.unhex(F.sha2(whole(text), 256)).alias("digest")
    marked = docs.select("doc_id", digest).join(mark, F.col("doc_id") == F.col("trusted_id"))
    rows = docs.select(digest, grams.alias("grams"), F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("n_trusted"))
    marks = marked.groupBy("digest").agg(F.lit(0).cast("long").alias("n"), F.count("*").alias("n_trusted"))
    texts = rows.unionByName(marks, allowMissingColumns=True).groupBy("digest").agg(
        F.any_value("grams", True).alias("grams"), F.sum("n").alias("n"), F.sum("n_trusted").alias("n_trusted")
    )
    each = explode_rows(texts, ["n", "n_trusted"], "grams", "place", "bucket")
    counts = each.groupBy("bucket").agg(
        F.sum("n").alias("c"),
        F.sum("n_trusted").alias("t"),
        F.count("*").alias("c_once"),
        F.count_if(F.col("n_trusted") > 0).alias("t_once"),
    )
    every = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(counts, "bucket", "left")
    sums = ("c", "t", "c_once", "t_once")
    pairs = F.sort_array(F.collect_list(F.struct("bucket", *[F.coalesce(x, F.lit(0)).alias(x) for x in sums])))
    rest = SMOOTHING * buckets
    model = every.agg(pairs.alias("p"), *[F.sum(x).alias(x) for x in sums])

    def ratio(t: str, c: str) -> Column:
        level = F.log((F.col(c) + rest) / (F.col(t) + rest))
        found = F.transform("p", lambda x: (F.log((x[t] + SMOOTHING) / (x[c] + SMOOTHING)) + level).cast("float"))
        return F.when(F.col(t) > 0, found).otherwise(F.array_repeat(F.lit(0.0).cast("float"), buckets))

    return model.select(ratio("t", "c").alias("weights"), ratio("t_once", "c_once").alias("once"))


def trusted(labels: DataFrame, most: int | None = None) -> DataFrame:
    """Ids of documents labelled of good quality, all or at most ``most`` in the order of a hash."""
    good = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return good if most is None else good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _judged(
    docs: DataFrame, model: DataFrame, text: str, carried: list[Column], threshold: float, buckets: int, scores: dict[str, str]
) -> DataFrame:
    """``scores`` names the column of ``model`` that each score takes; ``score_once`` is one of them."""
    content, words = F.col("text"), F.col("words")
    # the model is one value of fixed size, its columns end to end
    rows = docs.select(*carried, whole(text).alias("text"), model.select(F.concat(*scores.values())).scalar().alias("weights"))
    rows = settled(rows, words=words_of(content))

    def mean(grams: Column, skip: int) -> Column:
        total = F.aggregate(grams, F.lit(0.0), lambda acc, g: acc + F.get("weights", (g + skip).cast("int")))
        return total / F.greatest(F.size(words) - 1, F.lit(1))

    def means(grams: Column) -> Column:
        return F.struct(*[mean(grams, k * buckets).alias(name) for k, name in enumerate(scores)])

    counted = settled(
        rows,
        n_words=F.size(words).cast("long"),
        word_chars=F.length(F.array_join(words, "")).cast("long"),
        n_symbols=F.regexp_count(content, F.lit(SYMBOLS)).cast("long"),
        n_dup_lines=let(_worded_lines(content), _line_count),
        n_repeat_words=_repeat_words(words),
        scores=let(_grams(words, buckets), means),
    ).drop("text", "words", "weights")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    judged = counted.withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("scores.score_once") >= threshold))


def judge(
    docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = THRESHOLD,
    buckets: int = BUCKETS, most_trusted: int | None = None,
) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, score, base_failed, kept, score_once. ``score`` counts all rows, ``kept``
    follows from ``score_once``, see above.

    A null text counts as empty and fails for want of words. Repeated rows count and are
    returned each. Without any trusted text the base rules alone decide. Other columns of
    ``docs`` are left out. An empty table gives no rows; very long texts count whole.
    """
    model = weights(docs, trusted(labels, most_trusted), text, buckets)
    judged = _judged(
        docs, model, text, [F.col("doc_id")], threshold, buckets, {"score": "weights", "score_once": "once"}
    )
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "scores.score",
        "base_failed", "kept", "scores.score_once",
    )


def kept_rows(
    docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = THRESHOLD,
    buckets: int = BUCKETS, most_trusted: int | None = None,
) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; see :func:`judge`."""
    model = weights(docs, trusted(labels, most_trusted), text, buckets)
    judged = _judged(docs, model, text, [packed(docs).alias("row")], threshold, buckets, {"score_once": "once"})
    return judged.filter("kept").select("row.*")
