"""Phrase collocations by sorted count streams, as in external estimation of n-gram models.

1. Texts become chunks of about ``CHUNK`` words, stored as local word numbers with breaks between
   pieces; each chunk has a small vocabulary.
2. The vocabularies are summed. Words that occur often enough to be part of a candidate are numbered
   in the order of (language, word), so that the order of numbers is the order of words.
3. Each chunk turns every position into the key (word, next word, next but one; 0 for a break),
   sorts its keys, sums equal ones and cuts the sorted stream at fixed places of the whole key
   range. The streams of a range are merged in prefix order: the same run of keys gives the
   trigrams, their prefixes and so the left parts.
4. What is frequent is kept in prefix order and in suffix order (the words after the first), and merge
   joins in lockstep over both give left, right and extension counts. No table is looked up by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossaleaf.llm.common import whole
from glossaleaf.llm.sharding import numbered
from glossaleaf.session import materialize

# words of a chunk, and positions expected in a range of keys
CHUNK = 1_000_000
RANGE = 2_000_000

# fixed values: what ends a piece, and what parts its words
ENDS = b".,;:!?\n\x0b\x0c\r"
PARTS = bytes.maketrans(ENDS + b"\t", b"\n" * len(ENDS) + b" ")

CHUNKED = "chunk long, tokens binary, local int, lang string, word string, n long"
STREAM = np.dtype([("w1", "<u4"), ("w2", "<u4"), ("w3", "<u4"), ("n", "<u4")])


def words_of(text: str) -> list[bytes]:
    """The words in UTF-8, A-Z in lower case; a line feed stands for the end of a piece."""
    data = text.encode().lower().translate(PARTS)
    return data.replace(b"\n", b" \n ").split(b" ")


class _Chunk:
    """Words as numbers from 1 on in order of appearance, 0 for a break."""

    def __init__(self, number: int):
        self.number = number
        self.known: dict[str, dict[bytes, int]] = {}
        self.words: list[tuple[str, bytes]] = []
        self.tokens: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, words: list[bytes]) -> None:
        known = self.known.setdefault(lang, {b"": -1, b"\n": 0})
        for word in dict.fromkeys(words):
            if word not in known:
                self.words.append((lang, word))
                known[word] = len(self.words)
        numbers = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
        self.tokens += [numbers[numbers >= 0], np.zeros(1, np.int32)]
        self.size += len(numbers)

    def rows(self) -> pa.RecordBatch:
        tokens = np.concatenate(self.tokens)
        counts = np.bincount(tokens, minlength=len(self.words) + 1)[1:]
        n = len(self.words)
        columns = [
            pa.array([self.number] * (n + 1), pa.int64()),
            pa.array([pa.compress(tokens.tobytes(), codec="zstd", asbytes=True)] + [None] * n, pa.binary()),
            pa.array([len(tokens), *range(1, n + 1)], pa.int32()),
            pa.array([None] + [lang for lang, _ in self.words], pa.string()),
            pa.array([None] + [word.decode() for _, word in self.words], pa.string()),
            pa.array([None, *counts.tolist()], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "tokens", "local", "lang", "word", "n"])


def chunks(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The chunks, written once: a row with the tokens of a chunk (``local``: how many) and a row for
    each of its words. A text longer than a chunk makes a longer chunk."""
    rows = docs.select(whole(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk(TaskContext.get().partitionId() << 32)
        for batch in batches:
            # one row at a time: the texts of a batch need not fit in Python together
            for one, code in zip(batch.column(0), batch.column(1).to_pylist()):
                chunk.add(code, words_of(one.as_py()))
                if chunk.size >= CHUNK:
                    yield chunk.rows()
                    chunk = _Chunk(chunk.number + 1)
        if chunk.tokens:
            yield chunk.rows()

    return materialize(rows.mapInArrow(run, CHUNKED), "chunks")


def vocabulary(written: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(words, sizes): (lang, word, f, id, before) of the words with ``least`` occurrences, where ``before``
    sums the f of the words in front; and (lang, n), all word occurrences."""
    counts = written.filter("tokens IS NULL").groupBy("lang", "word").agg(F.sum("n").alias("f"))
    counts = materialize(counts, "word-counts")
    known = materialize(numbered(counts.filter(F.col("f") >= least), ["lang", "word"], "row", "total"), "words")
    # one sum per slice of the numbers; inside a slice a running sum
    sliced = known.withColumn("slice", F.expr("row div 100000"))
    sums = sliced.groupBy("slice").agg(F.sum("f").alias("s"))
    front = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("slice", F.coalesce(F.sum("s").over(front), F.lit(0)).alias("start"))
    within = Window.partitionBy("slice").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    words = (
        sliced.withColumn("inside", F.coalesce(F.sum("f").over(within), F.lit(0)))
        .join(starts.hint("merge"), "slice")
        .select("lang", "word", "f", (F.col("row") + 1).alias("id"), (F.col("start") + F.col("inside")).alias("before"))
    )
    return materialize(words, "vocabulary"), counts.groupBy("lang").agg(F.sum("f").alias("n"))


def _summed(w1: np.ndarray, w2: np.ndarray, w3: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Equal keys as one, in prefix order."""
    order = np.lexsort((w3, w2, w1))
    w1, w2, w3, n = w1[order], w2[order], w3[order], n[order]
    new = np.append(True, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1]) | (w3[1:] != w3[:-1]))
    first = np.flatnonzero(new)
    return [w1[first], w2[first], w3[first], np.add.reduceat(n, first)] if len(first) else [w1, w2, w3, n]


def _packed(rows: np.ndarray) -> bytes:
    # bytes of one weight lie together: the high ones of sorted numbers hardly change
    planes = rows.view(np.uint8).reshape(len(rows), STREAM.itemsize).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, n * STREAM.itemsize, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(STREAM.itemsize, n).T).reshape(-1).view(STREAM)


def _streams(tokens: pa.Table, words: pa.Table, total: float, width: int) -> pa.Table:
    """The count stream of a chunk, in prefix order, cut at the ranges of the key space."""
    out = {"range": [], "n": [], "stream": []}
    if tokens.num_rows and words.num_rows:
        row = tokens.to_pylist()[0]
        data = np.frombuffer(pa.decompress(row["tokens"], row["local"] * 4, codec="zstd", asbytes=True), np.int32)
        local, ids = words["local"].to_numpy(), words["id"].to_numpy()
        order = np.argsort(ids)
        # ranks inside the chunk, in the order of the ids; other words end a phrase as a break does
        rank = np.zeros(max(int(data.max(initial=0)), int(local.max())) + 1, np.uint64)
        rank[local[order]] = np.arange(1, len(order) + 1)
        at = np.append(rank[data], np.zeros(2, np.uint64))
        third = np.where(at[1:-1] > 0, at[2:], 0)
        starts = at[:-2] > 0
        parts = [x[starts] for x in (at[:-2], at[1:-1], third)]
        if len(order) < 1 << 21:
            key, n = np.unique((parts[0] << np.uint64(42)) | (parts[1] << np.uint64(21)) | parts[2], return_counts=True)
            parts = [key >> np.uint64(s) & np.uint64((1 << 21) - 1) for s in (42, 21, 0)]
        else:
            *parts, n = _summed(*parts, np.ones(len(third), np.int64)[starts])
        parts = [x.astype(np.int64) for x in parts]
        ids = np.append(0, ids[order])
        f = np.append(0, words["f"].to_numpy()[order]).astype(float)
        before = np.append(0, words["before"].to_numpy()[order]).astype(float)
        # where a key would lie among all positions if words followed each other by chance
        place = before[parts[2]] / total
        place = (before[parts[1]] + f[parts[1]] * place) / total
        place = before[parts[0]] + f[parts[0]] * place
        slot = np.floor(place / width).astype(np.int64)
        rows = np.empty(len(n), STREAM)
        for name, part in zip(("w1", "w2", "w3"), parts):
            rows[name] = ids[part]
        rows["n"] = n
        cuts = np.flatnonzero(np.diff(slot, prepend=-1)).tolist()
        for start, stop in zip(cuts, [*cuts[1:], len(rows)]):
            out["range"].append(int(slot[start]))
            out["n"].append(stop - start)
            out["stream"].append(_packed(rows[start:stop]))
    return pa.table([pa.array(out["range"], pa.int64()), pa.array(out["n"], pa.int32()), pa.array(out["stream"], pa.binary())], names=list(out))


def _merged(streams: pa.Table, least: int) -> pa.Table:
    """The streams of one range merged: frequent trigrams, and the counts of their prefixes. A pair
    may go on in the next range, so the first and the last one come whatever their count."""
    parts = [_unpacked(d.as_py(), n) for d, n in zip(streams["stream"], streams["n"].to_pylist())]
    rows = np.concatenate(parts)
    w1, w2, w3, n = _summed(rows["w1"], rows["w2"], rows["w3"], rows["n"].astype(np.int64))
    often = (n >= least) & (w3 > 0)
    pair = np.flatnonzero(np.append(True, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])))
    a = np.add.reduceat(n, pair)
    keep = a >= least
    keep[[0, -1]] = True
    keep &= w2[pair] > 0
    columns = [np.concatenate([x[pair][keep], x[often]]) for x in (w1, w2)]
    columns += [np.concatenate([np.zeros(keep.sum(), w3.dtype), w3[often]]), np.concatenate([a[keep], n[often]])]
    return pa.table([pa.array(x.astype(np.int64)) for x in columns], names=["w1", "w2", "w3", "a"])


def counted(docs: DataFrame, least: int, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(grams, words, sizes): (w1, w2, w3, a) of all phrases of two and three words (w3 0 or the third) that
    occur ``least`` times, by word numbers; the vocabulary; and the words per language."""
    written = chunks(docs, text, lang)
    words, sizes = vocabulary(written, least)
    total = float(words.agg(F.sum("f")).first()[0] or 0)
    own = written.filter("tokens IS NULL").select("chunk", "local", "lang", "word")
    mapped = own.join(words, ["lang", "word"]).select("chunk", "local", "id", "f", "before")
    tokens = written.filter("tokens IS NOT NULL").select("chunk", "local", "tokens").toDF("chunk", "local", "tokens")
    streams = (
        tokens.groupBy("chunk")
        .cogroup(mapped.groupBy("chunk"))
        .applyInArrow(lambda x, y: _streams(x, y, total, RANGE), "range long, n int, stream binary")
    )
    parts = streams.groupBy("range").applyInArrow(lambda x: _merged(x, least), "w1 long, w2 long, w3 long, a long")
    grams = parts.groupBy("w1", "w2", "w3").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)
    return materialize(grams, "grams"), words, sizes


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (l * r)), whole numbers of up to 37 digits; counts stay below 10**14."""
    a, left, right = [x.cast("decimal(14,0)") for x in (a, left, right)]
    top = (a * a) * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", top, left * right)


def collocations(
    docs: DataFrame, least: int = 10, covered: int = 50, best: int = 2000, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of two and three words of each language.

    Texts are lower-cased in A-Z and split at ``.,;:!?`` and line ends into pieces, those into words
    at blanks and tabs. Candidates occur ``least`` times inside pieces, overlaps included. Cutting one
    behind its first k words gives l and r, the counts of both parts; the lowest score over the cuts
    counts, ties to the smallest k. A pair goes if a candidate of three words holds it
    and has at least ``covered`` percent of its count. Each language's first ``best`` are returned,
    by score, then count (both falling), then phrase.

    A null language is ``und``; null and empty texts have no words; repeated rows and equal ids
    count each. A language without candidates, and an empty table, give no rows. Other
    columns are left out. Very long texts are read whole. A word that is very frequent spreads over
    many ranges of keys.
    """
    grams, words, sizes = counted(docs, least, text, lang)
    pairs = grams.filter("w3 = 0").select("w1", "w2", "a")
    triples = grams.filter("w3 > 0")

    def with_count(rows: DataFrame, key: str, name: str) -> DataFrame:
        return rows.join(words.select(F.col("id").alias(key), F.col("f").alias(name)).hint("merge"), key)

    # prefix order: the first two words of a triple are a pair; suffix order: its last two are
    prefix = pairs.toDF("w1", "w2", "f12").hint("merge")
    suffix = pairs.toDF("w2", "w3", "f23").hint("merge")
    threes = triples.join(prefix, ["w1", "w2"]).join(suffix, ["w2", "w3"])
    threes = with_count(with_count(threes, "w1", "f1"), "w3", "f3")
    cuts = F.array(
        F.struct(_score(F.col("a"), F.col("f1"), F.col("f23")).alias("score"), F.lit(1).alias("k"), F.col("f1").alias("l"), F.col("f23").alias("r")),
        F.struct(_score(F.col("a"), F.col("f12"), F.col("f3")).alias("score"), F.lit(2).alias("k"), F.col("f12").alias("l"), F.col("f3").alias("r")),
    )
    threes = threes.select("w1", "w2", "w3", "a", F.array_min(cuts).alias("cut"))

    # extensions: the most frequent triple that goes on to the right, and to the left
    right = triples.groupBy("w1", "w2").agg(F.max("a").alias("on_right")).hint("merge")
    left = triples.groupBy(F.col("w2").alias("w1"), F.col("w3").alias("w2")).agg(F.max("a").alias("on_left")).hint("merge")
    twos = pairs.join(right, ["w1", "w2"], "left").join(left, ["w1", "w2"], "left")
    longest = F.greatest(F.coalesce("on_right", F.lit(0)), F.coalesce("on_left", F.lit(0)))
    twos = twos.filter(100 * longest < covered * F.col("a"))
    twos = with_count(with_count(twos, "w1", "f1"), "w2", "f2")
    cut = F.struct(_score(F.col("a"), F.col("f1"), F.col("f2")).alias("score"), F.lit(1).alias("k"), F.col("f1").alias("l"), F.col("f2").alias("r"))
    twos = twos.select("w1", "w2", F.lit(0).cast("long").alias("w3"), "a", cut.alias("cut"))

    found = twos.unionByName(threes).select("w1", "w2", "w3", "a", "cut.score", "cut.l", "cut.r")
    for place in (1, 2, 3):
        text_of = words.select(F.col("id").alias(f"w{place}"), F.col("word").alias(f"t{place}"), *(["lang"] if place == 1 else []))
        found = found.join(text_of.hint("merge"), f"w{place}", "left" if place == 3 else "inner")
    named = found.withColumn("phrase", F.concat_ws(" ", "t1", "t2", "t3"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
