"""Substring dedup: words covered by a window of 20 words that starts earlier elsewhere.

Every window is dealt to a shard by its own words, so equal windows meet whatever documents
they come from, and a document is searched only in shards that can hold one of its windows:

1. The key of a window is the least hash of its 13 runs of 8 words. Neighbouring windows share
   keys; a stretch of windows with one key is an occurrence of the key. Occurrences are
   counted per batch first, so that a key sends one row per batch, however often it occurs.
2. Only stretches whose key occurs twice or more are fetched as text. Equal stretches that
   meet in a task are settled there: all but the earliest are repeated as a whole.
3. The others are sorted by key and cut into shards of bounded size, never within a key. Each
   shard gets a compressed FM-index, its stretches are streamed through backward search, and
   the windows that have an earlier occurrence are reported as intervals.
4. A key with more different stretches than a shard holds, such as a frequent line between
   different neighbours, is not indexed: its windows are dealt out once more, each by a hash of
   all its words, and searched in the same way. A task that meets much of a key spreads its
   stretches at once and sends one mark under the key, so that all others follow.

Hashes only choose the shard; whether windows are equal is decided on the words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - used as pa.compute
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossaleaf.llm.common import whole
from glossaleaf.llm.fm_index import WINDOW, FmIndex

RUN = 8
RUNS = WINDOW - RUN + 1
# words per shard and stretches held back per task
SHARD_WORDS = 1 << 19
HELD = 50_000
# a key with more than this part of a shard among the stretches held back is dealt out by windows
PARTS = 64
CACHED_WORDS = 500_000
# a null id counts as the smallest
NO_ID = -(2**63)


class _Hashes(dict):
    """Word hashes of this worker; starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = _Hashes()


def stretches(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, number of windows, inner) of the stretches of windows with one key.

    ``inner`` says that a stretch holds its key's hash at two places and so may repeat a
    window of its own."""
    n = len(words) - WINDOW + 1
    if n < 1:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    each = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    run = np.zeros(len(words) - RUN + 1, np.uint64)
    for k in range(RUN):
        run *= np.uint64(0x9E3779B97F4A7C15)
        run += each[k : k + len(run)]
    run ^= run >> np.uint64(32)
    run *= np.uint64(0xD6E8FEB86659FD93)
    run ^= run >> np.uint64(32)
    least, width = run, 1
    while width < RUNS:
        step = min(width, RUNS - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    key, count, reach = least[first], np.diff(np.r_[first, n]), np.arange(RUNS)
    left = first + (run[first[:, None] + reach] == key[:, None]).argmax(axis=1)
    end = first + count + RUNS - 2
    right = end - (run[end[:, None] - reach] == key[:, None]).argmax(axis=1)
    return key, first, count, left < right


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(deal, at, text_key, start, n, many). The first row of a key in a batch is dealt by the
    key; the rest are known to be repeated and dealt evenly."""
    for batch in batches:
        parts = [stretches(text.split()) for text in batch.column(2).to_pylist()]
        owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        if not len(owner):
            continue
        key, start, n, inner = (np.concatenate([p[i] for p in parts]) for i in range(4))
        _, first, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        rest = np.ones(len(key), bool)
        rest[first] = False
        deal = key.copy()
        deal[rest] ^= (np.flatnonzero(rest).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(deal.view(np.int64)),
                batch.column(0).take(pa.array(owner)),
                batch.column(1).take(pa.array(owner)),
                pa.array(start.astype(np.int32)),
                pa.array(n.astype(np.int32)),
                pa.array(inner | (count[inverse] > 1)),
            ],
            names=["deal", "at", "text_key", "start", "n", "many"],
        )


class _Rows:
    """Rows (deal, at, text_key, start, n, words) on their way to a batch."""

    NAMES = ["deal", "at", "text_key", "start", "n", "words"]

    def __init__(self):
        self.columns: list[list] = [[] for _ in self.NAMES]

    def add(self, *values) -> None:
        for column, value in zip(self.columns, values):
            column.append(value)

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(self.columns, kinds)], names=self.NAMES)
        self.columns = [[] for _ in self.NAMES]
        return out


class _Earliest:
    """The earliest place of each content; the others are sent on as repeated, without words."""

    def __init__(self, out: _Rows):
        self.out = out
        self.of: dict[bytes, tuple] = {}

    def add(self, content: bytes, mine: tuple) -> None:
        other = self.of.setdefault(content, mine)
        if other[1:4] > mine[1:4]:
            self.of[content] = mine
            self._settle(other)
        elif other[1:4] < mine[1:4]:
            self._settle(mine)

    def _settle(self, stretch: tuple) -> None:
        self.out.add(hash(stretch[:4]), *stretch[1:], None)  # spread evenly

    def flush(self, split: bool) -> None:
        """Sends the contents on. With ``split`` the stretches of a large key go spread evenly and
        with a negative n, and a row without a place marks the key."""
        size: Counter[int] = Counter()
        if split:
            for stretch in self.of.values():
                size[stretch[0]] += stretch[4] + WINDOW - 1
        large = {key for key, words in size.items() if words > SHARD_WORDS // PARTS}
        for content, stretch in self.of.items():
            if stretch[0] in large:
                self.out.add(hash(stretch), *stretch[1:4], -stretch[4], content)
            else:
                self.out.add(*stretch, content)
        for key in large:
            self.out.add(key, None, 0, 0, 0, b"")
        self.of.clear()


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of repeated stretches. Without words: a stretch known to be repeated as a whole."""
    out = _Rows()
    earliest = _Earliest(out)
    for batch in batches:
        for at, text_key, text, starts in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
            words = text.split()
            key, first, count, _ = stretches(words)
            for i in np.flatnonzero(np.isin(first, starts)).tolist():
                start, n = int(first[i]), int(count[i])
                content = b" ".join(words[start : start + n + WINDOW - 1])
                earliest.add(content, (int(key[i].view(np.int64)), at, text_key, start, n))
            if len(earliest.of) >= HELD:
                earliest.flush(split=True)
            if len(out.columns[0]) >= HELD:
                yield out.batch()
        yield out.batch()
    earliest.flush(split=True)
    yield out.batch()


def _without_copies(rows: pa.Table) -> tuple[list[pa.RecordBatch], pa.Table]:
    """The intervals of stretches that equal an earlier one, and the rows without them."""
    first_of: dict[bytes, int] = {}
    source = np.array([first_of.setdefault(x, i) for i, x in enumerate(rows.column("words").to_pylist())])
    columns = [rows.column(c).to_numpy() for c in ("at", "text_key", "start", "n")]
    copy = np.flatnonzero(np.logical_or.reduce([c != c[source] for c in columns[:3]]))
    found = [_intervals(*(c[copy] for c in columns))] if len(copy) else []
    return found, rows.take(pa.array(np.flatnonzero(source == np.arange(len(source)))))


def _repeated(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The windows of one shard that occur earlier, as intervals; rows in order.

    Of equal stretches the first is indexed; the windows of the others all occur there."""
    copies, rows = _without_copies(rows)
    yield from copies
    at, text_key, start, n = (rows.column(c).to_numpy().astype(np.int64) for c in ("at", "text_key", "start", "n"))
    number: dict[bytes, int] = {}
    split = [x.split(b" ") for x in rows.column("words").to_pylist()]
    words = np.array([number.setdefault(w, len(number)) for part in split for w in part], np.int64)
    index = FmIndex(words, np.array([len(part) for part in split], np.int64))
    row = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    times, first = index.search(index.begins[row] + offset)
    first_row = np.searchsorted(index.begins, first, "right") - 1
    begin = start[row] + offset
    same_place = (
        (at[first_row] == at[row])
        & (text_key[first_row] == text_key[row])
        & (start[first_row] + first - index.begins[first_row] == begin)
    )
    found = np.flatnonzero((times > 1) & ~same_place)
    if len(found):
        # neighbouring windows of a stretch are one interval
        head = np.flatnonzero(np.r_[True, (row[found][1:] != row[found][:-1]) | (np.diff(found) != 1)])
        length = np.diff(np.r_[head, len(found)])
        found = found[head]
        yield _intervals(at[row[found]], text_key[row[found]], begin[found], length)


def _intervals(at: np.ndarray, text_key: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Repeated as a whole: rows without words, spread evenly."""
    deal = (at.astype(np.int64) ^ text_key) * np.int64(-0x61C8864680B583EB) + start
    columns = [deal, at, text_key, start.astype(np.int32), n.astype(np.int32)]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(len(at), pa.binary())], names=_Rows.NAMES)


def _size(rows: pa.RecordBatch | pa.Table) -> int:
    return int(np.sum(rows.column(4).to_numpy())) + (WINDOW - 1) * rows.num_rows


def _windows(rows: pa.RecordBatch | pa.Table, out: _Rows, earliest: _Earliest) -> Iterator[pa.RecordBatch]:
    """Deals the windows of stretches by a hash of all their words."""
    for at, text_key, start, n, text in zip(*(rows.column(i).to_pylist() for i in range(1, 6))):
        words = text.split(b" ")
        for i in range(abs(n)):
            window = b" ".join(words[i : i + WINDOW])
            earliest.add(window, (xxhash.xxh64_intdigest(window) - (1 << 63), at, text_key, start + i, 1))
        if len(earliest.of) >= HELD:
            earliest.flush(split=False)
        if len(out.columns[0]) >= HELD:
            yield out.batch()


def _searched(batches: Iterator[pa.RecordBatch], last: bool = False) -> Iterator[pa.RecordBatch]:
    """Cuts sorted stretches into shards between keys and searches each.

    Gives rows as :class:`_Rows` has them: intervals without words and, unless ``last``, the
    windows of the keys that are too large for a shard."""
    held: list[pa.RecordBatch] = []
    size = 0
    large = None  # the key that is being dealt out by windows
    out = _Rows()
    earliest = _Earliest(out)
    for batch in batches:
        settled = batch.filter(pa.compute.is_null(batch.column(5)))
        if settled.num_rows:
            yield settled.select(_Rows.NAMES)
        batch = batch.filter(pa.compute.is_valid(batch.column(5)))
        if not last:
            spread = pa.compute.less(batch.column(4), 0)
            yield from _windows(batch.filter(spread), out, earliest)
            batch = batch.filter(pa.compute.invert(spread))
        if not batch.num_rows:
            continue
        if not last:
            keys, mark = batch.column(0).to_numpy(), batch.column(1).is_null().to_numpy(zero_copy_only=False)
            split = np.isin(keys, keys[mark])
            if large is not None:
                split |= keys == large
            large = keys[-1] if split[-1] else None
            if split.any():
                yield from _windows(batch.filter(pa.array(split & ~mark)), out, earliest)
                batch = batch.filter(pa.array(~split))
                if not batch.num_rows:
                    continue
        held.append(batch)
        size += _size(batch)
        if size < SHARD_WORDS:
            continue
        rows = pa.Table.from_batches(held)
        keys = rows.column(0).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
        if cut:
            yield from _repeated(rows.slice(0, cut))
            rows = rows.slice(cut)
        if _size(rows) >= SHARD_WORDS:
            copies, rows = _without_copies(rows)
            yield from copies
        if _size(rows) >= SHARD_WORDS and not last:
            if large is None:  # else the key has ended in this batch
                large = keys[-1]
            yield from _windows(rows, out, earliest)
            rows = rows.slice(0, 0)
        held = rows.combine_chunks().to_batches()
        size = _size(rows)
    if held:
        yield from _repeated(pa.Table.from_batches(held))
    earliest.flush(split=False)
    yield out.batch()


def _searched_last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _searched(batches, last=True):
        yield batch.select(["at", "text_key", "start", "n"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        totals, removed, kept = [], [], []
        for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            words = text.split()
            if found:
                stay = np.ones(len(words), bool)
                for span in found:
                    stay[span["start"] : span["start"] + span["n"] + WINDOW - 1] = False
                left = [words[i] for i in np.flatnonzero(stay).tolist()]
            else:
                left = words
            totals.append(len(words))
            removed.append(len(words) - len(left))
            kept.append(b" ".join(left))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
            names=["doc_id", "n_words", "n_removed", "kept"],
        )


def _same(a: DataFrame, b: DataFrame) -> Column:
    return (a["at"] == b["at"]) & (a["text_key"] == b["text_key"])


def dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words that stay, joined by a
    space, as UTF-8 bytes).

    ``doc_id`` is a whole number; a null one counts as the smallest. Rows that repeat
    doc_id and text are one document returned as often; rows that share a doc_id alone are
    ordered by their text's hash. Null and empty texts have no words. Other columns of
    ``docs`` are left out. An empty table gives no rows; a very long text is cut into stretches.
    Every document with a repeated stretch is read a second time.
    """
    rows = docs.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("at"),
        F.xxhash64(whole(text)).alias("text_key"),
        whole(text).cast("binary").alias("text"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    seen = rows.select("at", "text_key", "text").mapInArrow(
        _occurrences, "deal long, at long, text_key long, start int, n int, many boolean"
    )
    by_key = Window.partitionBy("deal").orderBy("at", "text_key", "start")
    beside = F.lag("deal").over(by_key).isNotNull() | F.lead("deal").over(by_key).isNotNull()
    repeated = seen.withColumn("beside", beside).filter("many or beside")
    starts = repeated.groupBy("at", "text_key").agg(F.collect_set("start").alias("starts"))
    # with doc_id, so that this join and the last one read the texts as dealt out once
    fetched = (
        rows.join(starts, _same(rows, starts))
        .select("doc_id", rows["at"], rows["text_key"], "text", "starts")
        .mapInArrow(_fetched, "deal long, at long, text_key long, start int, n int, words binary")
    )
    order = ("deal", "at", "text_key", "start")  # a mark has no place and comes first
    searched = fetched.repartition("deal").sortWithinPartitions(*order).mapInArrow(_searched, fetched.schema)
    found = searched.repartition("deal").sortWithinPartitions(*order).mapInArrow(
        _searched_last, "at long, text_key long, start int, n int"
    )
    spans = found.groupBy("at", "text_key").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    joined = rows.join(spans, _same(rows, spans), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_kept, f"doc_id {kind}, n_words long, n_removed long, kept binary")
