"""Cross-tokenizer alignment by inverted pair bitmaps.

Both tokenizers cut the same bytes. Between two neighbouring token ends lies one stretch that
belongs to one token of each side: that is a link. Where both end, a group ends. Texts are cut
into units (a blank between two visible characters starts one) at which both always end, so a
worker encodes and aligns a unit once and looks it up afterwards.

Documents are numbered within containers of ``CONTAINER`` rows. For each id pair a container
holds bit planes: bit k of a document's number of such links is its bit in plane k. Only
words of 64 documents with a bit set are kept. The planes of one batch of rows are OR-merged into
those of the container; OR over the planes of a pair gives its document bitmap, whose popcount is the
number of documents, and the popcounts of the planes, weighed by 2**k, give the number of links.
Sums over the containers are the counts of the whole corpus. They return to the documents through
the same planes.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tiktoken import Encoding
from tokenizers import Tokenizer

from glossaleaf.llm.common import whole
from glossaleaf.session import materialize

CONTAINER = 4096
# a container is closed early when it holds so many (pair, document) postings
POSTINGS = 1_500_000
# characters and rows that are in Python at once; a longer text is taken alone
CHARS = 2_000_000
ROWS = 512
# units that a worker remembers, and the links of all of them
UNITS = 500_000
UNIT_LINKS = 6_000_000

# characters of a unit that is encoded by itself
LONG = 200

# fixed value: how a byte-level tokenizer cuts a text before its merges
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CUT = re.compile(r"(?<=\S) (?=\S)")
BLANK = "▁"
ENTRY = np.dtype([("at", "<u2"), ("word", "<u8")])


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for
    themselves, the others from code point 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and the units known so far."""

    def __init__(self, byte_level: bytes, pieces: bytes):
        # one task is one core
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(byte_level.decode())
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=pieces)
        letters = _byte_letters()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.bytes_a = [bytes(letters[c] for c in x) if all(c in letters for c in x) else x.encode() for x in names]
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(x[3:-1], 16)]) if self.b.is_byte(i) else x.replace(BLANK, " ").encode() for i, x in enumerate(names)
        ]
        self.size_a = np.array([len(x) for x in self.bytes_a], dtype=np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)
        # no piece goes on over a blank, and the other side cuts there by its pattern
        layout = json.loads(byte_level)["pre_tokenizer"] or {}
        self.cuts = layout.get("type") == "ByteLevel" and not any(re.search(f"[^{BLANK}]{BLANK}", x) for x in names)
        self.quick = self._quick_a(json.loads(byte_level))
        self.signs = [
            f"{i}{sign}" for names, ends in ((self.bytes_a, ",|"), (self.bytes_b, ",;")) for sign in ends for i in range(len(names))
        ]
        self.clear()

    def _quick_a(self, layout: dict) -> Callable[[str], list[int]]:
        """The ids of a text of ordinary words. Where the merges of a byte-level vocabulary come in the
        order of their ids, its ids are ranks, and a rank encoder gives the same ids sooner."""
        vocab, merges = layout["model"]["vocab"], layout["model"].get("merges", [])
        joined = ["".join(x if isinstance(x, list) else x.split(" ")) for x in merges]
        if self.cuts and [vocab.get(x) for x in joined] == list(range(256, 256 + len(joined))):
            letters = _byte_letters()
            ranks = {bytes(letters[c] for c in x): i for x, i in vocab.items()}
            return Encoding("byte level", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda text: self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.text: list[str] = []
        # per unit: tokens on either side, groups, links; a unit without tokens has -1
        self.sizes = tuple(array("q") for _ in range(4))
        self.links = array("q")

    def units(self, text: str) -> list[str]:
        return CUT.split(text) if self.cuts else [text]

    def learn(self, units: set[str]) -> None:
        """Encodes and aligns the units not known yet; all but odd and very long ones in one call."""
        if len(self.number) > UNITS or len(self.links) > UNIT_LINKS:
            self.clear()
        new = list(units.difference(self.number))
        if not new:
            return
        together, alone = [], []
        for unit in new:
            joins = self.cuts and len(unit) <= LONG and BLANK not in unit and not (unit[0].isspace() or unit[-1].isspace())
            (together if joins else alone).append(unit)
        if together and not self._align(together, self.quick(" " + " ".join(together)), self.b.encode(together, num_threads=1)):
            alone += together
        for unit in alone:
            ids = self.a.encode_batch_fast([" " + unit], add_special_tokens=False)[0].ids
            if not self._align([unit], ids, [self.b.encode(unit)]):
                self._add([unit], [""], [[-1], [0], [0], [0]])

    def _add(self, units: list[str], texts: list[str], sizes: list) -> None:
        self.number.update(zip(units, range(len(self.text), len(self.text) + len(units))))
        self.text += texts
        for column, size in zip(self.sizes, sizes):
            column.frombytes(np.asarray(size, dtype=np.int64).tobytes())

    def _align(self, units: list[str], ids_a: list[int], ids_b: list[list[int]]) -> bool:
        """False, and nothing learned, if the tokens' bytes are not those of the units."""
        a = np.array(ids_a, dtype=np.int64)
        b = np.fromiter(chain.from_iterable(ids_b), np.int64)
        want = (" " + " ".join(units)).encode()
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != want or b"".join(map(self.bytes_b.__getitem__, b.tolist())) != want:
            return False
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = np.cumsum([len(u.encode()) + 1 for u in units])
        stops = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
        twice = stops[1:] == stops[:-1]
        both, stops = stops[1:][twice], stops[np.append(True, ~twice)]
        last = np.searchsorted(both, ends)
        if last[-1] >= len(both) or (both[last] != ends).any():
            return False
        pairs = a[np.searchsorted(ends_a, stops)] * len(self.bytes_b) + b[np.searchsorted(ends_b, stops)]
        counts = [np.diff(np.searchsorted(x, ends, "right"), prepend=0) for x in (ends_a, ends_b, both, stops)]
        # the tokens as text, each with the sign behind it: A's of a group, then B's
        group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        final_a, final_b = both[group_a] == ends_a, both[group_b] == ends_b
        n_a, n_b = len(self.bytes_a), len(self.bytes_b)
        signs = np.concatenate([a + final_a * n_a, 2 * n_a + b + final_b * n_b])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        parts = list(map(self.signs.__getitem__, signs[order].tolist()))
        stop = np.cumsum(counts[0] + counts[1]).tolist()
        texts = ["".join(parts[at:to]) for at, to in zip([0, *stop], stop)]
        self._add(units, texts, counts)
        self.links.frombytes(pairs.tobytes())
        return True


@functools.lru_cache(maxsize=1)
def tokenizers(byte_level: bytes, pieces: bytes) -> Tokenizers:
    return Tokenizers(byte_level, pieces)


# ---- planes ----


def planes_of(pairs: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The planes of the links (pair, document): sorted keys of pair, plane and place of the word
    (6 bits each), and the words."""
    links = np.sort(pairs << 12 | docs)
    first = np.flatnonzero(np.diff(links, prepend=-1))
    times = np.diff(first, append=len(links))
    postings = links[first]
    keys, words = [], []
    for plane in range(int(times.max(initial=0)).bit_length()):
        have = postings[times >> plane & 1 == 1]
        keys.append(have & ~0xFFF | plane << 6 | (have >> 6 & 63))
        words.append(np.uint64(1) << (have & 63).astype(np.uint64))
    return or_merged(keys, words)


def or_merged(keys: list[np.ndarray], words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sparse bitmaps merged: the words under one key are combined by OR."""
    if not sum(map(len, keys)):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    key, word = np.concatenate(keys), np.concatenate(words)
    order = np.argsort(key, kind="stable")
    key, word = key[order], word[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.bitwise_or.reduceat(word, first)


def _posting_rows(keys: np.ndarray, words: np.ndarray, n_pieces: int) -> dict[str, pa.Array]:
    """A row per pair: ids, documents, links, and its entries of 10 bytes."""
    pair = keys >> 12
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    n_links = np.add.reduceat(np.bitwise_count(words).astype(np.int64) << (keys >> 6 & 63), first) if len(first) else first
    # the document bitmap: the planes of a pair in one
    in_docs, doc_words = or_merged([pair << 6 | keys & 63], [words])
    own = np.flatnonzero(np.diff(in_docs >> 6, prepend=-1))
    n_docs = np.add.reduceat(np.bitwise_count(doc_words).astype(np.int64), own) if len(own) else own
    entries = np.empty(len(keys), ENTRY)
    entries["at"], entries["word"] = keys & 0xFFF, words
    offsets = np.append(first, len(keys)).astype(np.int32) * ENTRY.itemsize
    marks = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(entries.tobytes())])
    a, b = np.divmod(pair[first], n_pieces)
    return {
        "a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()),
        "n_docs": pa.array(n_docs, pa.int64()), "n_links": pa.array(n_links, pa.int64()), "marks": marks,
    }


def _some_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        texts = batch.column(0).to_pylist()
        start = size = 0
        for i, text in enumerate(texts):
            if i > start and (i - start == ROWS or size + len(text) > CHARS):
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(text)
        if texts:
            yield batch.slice(start), texts[start:]


MADE = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string"}
POSTING = {"a": "int", "b": "int", "n_docs": "long", "pair_links": "long", "marks": "binary"}


def _encoded(known: Tokenizers, texts: list[str]) -> tuple[list[np.ndarray], list[str], np.ndarray, np.ndarray]:
    """Per text the four sizes and the digest; and of all links the pair and the text they are in."""
    cut = [known.units(x) if x else [] for x in texts]
    known.learn(set().union(*cut))
    numbers = [list(map(known.number.__getitem__, units)) for units in cut]
    flat = np.fromiter(chain.from_iterable(numbers), np.int64)
    text_of = np.repeat(np.arange(len(texts)), [len(x) for x in numbers])
    sizes = [np.frombuffer(x, np.int64) if len(x) else np.empty(0, np.int64) for x in known.sizes]
    dead = np.zeros(len(texts), bool)
    dead[text_of[sizes[0][flat] < 0]] = True
    alive = ~dead[text_of]
    flat, text_of = flat[alive], text_of[alive]
    totals = [np.bincount(text_of, x[flat], len(texts)).astype(np.int64) for x in sizes]
    digests = [
        hashlib.sha256("".join(map(known.text.__getitem__, x))[:-1].encode()).hexdigest() if x and not gone else ""
        for x, gone in zip(numbers, dead.tolist())
    ]
    n_links = sizes[3][flat]
    starts = (np.cumsum(sizes[3]) - sizes[3])[flat]
    places = np.arange(n_links.sum()) + np.repeat(starts - (np.cumsum(n_links) - n_links), n_links)
    links = np.frombuffer(known.links, np.int64)[places] if len(places) else np.empty(0, np.int64)
    return totals, digests, links, np.repeat(text_of, n_links)


def postings(docs: DataFrame, byte_level: str, pieces: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One pass over the texts, written once: a row for each document (container, position, the
    kept columns, sizes and digest; ``a`` is null) and a row for each id pair of each container
    (a, b, n_docs, pair_links, marks)."""
    read = lambda path: docs.sparkSession.sparkContext.broadcast(open(path, "rb").read())
    # vocabulary files: their size does not depend on the data
    files = read(byte_level), read(pieces)
    rows = docs.select(whole(text).alias("text"), *(keep if keep is not None else ["doc_id"]))
    carried = rows.schema.fields[1:]
    made = {"container": "long", "position": "int"} | MADE | POSTING
    schema = ", ".join(f"`kept_{i}` {f.dataType.simpleString()}" for i, f in enumerate(carried))
    schema = ", ".join([schema] * bool(carried) + [f"{name} {kind}" for name, kind in made.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokenizers(files[0].value, files[1].value)
        container = TaskContext.get().partitionId() << 32
        position = held = 0
        merged: tuple[list, list] = ([], [])
        kinds: dict[str, pa.DataType] = {"container": pa.int64(), "position": pa.int32()}
        kinds |= {c: pa.string() if k == "string" else pa.int64() for c, k in MADE.items()}
        kinds |= {"a": pa.int32(), "b": pa.int32(), "n_docs": pa.int64(), "pair_links": pa.int64(), "marks": pa.binary()}

        def batch_of(own: list[pa.Array], columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
            rest = [columns.get(c, pa.nulls(n, kind)) for c, kind in kinds.items()]
            return pa.RecordBatch.from_arrays([*own, *rest], names=[*[f"kept_{i}" for i in range(len(own))], *kinds])

        def closed(types: list[pa.DataType]) -> pa.RecordBatch:
            found = _posting_rows(*or_merged(*merged), len(known.bytes_b))
            found["pair_links"] = found.pop("n_links")
            n = len(found["a"])
            found["container"] = pa.array(np.full(n, container), pa.int64())
            return batch_of([pa.nulls(n, t) for t in types], found, n)

        types: list[pa.DataType] = []
        for batch, texts in _some_rows(batches):
            own = batch.columns[1:]
            types = [x.type for x in own]
            if position + len(texts) > CONTAINER or held > POSTINGS:
                yield closed(types)
                container, position, held = container + 1, 0, 0
                merged = ([], [])
            totals, digests, links, text_of = _encoded(known, texts)
            keys, words = planes_of(links, text_of + position)
            merged[0].append(keys)
            merged[1].append(words)
            held += len(keys)
            n = len(texts)
            columns = {c: pa.array(x, pa.int64()) for c, x in zip(MADE, totals)}
            columns["groups_sha256"] = pa.array(digests, pa.string())
            columns["container"] = pa.array(np.full(n, container), pa.int64())
            columns["position"] = pa.array(np.arange(position, position + n), pa.int32())
            yield batch_of(own, columns, n)
            position += n
        if position:
            yield closed(types)

    return materialize(rows.mapInArrow(run, schema), "pair-bitmaps")


def pair_counts(written: DataFrame) -> DataFrame:
    """(a, b, n_docs, n_links) of each id pair over all documents: popcounts of the containers, summed."""
    return (
        written.filter("a IS NOT NULL")
        .groupBy("a", "b")
        .agg(F.sum("n_docs").alias("n_docs"), F.sum("pair_links").alias("n_links"))
    )


def _returned(documents: pa.Table, hits: pa.Table) -> pa.Table:
    """The scores of a container's pairs, summed up for its documents through their planes."""
    n_best, total = np.zeros(CONTAINER, np.int64), np.zeros(CONTAINER, np.int64)
    count, best = hits["count"].to_numpy(), hits["best"].to_numpy().astype(np.int64)
    for start in range(0, hits.num_rows, 20_000):
        marks = hits["marks"].slice(start, 20_000).to_pylist()
        entries = np.frombuffer(b"".join(marks), ENTRY)
        row = np.repeat(np.arange(start, start + len(marks)), [len(x) // ENTRY.itemsize for x in marks])
        for at in range(0, len(entries), 100_000):
            some, own = entries[at : at + 100_000], row[at : at + 100_000]
            bits = np.unpackbits(np.ascontiguousarray(some["word"]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            entry, bit = np.nonzero(bits)
            place = some["at"][entry].astype(np.int64)
            doc, times = (place & 63) * 64 + bit, np.int64(1) << (place >> 6)
            np.add.at(total, doc, times * count[own[entry]])
            np.add.at(n_best, doc, times * best[own[entry]])
    position = documents["position"].to_numpy()
    kept = documents.drop_columns(["container", "position"])
    return kept.append_column("n_best", pa.array(n_best[position])).append_column("count_sum", pa.array(total[position]))


def align(docs: DataFrame, byte_level: str, pieces: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per document: the columns in ``keep`` (doc_id), n_a, n_b, n_groups, n_links, groups_sha256,
    n_best, count_sum.

    ``byte_level`` is the file of a byte-level tokenizer (A), which reads the text behind a blank,
    ``pieces`` that of a piece model (B), which adds the blank itself. An id pair's count is its
    number of links over all documents; ``n_best`` counts the links whose count is the highest of
    their B id, ties included, ``count_sum`` sums the counts of all links.

    Null and empty texts, and those whose tokens do not give back the text's bytes on one of the
    sides, have no tokens: zeros and an empty digest. Repeated rows and equal ids are counted
    each. An empty table gives no rows. Other columns are left out. A text of any length is
    encoded whole, by one task. The rows of a container (4,096 documents, or fewer with very many
    different pairs) meet in one task; a frequent pair has a row in each container.
    """
    names = keep if keep is not None else ["doc_id"]
    written = postings(docs, byte_level, pieces, text, names)
    pairs = pair_counts(written).select("a", "b", F.col("n_links").alias("count"))
    highest = pairs.groupBy("b").agg(F.max("count").alias("highest"))
    scored = pairs.join(highest, "b").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))
    hits = written.filter("a IS NOT NULL").select("container", "a", "b", "marks").join(scored, ["a", "b"])
    # both sides come from one table: new column identities keep them apart
    hits = hits.select("container", "marks", "count", "best").toDF("container", "marks", "count", "best")
    own = [f"kept_{i}" for i in range(len(names))]
    documents = written.filter("a IS NULL").select(*own, "container", "position", *MADE)
    kinds = {c: documents.schema[c].dataType.simpleString() for c in [*own, *MADE]} | {"n_best": "long", "count_sum": "long"}
    done = (
        documents.groupBy("container")
        .cogroup(hits.groupBy("container"))
        .applyInArrow(_returned, ", ".join(f"`{c}` {kind}" for c, kind in kinds.items()))
    )
    return done.select(*[F.col(c).alias(n) for c, n in zip(own, names)], *MADE, "n_best", "count_sum")
