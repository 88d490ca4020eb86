"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's parts are a linked list. For each merge rank a bucket holds the positions
whose pair has that rank; a bitmap marks the ranks in use, and a summary has one bit per word
of 256 ranks. Find-first-set on the summary and then on its word gives the next rank. A
position whose pair has changed since is stale and skipped. The work for a pre-token of n
bytes is O(n log n), so that very long ones do no harm.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaleaf.llm.common import whole

# a worker keeps two generations of so many encoded pre-tokens, none longer than this
CACHE_PIECES = 400_000
CACHE_CHARS = 40
# rows in Python at once
ROWS = 500

BIT = [1 << k for k in range(256)]


class Vocabulary:
    """Ranks of byte strings, both ways, with the pattern that cuts a text into pre-tokens."""

    def __init__(self, rank_file: bytes, pattern: str):
        pairs = (line.split() for line in rank_file.splitlines() if line.strip())
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.size = max(self.ranks.values(), default=-1) + 1
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.buckets: dict[int, list[int]] = {}
        # 256 ranks each; the last is the summary of the others
        self.words = [0] * ((self.size + 255 >> 8) + 1)
        self.two = [self.ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        self.cut = regex.compile(pattern).findall
        self.known = _Pieces(self)

    def _add(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heappush(bucket, position)
        else:
            self.buckets[rank] = [position]
            self.words[rank >> 8] |= BIT[rank & 255]
            self.words[-1] |= 1 << (rank >> 8)

    def merged(self, piece: bytes) -> list[int]:
        """The ids of one pre-token: of all pairs the lowest rank, leftmost, is merged next."""
        ranks, buckets, words, add, n = self.ranks, self.buckets, self.words, self._add, len(piece)
        if piece in ranks:
            return [ranks[piece]]
        known = ranks.get
        two = self.two
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        pair = [two[a << 8 | b] for a, b in zip(piece, piece[1:])]
        pair.append(-1)
        for i, rank in enumerate(pair):
            if rank >= 0:
                add(rank, i)
        while summary := words[-1]:
            word = (summary & -summary).bit_length() - 1
            bits = words[word]
            low = bits & -bits
            rank = word << 8 | low.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                words[word] = bits = bits ^ low
                if not bits:
                    words[-1] = summary ^ 1 << word
            if pair[i] != rank:
                continue  # stale: its pair has changed since
            gone = after[i]
            end = after[i] = after[gone]
            pair[gone] = -1
            if end < n:
                before[end] = i
                rank = pair[i] = known(piece[i : after[end]], -1)
                if rank >= 0:
                    add(rank, i)
            else:
                pair[i] = -1
            i = before[i]
            if i >= 0:
                rank = pair[i] = known(piece[i:end], -1)
                if rank >= 0:
                    add(rank, i)
        ids, i = [], 0
        while i < n:
            end = after[i]
            ids.append(ranks[piece[i:end]])
            i = end
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.known.__getitem__, self.cut(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Pieces(dict):
    """Encoded pre-tokens of this worker. When it is full it becomes the elder generation, from
    which pieces that come again are taken over."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.elder: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.elder.get(piece)
        if ids is None:
            merged = self.vocabulary.merged(piece.encode())
            ids = struct.pack(f"<{len(merged)}I", *merged)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.elder = dict(self)
                self.clear()
            self[piece] = ids
        return ids


def _some_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


@functools.lru_cache(maxsize=2)
def vocabulary(rank_file: bytes, pattern: str) -> Vocabulary:
    return Vocabulary(rank_file, pattern)


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _shipped(df: DataFrame, path: str):
    """The rank file for all tasks; its size is that of a vocabulary, not of the data."""
    return df.sparkSession.sparkContext.broadcast(read_ranks(path))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every row with its token ids: doc_id, the columns in ``keep``, ids (binary, little-endian
    unsigned 32 bits), n_tokens, ids_sha256, decoded (binary) and decoded_sha256.

    Each match of ``pattern`` is encoded separately by the ranks of the file at ``path``,
    without special tokens. Null and empty texts have no token. Repeated rows are
    encoded each; columns of ``docs`` not named are left out. An empty table gives no rows; a
    very long text, or pre-token, is encoded whole. No shuffle.
    """
    ranks = _shipped(docs, path)
    rows = docs.select(whole(text).alias("text"), "doc_id", *(keep or []))
    carried = rows.schema.fields[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(ranks.value, pattern)
        for batch in _some_rows(batches):
            ids = [known.encode(x) for x in batch.column(0).to_pylist()]
            decoded = [known.decode(x) for x in ids]
            columns = {f.name: batch.column(i + 1) for i, f in enumerate(carried)}
            columns["ids"] = pa.array(ids, pa.binary())
            columns["n_tokens"] = pa.array([len(x) >> 2 for x in ids], pa.int64())
            columns["ids_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string())
            columns["decoded"] = pa.array(decoded, pa.binary())
            columns["decoded_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in carried)
    return rows.mapInArrow(
        run, f"{kinds}ids binary, n_tokens long, ids_sha256 string, decoded binary, decoded_sha256 string"
    )


def lengths(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """n_tokens of every row, in a column of that name and nothing else."""
    ranks = _shipped(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(ranks.value, pattern)
        for batch in _some_rows(batches):
            counts = [len(known.encode(x)) >> 2 for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64())], names=["n_tokens"])

    return docs.select(whole(text).alias("text")).mapInArrow(run, "n_tokens long")
