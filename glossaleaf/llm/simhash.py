"""SimHash near-dedup with deletion-variant signatures.

A 64-bit fingerprint is cut into so few segments that of two fingerprints within the
allowed distance one segment differs by one bit at most (two segments for three bits). For
every segment and every bit of it the segment without that bit is a signature. Two
segments share one if they differ in that bit or not at all, so an equality join on signatures
finds every link; candidates are verified on the whole fingerprints.

Equal fingerprints are one row before signatures are made, so copies never meet as pairs.
Rows of one signature are read in key order. In a large group a search from node to node
compares each fingerprint with those not yet reached and yields a spanning forest of the
group's links, never its pairs; what is held is eight bytes for each different fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossaleaf.llm.common import id_key, packed, whole
from glossaleaf.llm.components import components
from glossaleaf.session import materialize

SHINGLE = 3
MAX_BITS = 3
# fixed value: the seed of the shingle hash
SEED = 42
# groups up to this size are compared row by shifted row
SMALL_GROUP = 16
# shingles whose bits are counted at once
BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingle hashes; 0 without words."""
    words = text.lower().split()  # of bytes: A-Z and the six ASCII white-space characters only
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, grams, repeat(SEED))), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[start : start + BLOCK], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, fingerprint as a long) of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x, shingle) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=["doc_id", "text_key", "fp"]
            )

    rows = docs.select("doc_id", F.xxhash64(whole(text)).alias("text_key"), whole(text).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text_key long, fp long")


def _segments(max_bits: int) -> list[tuple[int, int]]:
    """(shift, width) of the segments; a signature with its number must fit 64 bits."""
    n = max(2, (max_bits + 2) // 2)
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _signatures(distinct: DataFrame, max_bits: int) -> DataFrame:
    """(key, fp): the number of the left-out bit above the segment without it."""
    keys = []
    for shift, width in _segments(max_bits):
        segment = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
        for bit in range(width):
            left = segment.bitwiseAND(F.lit(((1 << width) - 1) ^ (1 << bit)))
            keys.append(left.bitwiseOR(F.lit((shift + bit) << 32)))
    return distinct.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _near(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= max_bits


def _forest(fps: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect whatever the links of one large group connect."""
    rest = fps
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            node = frontier.pop()
            near = _near(rest, node, max_bits)
            if near.any():
                found = rest[near]
                rest = rest[~near]
                frontier.extend(found)
                yield np.full(len(found), node), found


def _links(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among rows in key order, groups whole."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    for start, size in zip(starts[sizes > SMALL_GROUP], sizes[sizes > SMALL_GROUP]):
        yield from _forest(fps[start : start + size], max_bits)
    small = np.repeat((sizes > 1) & (sizes <= SMALL_GROUP), sizes)
    keys, fps = keys[small], fps[small]
    for shift in range(1, SMALL_GROUP):
        ok = keys[shift:] == keys[:-shift]
        if not ok.any():
            break
        a, b = fps[:-shift][ok], fps[shift:][ok]
        near = _near(a, b, max_bits)
        yield a[near], b[near]


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (u, v) between different fingerprints that connect all that lie within ``max_bits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)

        def out(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            found = list(_links(keys, fps, max_bits)) if len(keys) > 1 else []
            if found:
                pairs = [pa.array(np.concatenate([x[i] for x in found]).view(np.int64)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(pairs, names=["u", "v"])

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
            yield from out(keys[:last], fps[:last])
            keys, fps = keys[last:], fps[last:]
        yield from out(keys, fps)

    signed = _signatures(distinct, max_bits)
    return signed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long").distinct()


def _members(docs: DataFrame, text: str, shingle: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, fp) of all rows, and (fp, root) of all fingerprints."""
    rows = materialize(fingerprints(docs, text, shingle), "fingerprints")
    distinct = rows.select("fp").distinct()
    roots = components(links(distinct, max_bits)).withColumnRenamed("node", "fp")
    joined = distinct.join(roots, "fp", "left")
    return rows, joined.select("fp", F.coalesce("root", "fp").alias("root"))


def group(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Texts are lower-cased in A-Z and cut into words; fewer words than a shingle are one
    shingle; null and empty texts have fingerprint 0 and are linked like any other. Repeated
    rows are returned each. A component of null ids alone has a null id. Other columns of
    ``docs`` are left out. An empty table gives no rows; very long texts count all their shingles.
    """
    rows, roots = _members(docs, text, shingle, max_bits)
    firsts = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")).join(roots, "fp")
    named = firsts.groupBy("root").agg(F.min("first_id").alias("component_id"))
    members = roots.join(named, "root").select("fp", "component_id")
    return rows.join(members, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def kept_rows(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of ``docs`` for each component, with all its columns: the smallest doc_id, null
    last; of rows with one doc_id the one whose text's hash is smallest."""
    rows, roots = _members(docs, text, shingle, max_bits)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    firsts = rows.groupBy("fp").agg(F.min(order).alias("first")).join(roots, "fp")
    best = firsts.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.text_key")
    best = best.select("text_key", id_key().alias("id_key"))
    all_rows = docs.select(packed(docs).alias("row"), F.xxhash64(whole(text)).alias("text_key"), id_key().alias("id_key"))
    # join and window have the same key, so the rows are dealt out once
    again = Window.partitionBy("text_key", "id_key").orderBy(F.lit(1))
    stay = all_rows.join(best, ["text_key", "id_key"], "left_semi").withColumn("nth", F.row_number().over(again))
    return stay.filter("nth = 1").select("row.*")
