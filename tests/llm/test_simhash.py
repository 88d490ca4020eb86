import random
import re

import numpy as np
import pytest
import xxhash

from glossaleaf.llm import simhash
from glossaleaf.llm.components import components
from glossaleaf.llm.queries import op9_simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())


def fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, bits=3):
    """Root of each value: the components of all pairs within ``bits``."""
    values = sorted(set(values))
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    known = np.array(values, np.uint64)
    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(known[i + 1 :] ^ known[i]) <= bits):
            a, b = find(v), find(values[i + 1 + int(j)])
            if a != b:
                parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in values}


def check(rows, docs):
    fps = [(i, fingerprint(t)) for i, t in docs]
    root = classes(f for _, f in fps)
    least = {}
    for i, f in fps:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    want = sorted((str(i), f"{f:016x}", str(least.get(root[f]))) for i, f in fps)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in rows) == want


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(op9_simhash(spark, sf_dir).collect(), docs)


def test_messy(messy, messy_rows):
    check(simhash.group(messy).collect(), [r[:2] for r in messy_rows])


def test_kept_rows(messy, messy_rows):
    kept = simhash.kept_rows(messy)
    assert kept.columns == messy.columns
    rows = kept.collect()
    root = classes(fingerprint(t) for _, t, *_ in messy_rows)
    assert sorted(root[fingerprint(r.text)] for r in rows) == sorted(set(root.values()))
    assert simhash.kept_rows(kept).count() == len(rows)


@pytest.mark.parametrize("bits", [1, 2, 3, 4, 5, 6])
@pytest.mark.parametrize("small", [2, 16])
def test_links_connect_all_that_is_near(spark, monkeypatch, bits, small):
    rng = random.Random(bits)
    values = {rng.getrandbits(64) for _ in range(150)} | {0, 2**64 - 1, 1 << 63}
    centre = rng.getrandbits(64)
    for _ in range(150):  # a dense cluster
        flipped = centre
        for b in rng.sample(range(64), rng.randrange(9)):
            flipped ^= 1 << b
        values.add(flipped)
    monkeypatch.setattr(simhash, "SMALL_GROUP", small)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    found = components(simhash.links(spark.createDataFrame(signed, "fp long"), bits)).collect()
    root = classes(values, bits)
    got = {r.node % (1 << 64): r.root for r in found}
    members = {}
    for v in values:
        members.setdefault(root[v], set()).add(v)
    for group in members.values():
        assert len({got.get(v, v) for v in group}) == 1
        assert len(group) == 1 or group <= set(got)
    assert len({got.get(v, v - (1 << 64) if v >> 63 else v) for v in values}) == len(members)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(501, 540)] + [(7, 7), (600, 601), (601, 600), (600, 601)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(101)} | {i: 500 for i in range(500, 540)} | {600: 600, 601: 600}


def test_empty(empty):
    assert simhash.group(empty).count() == 0 and simhash.kept_rows(empty).count() == 0


def test_long_text_in_blocks(monkeypatch):
    text = ("a b c d " * 3000 + "tail").encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 100)
    assert simhash.fingerprint(text) == whole
