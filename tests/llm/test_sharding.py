import zlib

import numpy as np
import pytest

from glossaleaf.llm import sharding
from glossaleaf.llm.queries import op8_sharding


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 16, 17, 64, 65, 1000, 4096, 4097])
def test_permutation_and_its_inverse(n):
    rows = np.arange(n)
    places = sharding.permuted(rows, n, seed=3)
    assert sorted(places.tolist()) == list(range(n))
    assert sharding.permuted(places, n, seed=3, back=True).tolist() == rows.tolist()


def test_seeds_differ():
    rows = np.arange(1000)
    assert (sharding.permuted(rows, 1000, 1) != sharding.permuted(rows, 1000, 2)).mean() > 0.9


def laid_out(rows, shards):
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) <= set(range(shards))
    sizes = [len(slots.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for found in slots.values():
        assert sorted(found) == list(range(len(found)))


def test_query(spark, sf_dir):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op8_sharding(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    laid_out(rows, 16)
    for r in rows:
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]))
        assert r.law == "rows" and r.grown_shard is None
    # shard and slot follow from the row number alone
    order = sorted(texts)
    at = {(r.shard, r.slot): r.doc_id for r in rows}
    for (shard, slot), doc_id in list(at.items())[:50]:
        assert order[sharding.place(shard, slot, len(order), 16, 0)] == doc_id


def test_messy_and_empty(messy, messy_rows, empty):
    rows = sharding.shard(messy, shards=5).collect()
    assert len(rows) == len(messy_rows)
    laid_out(rows, 5)
    again = sharding.shard(messy.repartition(7), shards=5).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert sharding.shard(empty).count() == 0
