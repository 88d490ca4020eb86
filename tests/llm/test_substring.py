import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossaleaf.llm import fm_index, substring
from glossaleaf.llm.queries import op3_substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """{(doc_id, text): (words, removed, kept)} by looking every window up."""
    def place(row):
        return substring.NO_ID if row[0] is None else row[0]

    order = {}
    for row in rows:
        order.setdefault(place(row), set()).add(row[1] or "")
    seen, out = {}, {}
    for at in sorted(order):
        assert len(order[at]) == 1 or len({len(t) for t in order[at]}) > 1
        for text in order[at]:
            words = WORD.findall(text)
            gone = bytearray(len(words))
            for k in range(len(words) - 19):
                window = tuple(words[k : k + 20])
                if seen.setdefault(window, (at, k)) != (at, k):
                    gone[k : k + 20] = b"\1" * 20
            out[at, text] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g))
    return out


def check(df, rows):
    want = brute(rows)
    got = substring.dedup(df.withColumn("text", F.col("text"))).collect()
    assert len(got) == len(rows)
    expected = sorted((str(r[0]), *want[substring.NO_ID if r[0] is None else r[0], r[1] or ""]) for r in rows)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, bytes(r.kept).decode()) for r in got) == expected


def test_index_against_a_dictionary():
    rng = random.Random(2)
    for _ in range(60):
        base = [rng.randrange(3) for _ in range(60)]
        texts = []
        for _ in range(rng.randrange(1, 8)):
            k = rng.randrange(40)
            text = base[k : k + rng.randrange(20, 60)] if rng.random() < 0.7 else [rng.randrange(2) for _ in range(30)]
            texts.append(text + [9] * (20 - len(text)))
        index = fm_index.FmIndex(np.array(sum(texts, []), np.int64), np.array([len(t) for t in texts]))
        places, first, times, seen = [], [], [], {}
        for text, begin in zip(texts, index.begins):
            for i in range(len(text) - 19):
                seen.setdefault(tuple(text[i : i + 20]), []).append(begin + i)
        for found in seen.values():
            places += found
            first += [found[0]] * len(found)
            times += [len(found)] * len(found)
        got_times, got_first = index.search(np.array(places))
        assert got_times.tolist() == times and got_first.tolist() == first


def test_wavelet_matrix_ranks():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 37, 1000)
    matrix = fm_index.WaveletMatrix(symbols, 37)
    for end in (0, 1, 63, 64, 65, 640, 1000):
        asked = np.arange(37)
        assert matrix.rank(asked, np.full(37, end)).tolist() == np.bincount(symbols[:end], minlength=37).tolist()


def test_messy(spark, messy, messy_rows):
    rows = [r for r in messy_rows if r[1] != "another text under the same id"]
    check(messy.filter("text is null or text <> 'another text under the same id'"), rows)
    assert substring.dedup(messy).count() == len(messy_rows)


def test_empty(empty):
    assert substring.dedup(empty).count() == 0


@pytest.mark.parametrize("shard_words", [60, 1 << 19])
def test_random_documents(spark, monkeypatch, shard_words):
    rng = random.Random(shard_words)
    passage = [f"w{rng.randrange(50)}" for _ in range(70)]
    rows = []
    for i in range(150):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(60))]
        if rng.random() < 0.5:
            a = rng.randrange(40)
            words[len(words) // 2 :] = passage[a : a + rng.randrange(15, 70)]
        if rng.random() < 0.1:
            words += ["same"] * rng.randrange(60)
        if rng.random() < 0.1:
            words += ["p", "q", "r"] * rng.randrange(20)
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    monkeypatch.setattr(substring, "SHARD_WORDS", shard_words)
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)


def test_shards_are_cut_between_keys(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(substring, "SHARD_WORDS", 100)
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(key, at, 0, 0, 6, text.encode()) for key in range(5) for at in range(9)]
    names = ["deal", "at", "text_key", "start", "n", "words"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    batches = [
        pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 4]), kinds)], names=names)
        for i in range(0, len(rows), 4)
    ]
    found = pa.Table.from_batches(list(substring._searched(iter(batches)))).to_pylist()
    assert sorted(f["at"] for f in found) == sorted([at for at in range(1, 9)] * 5)
    assert all((f["start"], f["n"]) == (0, 6) for f in found)


@pytest.mark.parametrize("parts", [64, 0.01])
def test_a_frequent_line_between_different_neighbours(monkeypatch, parts):
    """Its key has more different stretches than a shard holds; none is searched in one piece."""
    import pyarrow as pa

    monkeypatch.setattr(substring, "SHARD_WORDS", 1500)
    monkeypatch.setattr(substring, "PARTS", parts, raising=False)
    sizes = []

    class Index(fm_index.FmIndex):
        def __init__(self, words, lengths):
            sizes.append(len(words))
            super().__init__(words, lengths)

    monkeypatch.setattr(substring, "FmIndex", Index)
    rng = random.Random(3)
    line = [f"line{k}" for k in range(8)]
    texts = []
    for i in range(400):
        own = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        if i % 9 == 5:  # one side as in an earlier document, so windows repeat but no whole stretch
            own[15:30] = texts[i - 5].split()[15:30]
        texts.append(" ".join(own[:30] + line + own[30:]))
    docs = list(enumerate(texts))

    def sorted_batches(batches):
        rows = [tuple(r.values()) for r in pa.Table.from_batches(list(batches)).to_pylist()]
        rows.sort(key=lambda r: (r[0], r[1] is not None, r[1] or 0, *r[2:4]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for i in range(0, len(rows), 50):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 50]), kinds)], names=substring._Rows.NAMES)

    def fetch(part):
        starts = [substring.stretches(t.encode().split())[1].tolist() for _, t in part]
        at = pa.array([i for i, _ in part])
        columns = [at, at, pa.array([0] * len(part)), pa.array([t.encode() for _, t in part]), pa.array(starts)]
        return substring._fetched(iter([pa.RecordBatch.from_arrays(columns, names=["doc_id", "at", "text_key", "text", "starts"])]))

    first = sorted_batches([b for k in range(3) for b in fetch(docs[k::3])])
    second = sorted_batches(substring._searched(first))
    gone = {}
    for r in pa.Table.from_batches(list(substring._searched(second, last=True))).to_pylist():
        gone.setdefault(r["at"], set()).update(range(r["start"], r["start"] + r["n"] + 19))
    want = {at: n for (at, _), (_, n, _) in brute(docs).items() if n}
    assert want and {at: len(x) for at, x in gone.items()} == want
    assert max(sizes) < 2 * 1500 + 50 * 40


def test_query(spark, sf_dir):
    import hashlib

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {at: v for (at, _), v in brute(rows).items()}
    got = op3_substring_dedup(spark, sf_dir).collect()
    assert len(got) == len(rows) and sum(r.n_removed for r in got) > 0
    for r in got:
        n, removed, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, removed, hashlib.sha256(kept.encode()).hexdigest())
