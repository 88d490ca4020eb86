import functools
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from glossaleaf.llm import alignment
from glossaleaf.llm.queries import BYTE_LEVEL, PIECES, op11_alignment

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def known():
    with open(BYTE_LEVEL, "rb") as a, open(PIECES, "rb") as b:
        return alignment.Tokenizers(a.read(), b.read())


@functools.cache
def whole_texts():
    a = Tokenizer.from_file(BYTE_LEVEL)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=PIECES)


def tokenised(known, text):
    """Ids of the whole text on both sides, without units; None if the bytes are not the text's."""
    a, b = whole_texts()
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    for x, names in zip(ids, (known.bytes_a, known.bytes_b)):
        if b"".join(names[i] for i in x) != (" " + text).encode():
            return None
    return ids


def spans(ids, names):
    at, out = 0, []
    for i in ids:
        out.append((at, at + len(names[i])))
        at = out[-1][1]
    return out


def brute(known, texts):
    """By the definition: every pair of tokens whose byte ranges overlap, groups by common ends."""
    rows, counts = [], Counter()
    for text in texts:
        ids = tokenised(known, text) if text else None
        if ids is None:
            rows.append((0, 0, 0, [], ""))
            continue
        a, b = spans(ids[0], known.bytes_a), spans(ids[1], known.bytes_b)
        links, first = [], 0
        for i, (start, end) in zip(ids[0], a):
            while b[first][1] <= start:
                first += 1
            links += [(i, j) for j, (s, e) in zip(ids[1][first : first + 80], b[first : first + 80]) if s < end and e > start]
        cuts = {e for _, e in a} & {e for _, e in b}
        sides = []
        for own, ranges in zip(ids, (a, b)):
            sides.append([[]])
            for i, (_, end) in zip(own, ranges):
                sides[-1][-1].append(str(i))
                if end in cuts:
                    sides[-1].append([])
        groups = [",".join(x) + "|" + ",".join(y) for x, y in zip(*sides) if x or y]
        counts.update(links)
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    done = [
        (a, b, g, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest)
        for a, b, g, links, digest in rows
    ]
    return done, counts


ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a\tb c", "x\x1cy z", "a b c", "don't stop 'll", "<|endoftext|> <s> </s> <unk> <0x41>",
    "▁", "x▁y z", "fine word▁", "😀 é́ 汉字 über", "﻿a b", "a\x00b c", "1234 567.89 --- !!!", "a " * 40, "y" * 700,
    "tail \r\n", "mixed wide blank", "zwei  worte   drei",
]


def test_odd_texts_against_all_overlaps(spark, known):
    rng = random.Random(3)
    words = "the of tall naïve 42 don't <|endoftext|> übergroß x1y2 汉字 a b".split(" ")
    texts = ODD + [rng.choice(["", " ", "\n"]).join(["", *[rng.choice(words) + rng.choice([" ", "  ", "\n", ", "]) for _ in range(60)]]) for _ in range(25)]
    texts += texts[-3:]  # repeated rows count each
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align(df, BYTE_LEVEL, PIECES).collect()}
    want, _ = brute(known, texts)
    assert [got[i] for i in range(len(texts))] == want
    assert got[texts.index("x▁y z")] == (0, 0, 0, 0, 0, 0, "")


def test_pair_counts_and_small_containers(spark, known, monkeypatch):
    texts = [f"the tall house number {i % 7} of the {'x' * (i % 5)} over" for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    _, counts = brute(known, texts)
    docs_of = Counter(p for t in texts for p in brute(known, [t])[1])
    got = alignment.pair_counts(alignment.postings(df, BYTE_LEVEL, PIECES)).collect()
    assert {(r["a"], r["b"]): (r["n_docs"], r["n_links"]) for r in got} == {p: (docs_of[p], n) for p, n in counts.items()}


def test_planes_against_counting():
    rng = np.random.default_rng(1)
    pairs, docs = rng.integers(0, 9, 5000) ** 2, rng.integers(0, 4096, 5000) % 300
    halves = [alignment.planes_of(pairs[docs % 2 == k], docs[docs % 2 == k]) for k in (0, 1)]
    keys, words = alignment.or_merged(*map(list, zip(*halves)))
    rows = alignment._posting_rows(keys, words, 10)
    for i, (a, b) in enumerate(zip(rows["a"].to_pylist(), rows["b"].to_pylist())):
        own = docs[pairs == a * 10 + b]
        assert (rows["n_docs"][i].as_py(), rows["n_links"][i].as_py()) == (len(set(own.tolist())), len(own))


def test_a_full_store_is_cleared(known, monkeypatch):
    monkeypatch.setattr(alignment, "UNITS", 3)
    texts = ["one two three four five six", "seven eight nine ten", "one two"]
    for text in texts:
        sizes, _, links, _ = alignment._encoded(known, [text])
        a, b = tokenised(known, text)
        assert (sizes[0][0], sizes[1][0], sizes[3][0]) == (len(a), len(b), len(links))


def test_messy_table(spark, known, messy, messy_rows):
    got = alignment.align(messy, BYTE_LEVEL, PIECES)
    rows = [(r["doc_id"], *[r[c] for c in COLUMNS]) for r in got.collect()]
    want, _ = brute(known, [r[1] for r in messy_rows])
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(rows, key=key) == sorted([(r[0], *w) for r, w in zip(messy_rows, want)], key=key)


def test_empty_table(spark, empty):
    assert alignment.align(empty, BYTE_LEVEL, PIECES).count() == 0


def test_query_covers_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = op11_alignment(spark, sf_dir)
    assert got.columns[0] == "doc_id" and set(COLUMNS) <= set(got.columns)
    assert got.count() == docs.count()
    assert got.agg(F.sum("n_links")).first()[0] > 0
    assert public_tokenizers.path("byte_bpe_50k.json") == BYTE_LEVEL
