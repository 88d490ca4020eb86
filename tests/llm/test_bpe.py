import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from glossaleaf.llm import bpe
from glossaleaf.llm.queries import PATTERN, RANKS, op1_bpe


@pytest.fixture(scope="module")
def own():
    return bpe.Vocabulary(bpe.read_ranks(RANKS), PATTERN)


@pytest.fixture(scope="module")
def theirs(own):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def ids(own, text):
    return np.frombuffer(own.encode(text), "<u4").tolist()


def test_every_code_point(own, theirs):
    for start in range(0, 0x110000, 97):
        chars = "".join(chr(c) for c in range(start, min(start + 97, 0x110000)) if not 0xD800 <= c < 0xE000)
        text = f"a{chars} {chars[:3]}1"
        assert ids(own, text) == theirs.encode_ordinary(text)


def test_random_texts_and_long_words(own, theirs):
    rng = random.Random(3)
    for alphabet in ("ab", "the ", "aé ß\n'1s", "中文x"):
        for n in (0, 1, 7, 300, 5000):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            assert ids(own, text) == theirs.encode_ordinary(text)
            assert own.decode(own.encode(text)) == text.encode()


def test_long_word_is_not_quadratic(own):
    word = "".join(random.Random(1).choice("abcdehst") for _ in range(300_000))
    assert own.decode(own.encode(word)) == word.encode()


def test_lower_rank_that_appears_later_goes_first():
    # merging "bc" makes "abc" of rank 1, below that of the remaining pairs
    tokens = [b"a", b"b", b"c", b"d"]
    extra = {b"abc": 4, b"bc": 5, b"cd": 6, b"abcd": 7}
    ranks = {t: i for i, t in enumerate(tokens)} | extra
    import base64

    file = b"\n".join(base64.b64encode(t) + b" " + str(r).encode() for t, r in ranks.items())
    small = bpe.Vocabulary(file, r".+")
    big = tiktoken.Encoding("small", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(9)
    for _ in range(300):
        text = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 25)))
        assert ids(small, text) == big.encode_ordinary(text)


def test_query(spark, sf_dir, theirs):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op1_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = theirs.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_messy(messy, messy_rows, theirs):
    rows = bpe.encode(messy, RANKS, PATTERN, keep=["lang"]).collect()
    got = sorted((str(r.doc_id), str(r.lang), r.n_tokens, bytes(r.decoded)) for r in rows)
    want = [(str(i), str(lang), len(theirs.encode_ordinary(t or "")), (t or "").encode()) for i, t, lang, *_ in messy_rows]
    assert got == sorted(want)


def test_empty_table(empty):
    assert bpe.encode(empty, RANKS, PATTERN).count() == 0
