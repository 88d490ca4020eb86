"""The pipeline against plain Python, stage by stage on what the stage before has kept."""

import hashlib
import re
from collections import Counter

import numpy as np
import tiktoken

import corpus_pipeline
from glossaleaf.llm import bpe, quality
from glossaleaf.llm.queries import PATTERN, RANKS

from .conftest import SCHEMA
from .test_exact_dedup import normal
from .test_mixing import is_part
from .test_quality import counts, scores
from .test_simhash import classes, fingerprint

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    trusted = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").collect()}
    llr = scores(list(rows.items()), trusted)
    good = {i: t for i, t in rows.items() if not counts(t)[-1] and llr[t] >= quality.THRESHOLD}
    last = {normal(t): i for i, t in sorted(good.items())}
    single = {i: good[i] for i in last.values()}
    root = classes(fingerprint(t) for t in single.values())
    first = {}
    for i, t in sorted(single.items()):
        first.setdefault(root[fingerprint(t)], i)
    wanted = [good, single, {i: single[i] for i in first.values()}]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        if n < 4:
            assert docs.columns == columns
        if n < 3:
            got = docs.collect()
            assert len(got) == len(wanted[n]) and {r.doc_id: r.text for r in got} == wanted[n], name
        if n == 3:
            mixed = docs.collect()
            sizes = {i: len(WORD.findall(t)) for i, t in wanted[2].items()}
            taken = Counter()
            for r in mixed:
                taken[r.doc_id] += len(WORD.findall(r.text))
                assert is_part(WORD.findall(r.text), WORD.findall(wanted[2][r.doc_id])) and r.n_chars == len(r.text)
            assert all(taken[i] <= 2 * sizes[i] for i in taken)
            assert abs(sum(taken.values()) / sum(sizes.values()) - 1.5) < 0.02
    own = bpe.Vocabulary(bpe.read_ranks(RANKS), PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    want = sorted((r.doc_id, r.source, np.array(theirs.encode_ordinary(r.text), "<u4").tobytes()) for r in mixed)
    got = sorted((r.doc_id, r.source, bytes(r.ids)) for r in docs.collect())
    assert got == want
    assert all(r.ids_sha256 == hashlib.sha256(bytes(r.ids)).hexdigest() for r in docs.collect())


def test_run_is_the_stages_and_reruns_agree(spark, sf_dir):
    once = sorted(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256").collect())
    again = sorted(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256").collect())
    assert once == again and once


def test_messy_and_empty(spark, messy, empty, sf_dir, tmp_path):
    for name, docs in (("messy", messy), ("empty", empty)):
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, sf_dir).write.parquet(str(tmp_path / f"{name}{n}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{n}"))
        assert (docs.count() == 0) == (name == "empty") and SCHEMA
