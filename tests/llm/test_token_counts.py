import tiktoken

from glossaleaf.llm import bpe, token_counts
from glossaleaf.llm.queries import PATTERN, RANKS, op7_token_counts


def check(sums, lengths):
    rows = sums.collect()
    assert sorted(r.length for r in rows) == sorted(set(lengths))
    for r in rows:
        assert r.n_docs == lengths.count(r.length)
        assert r.docs_from == sum(x >= r.length for x in lengths)
        assert r.tokens_from == sum(x for x in lengths if x >= r.length)
        assert r.total_tokens == sum(lengths)
        assert r.truncated_total == sum(min(x, r.length) for x in lengths)
        assert r.docs_upto == sum(x <= r.length for x in lengths)
        assert abs(r.quantile_upto - r.docs_upto / len(lengths)) < 1e-12


def test_query(spark, sf_dir):
    own = bpe.Vocabulary(bpe.read_ranks(RANKS), PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(op7_token_counts(spark, sf_dir), [len(theirs.encode_ordinary(t)) for t in texts])


def test_limits_and_quantiles(spark):
    lengths = [0, 0, 3, 3, 3, 7, 1023, 1024, 1025, 5000, 70_000]
    df = spark.createDataFrame([(x,) for x in lengths] + [(None,)], "n_tokens long")
    sums = token_counts.suffix_sums(token_counts.histogram(df))
    lengths.append(0)
    check(sums, lengths)
    limits = [0, 1, 3, 5, 1024, 4096, 70_000, 100_000]
    for r in token_counts.at_limits(sums, limits).collect():
        assert r.longer_docs == sum(x > r.context_limit for x in lengths)
        assert r.truncated_total == sum(min(x, r.context_limit) for x in lengths)
    asked = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    ordered = sorted(lengths)
    for r in token_counts.quantiles(sums, asked).collect():
        assert r.length == next(x for x in ordered if sum(y <= x for y in ordered) / len(ordered) >= r.quantile)


def test_messy_and_empty(spark, messy, messy_rows, empty):
    sums = token_counts.suffix_sums(token_counts.histogram(bpe.lengths(messy, RANKS, PATTERN)))
    assert sum(r.n_docs for r in sums.collect()) == len(messy_rows)
    nothing = token_counts.suffix_sums(token_counts.histogram(bpe.lengths(empty, RANKS, PATTERN)))
    assert nothing.count() == 0
    assert [tuple(r) for r in token_counts.at_limits(nothing, [5]).collect()] == [(5, 0, 0)]
    assert [r.length for r in token_counts.quantiles(nothing, [0.5]).collect()] == [None]
