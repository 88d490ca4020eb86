from collections import Counter

from glossaleaf.llm import exact_dedup
from glossaleaf.llm.common import ascii_lower

from .conftest import python_nodes

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())


def normal(text):
    return (text or "").translate(LOWER)


def test_messy(messy, messy_rows):
    rows = exact_dedup.mark(messy).collect()
    sizes = Counter(normal(t) for _, t, *_ in messy_rows)
    best = {}
    for i, t, *_ in messy_rows:
        best.setdefault(normal(t), []).append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in best.items()}
    want = sorted((str(i), str(best[normal(t)]), sizes[normal(t)]) for i, t, *_ in messy_rows)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in rows) == want
    # one row of each group stays, also where rows repeat doc_id and text
    kept = Counter(r.text_sha256 for r in rows if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(sizes)


def test_kept_rows_keep_their_columns(messy):
    kept = exact_dedup.kept_rows(messy)
    assert kept.columns == messy.columns
    texts = [normal(r.text) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == messy.select(ascii_lower(messy["text"])).na.fill("").distinct().count()


def test_large_group_in_many_tasks(spark):
    rows = [(i, "Copy" if i % 3 else f"text {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    assert exact_dedup.mark(df, salts=4).filter("kept").count() == 1001
    assert exact_dedup.mark(df, salts=4).filter("text_sha256 = sha2('copy', 256)").select("keep_id", "group_size").distinct().collect() == [
        (2999, 2000)
    ]


def test_empty_and_native(empty, messy):
    assert exact_dedup.mark(empty).count() == 0
    assert python_nodes(exact_dedup.mark(messy)) == [] and python_nodes(exact_dedup.kept_rows(messy)) == []
