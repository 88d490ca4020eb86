import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = (
    "size kept fp row digest words weights shard slot nth score content salt length place takes at spans starts "
    "text_key target first_word quota seats key label trusted_id n_words best_id root node u v"
).split()


def sentence(rng, n):
    return " ".join(rng.choice("the of red tall house Runs over ähnlich stille word".split()) + str(rng.randrange(9)) for _ in range(n))


@pytest.fixture(scope="session")
def messy_rows():
    """Nulls in every column, empty and blank texts, a very long one, ties and repeated rows."""
    rng = random.Random(5)
    long_text = sentence(rng, 30_000)
    shared = sentence(rng, 45)
    texts = [None, "", " \n\t ", "one", "ONE", "Äone", "äone", long_text, long_text.upper(), "#*$ | x\n\ny\ny\n  \ny"]
    texts += [sentence(rng, rng.randrange(1, 120)) for _ in range(30)]
    texts += [sentence(rng, 30) + "\n" + shared + " " + sentence(rng, 10) for _ in range(6)]
    texts += ["a b c " * 60, "x " * 500, "y" * 3000, "zwei worte   drei\x1cvier"]
    rows = [(i, t, "en", f"src{i % 3}" if i % 7 else None, None) for i, t in enumerate(texts)]
    rows += [rows[12], rows[12], (12, "another text under the same id", None, "src1", 5), (None, "one", None, None, None)]
    rows += [(None, None, None, None, None), (-5, sentence(rng, 60), "fr", "", 1)]
    return rows


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    """The same as a table, with extra columns under names that the operators use inside."""
    df = spark.createDataFrame(messy_rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def python_nodes(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin") if x in plan]
