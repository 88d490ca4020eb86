import pytest

import __spark_entry__ as entry
import check

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return check.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    if name in SQL:
        assert check.compare(con, SQL[name], df).startswith("ok")
    else:
        assert df.count() > 0


def test_flagship(spark):
    assert entry.entry(spark).filter("translate_status = 'ok'").count() > 0


def test_every_sql_has_its_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_no_plan_pairs_everything(spark, sf_dir, name):
    plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
