import pytest

from pointsmith.plans import registry
from tests.oracle import connection, same


@pytest.fixture(scope="module")
def con(data):
    return connection(data)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_oracle(spark, data, con, name):
    same(registry.queries()[name](spark, data), con, registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, data, name):
    assert registry.queries()[name](spark, data).count() > 0


def test_entry(spark, data):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert {"id", "score"} == set(e.entry(spark).columns)
