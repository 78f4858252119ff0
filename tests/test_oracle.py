import pytest

from tests.conftest import DATA
from tests.oracle import duck_rows, spark_rows
from vellum import plans

REGISTRY = plans.load()


@pytest.mark.parametrize("name", sorted(REGISTRY.sql))
def test_same_as_sql(spark, name):
    assert spark_rows(REGISTRY.queries[name](spark, DATA)) == duck_rows(DATA, REGISTRY.sql[name])


@pytest.mark.parametrize("name", sorted(set(REGISTRY.queries) - set(REGISTRY.sql)))
def test_runs(spark, name):
    df = REGISTRY.queries[name](spark, DATA)
    rows = df.collect()
    assert rows and df.columns and all(len(r) == len(df.columns) for r in rows)
    assert not any(all(r[c] is None for r in rows) for c in df.columns)
