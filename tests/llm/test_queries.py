import pytest

from tests.conftest import DATA
from tests.oracle import duck_rows, spark_rows
from vellum.llm import queries as q


@pytest.mark.parametrize("name", sorted(q.REGISTRY.sql))
def test_same_as_sql(spark, name):
    assert spark_rows(q.REGISTRY.queries[name](spark, DATA)) == duck_rows(DATA, q.REGISTRY.sql[name])


@pytest.mark.parametrize("name", ["p1_by_action", "p5_found", "p7_mix", "p7_epoch_shares", "p7_entropy_shares", "p8_kept"])
def test_runs(spark, name):
    assert q.REGISTRY.queries[name](spark, DATA).count() > 0


def test_nothing_else_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(q.__file__).parent.parent
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "vellum.llm" not in p.read_text(), p
