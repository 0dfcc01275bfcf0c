import pytest

from palaver.plans import registry
from tests.oracle import connect, same

FOLDER = "/root/testdata/sf0.001"
CON = connect(FOLDER)


def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(registry.oracle_sql()) and len(registry.queries()) >= 77


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_against_duckdb(spark, name):
    same(spark, FOLDER, registry.queries()[name], registry.oracle_sql()[name], CON)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
