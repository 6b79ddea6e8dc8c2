"""Every registered query that has SQL, against DuckDB on the same tables; the others run and give rows."""

import pytest

from corpusloom.plans import registry

from . import compare

SQL = registry.oracle_sql()
OTHERS = [n for n in registry.queries() if n not in SQL]


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    assert compare.same(spark, registry.queries()[name], SQL[name]) > 0


@pytest.mark.parametrize("name", sorted(OTHERS))
def test_runs(spark, name):
    assert registry.queries()[name](spark, compare.SF).limit(1).count() == 1


def test_entry():
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
