"""Every query that has SQL gives the same rows as DuckDB on the small tables."""

import pytest

from symtide.plans import all_oracles, all_queries
from tests.compare import differences


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_against_sql(spark, data, con, name):
    assert differences(all_queries()[name](spark, data), con, all_oracles()[name]) is None


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_oracles())))
def test_runs(spark, data, name):
    df = all_queries()[name](spark, data)
    assert len(set(df.columns)) == len(df.columns)
    df.write.format("noop").mode("overwrite").save()


def test_entry_contract(spark, data):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1
