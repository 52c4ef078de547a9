import pytest
from oracle import compare

from equirank.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, sf, name):
    compare(spark, sf, name, catalog.QUERIES[name], catalog.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).collect() is not None


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["qid", "n", "n_priv", "n_under", "priv_rate", "under_rate", "spd", "under_priv_ratio"]
