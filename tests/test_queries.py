"""Every registered query against its SQL, and the others by their shape."""

import pytest

from eventscope.plans import catalog
from tests import oracle


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    oracle.same(catalog.QUERIES[name](spark, sf_dir), con, catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    assert df.columns
    df.collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.SQL) <= set(entry.oracle_sql()) and set(catalog.QUERIES) <= set(entry.queries())
