"""Every registered query of the core against its SQL."""

import pytest

from quillspark.plans import catalog

from .oracle import assert_same, connect

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, small, con, name):
    found = catalog.queries()[name](spark, small).toPandas()
    if name in SQL:
        assert_same(found, con.execute(SQL[name]).df())
    else:
        assert len(found.columns) > 0


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["query_id", "doc_id", "rank", "score"]
    assert set(e.oracle_sql()) <= set(e.queries())
