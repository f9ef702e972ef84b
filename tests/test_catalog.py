"""Every query of the library against its SQL, on the smallest tables."""

import compare
import pytest

from parcelforge import catalog


#: Rows of the queries without SQL on the smallest tables.
ROWS = {"fl9_detail_with_reasons": 1500}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, small, con, name):
    df = catalog.QUERIES[name](spark, small)
    if name in catalog.ORACLE:
        assert compare.differences(df, catalog.ORACLE[name], con) == ""
    else:
        assert df.count() == ROWS[name]


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
