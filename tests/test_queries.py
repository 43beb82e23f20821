"""Each registered query against its SQL over the smallest tables; without SQL it must give rows."""

import pytest
from conftest import SMALL
from oracle import assert_same

from driftwatch.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", QUERIES)
def test_query(name, spark, duck):
    df = QUERIES[name](spark, SMALL)
    if name in SQL:
        assert_same(df, duck.sql(SQL[name]))
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
