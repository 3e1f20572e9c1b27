"""Every registered query of the converter against its SQL; those without SQL give rows."""

import pytest

from loomgate.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, same, name):
    df = QUERIES[name](spark, sf)
    if name in SQL:
        same(df, duck.sql(SQL[name]))
    else:
        assert df.count() > 0


def test_entry_module(spark, sf):
    import __spark_entry__ as entry

    assert set(SQL) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() == 5
