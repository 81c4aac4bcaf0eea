"""Every query of the engine against DuckDB on a driver table; those without an oracle give rows."""

import pytest

from lumenar.plans import catalog
from tests.support import rows_of_duckdb, rows_of_spark


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    if name in catalog.ORACLES:
        assert rows_of_spark(got) == rows_of_duckdb(sf_dir, catalog.ORACLES[name])
    else:
        assert got.count() > 0


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["c_name", "o_orderkey"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
