"""Every query outside the training-data operators against DuckDB on the driver's smallest tables."""

import os

import pytest

from granary.plans import catalog

from .compare import FOLDER, oracle, same

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    return oracle()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    if name in catalog.ORACLE_SQL:
        same(df, con, catalog.ORACLE_SQL[name])
    else:
        assert df.count() > 0


def test_numbers_beyond_five_digits_are_written_as_the_sql_writes_them(spark, tmp_path):
    import duckdb

    con = duckdb.connect()
    con.sql(f"COPY (SELECT i AS o_orderkey, (i % 5)::VARCHAR AS o_orderpriority FROM range(100_003) t(i)) TO '{tmp_path}/orders.parquet'")
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    same(catalog.QUERIES["dense_recipe_ids"](spark, str(tmp_path)), con, catalog.ORACLE_SQL["dense_recipe_ids"])


def test_entry_and_registration(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["recipe_id", "category", "total", "matched", "match_rate"]
    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
