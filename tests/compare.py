"""Rows of a Spark query and of DuckDB's SQL, made comparable."""

import os

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def shown(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def same(df, con, sql):
    """Assert equal column names and rows, whatever their order."""
    columns = sorted(df.columns)
    expected = con.sql(sql)
    assert columns == sorted(expected.columns)
    order = [expected.columns.index(c) for c in columns]
    want = sorted((tuple(shown(r[i]) for i in order) for r in expected.fetchall()), key=str)
    got = sorted((tuple(shown(r[c]) for c in columns) for r in df.collect()), key=str)
    assert got == want
