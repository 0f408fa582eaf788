"""Every query of the catalogue against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from quillgraph.plans import catalog


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return con


def rows(columns, found):
    clean = lambda v: None if v is None or v != v else (float(v) + 0.0 if isinstance(v, float) else v)
    return sorted(repr([clean(r[columns.index(c)]) for c in sorted(columns)]) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, data, db, name):
    df = catalog.queries()[name](spark, data)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = db.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert mine == rows(columns, cursor.fetchall())
