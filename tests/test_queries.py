"""Every query of the catalog against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import datetime
import math

import duckdb
import pytest

from larkspur import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: [(x is not None, str(x)) for x in r])


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    cur = db.execute(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(d[0] for d in cur.description)
    assert rows(df.columns, df.collect()) == rows([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n not in catalog.oracle_sql()])
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
