"""Every query with SQL against DuckDB, and every other one by its rows."""

import math

import duckdb
import pytest

from twinsieve import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def canon(rows):
    out = []
    for r in rows:
        out.append(tuple(0.0 if isinstance(x, float) and x == 0 else "nan" if isinstance(x, float) and math.isnan(x) else x for x in r))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_sql(spark, sf_dir, db, name):
    df = catalogue.queries()[name](spark, sf_dir)
    want = db.sql(catalogue.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    got = canon(tuple(r) for r in df.select(*names).collect())
    rows = canon(want.select(*names).fetchall())
    assert len(got) == len(rows)
    for a, b in zip(got, rows, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and abs(x - y) < 2e-6 * max(1, abs(x))), (name, a, b)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_rows(spark, sf_dir, name):
    assert catalogue.queries()[name](spark, sf_dir).count() > 0
