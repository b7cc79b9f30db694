import math
import os

import duckdb
import pytest
from tablewright.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    return value


def test_every_sql_has_its_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and len(catalog.queries()) > 45


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_against_sql(spark, sf_dir, duck, name):
    df = catalog.queries()[name](spark, sf_dir)
    found = duck.sql(catalog.oracle_sql()[name])
    order = sorted(df.columns)
    assert sorted(found.columns) == order
    places = [found.columns.index(c) for c in order]
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[i]) for i in places) for r in found.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).collect()
