"""Registered queries against their DuckDB twins on the smallest tables, and the driver contract."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _names():
    from tidemark.plans.catalog import ORACLE

    every = sorted(ORACLE)
    return every if os.environ.get("TIDEMARK_ALL_QUERIES") else every[::4]


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", _names())
def test_query_equals_its_twin(spark, sf_dir, duck, name):
    from tidemark.plans.catalog import ORACLE, QUERIES

    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    rel = duck.sql(ORACLE[name])
    names = list(rel.columns)
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in rel.fetchall()), key=repr)
    assert got == want


def test_contract(spark):
    import __spark_entry__ as e

    queries, oracle = e.queries(), e.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 300
    df = e.entry(spark)
    assert len(df.columns) > 10 and df.count() > 0
