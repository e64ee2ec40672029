"""Queries with medians, quarters or ranks of whole tables against their twins, whatever the cuts of their ranges are at each evaluation."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranks
from tidemark.plans.catalog import ORACLE, QUERIES

duckdb = pytest.importorskip("duckdb")
NAMES = [
    "aud_threshold_sanity",
    "aud_trade_drilldown",
    "agg_corr_spearman",
]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_twin_for_any_cuts(spark, sf_dir, monkeypatch, name):
    """Cuts are drawn anew at each evaluation, as estimates are that arrive in another order; small groups are cut too."""
    some = F.udf(lambda _: sorted({(b - 128) ** 3 / 4 for b in os.urandom(60)} | {b / 0.4 for b in os.urandom(60)}), "array<double>")
    monkeypatch.setattr(ranks, "_cuts", lambda x: some(F.min(x)))
    monkeypatch.setattr(ranks, "SMALL", 0, raising=False)
    df = QUERIES[name](spark, sf_dir)
    got = sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{sf_dir}/events.parquet'")
    rel = c.sql(ORACLE[name])
    at = [rel.columns.index(k) for k in sorted(df.columns)]
    assert got == sorted(map(repr, (tuple(r[i] for i in at) for r in rel.fetchall())))
