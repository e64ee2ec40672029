"""Queries of the policy frame against their twins where a market's bars are numbered far beyond 271,176, from which on a product with one passes 32 bits."""

import pytest
from pyspark.sql import functions as F

from tidemark.plans.catalog import ORACLE, QUERIES
from tidemark.sources import bars

duckdb = pytest.importorskip("duckdb")
FAR = 300_000
NAMES = [
    "agg_argmax_accuracy",
    "agg_class_calibration",
    "agg_inverted_rate",
    "agg_model_comparison",
    "agg_model_target",
    "agg_sharpe_like",
    "agg_stability_scopes",
    "aud_block_counts",
    "aud_cost_components",
    "aud_blocked_opportunity",
    "aud_cost_counterfactuals",
    "aud_decisions",
    "aud_direction_calibration",
    "aud_long_failure",
]


@pytest.mark.parametrize("name", NAMES)
def test_query_of_far_bars_equals_its_twin(spark, sf_dir, monkeypatch, name):
    # on the smallest tables no scenario has trades enough for a decision
    sf_dir = sf_dir if name != "aud_decisions" else "/root/testdata/sf0.01"
    near = bars.tick_bars
    monkeypatch.setattr(bars, "tick_bars", lambda *a, **b: near(*a, **b).withColumn("bar", F.col("bar") + FAR))
    df = QUERIES[name](spark, sf_dir)
    got = sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{sf_dir}/events.parquet'")
    # the same numbers for DuckDB, in 64 bits: the twin as registered passes 32 bits too
    assert ORACLE[name].count("cast(n // 3 as int) as bar") == 1
    rel = c.sql(ORACLE[name].replace("cast(n // 3 as int) as bar", f"cast(n // 3 + {FAR} as bigint) as bar"))
    at = [rel.columns.index(k) for k in sorted(df.columns)]
    assert got and got == sorted(map(repr, (tuple(r[i] for i in at) for r in rel.fetchall())))
