"""Whole-table ranks and quantiles against numpy, with ties, heavy values, nulls and empty tables."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranks


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    return [(i, "A" if rng.random() < 0.7 else "B", rng.choice([None, 3.0, 3.0, 3.0, 3.0, rng.gauss(0, 9), float(rng.randint(-4, 9))]), rng.choice([None, 1.0, rng.random()])) for i in range(900)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, g string, x double, z double").repartition(5)


def test_rows_are_numbered_by_value_then_tie(df, rows):
    got = {r.id: r._rn for r in ranks.ordered(df.where("x is not null"), "x", "id").collect()}
    want = sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0]))
    assert got == {r[0]: i for i, r in enumerate(want, 1)}


def test_a_value_that_holds_half_of_all_rows_is_split_by_its_ties(df):
    known = df.where("x is not null")
    sizes = [r["count"] for r in ranks.ranged(known, "x", "id").groupBy("_range").count().collect()]
    assert known.where("x = 3").count() > 0.4 * sum(sizes) and max(sizes) < 0.05 * sum(sizes)


def test_deciles_and_buckets_of_the_whole_table(df, rows):
    want = sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0]))
    label = {r[0]: f"d{min(10, max(1, -(-(i * 10) // len(want)))):02d}" for i, r in enumerate(want, 1)}
    assert {r.id: r.d for r in ranks.with_decile(df, "x", "d", "id").collect()} == {r[0]: label.get(r[0], "missing") for r in rows}
    edges = sorted(set(np.quantile([r[2] for r in want], [0.25, 0.5, 0.75]).tolist()))
    assert {r.id: r.b for r in ranks.with_qcut(df, "x", 4, "b").collect()} == {r[0]: None if r[2] is None else 1 + sum(r[2] > e for e in edges) for r in rows}


def test_quantiles_equal_percentile_for_groups_and_columns(df):
    probs = [0.0, 0.05, 0.5, 0.731, 1.0]
    got = {(r.g, r.column): r.q for r in ranks.quantiles(df, ["x", "z"], probs, ["g"]).collect()}
    for r in df.groupBy("g").agg(*[F.percentile(c, F.array(*[F.lit(p) for p in probs])).alias(c) for c in "xz"]).collect():
        assert got.pop((r.g, "x")) == pytest.approx(r.x, abs=1e-12) and got.pop((r.g, "z")) == pytest.approx(r.z, abs=1e-12)
    assert not got


def test_rank_correlation_equals_that_of_average_ranks(df, rows):
    both = [(r[2], r[3]) for r in rows if r[2] is not None and r[3] is not None]

    def average(v):
        v = np.array(v)
        return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])

    a, b = average([p[0] for p in both]), average([p[1] for p in both])
    r = ranks.spearman(df, "x", "z").first()
    assert r.n == len(both) and r.rho == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-12)
    assert ranks.spearman(df.withColumn("z", F.lit(1.0)), "x", "z").first().rho is None


def test_empty_tables(df):
    none = df.limit(0)
    assert ranks.ordered(none, "x", "id").count() == ranks.with_decile(none, "x", "d", "id").count() == ranks.with_qcut(none, "x", 4, "b").count() == 0
    assert ranks.quantiles(none, ["x"], [0.5], ["g"]).count() == 0 and tuple(ranks.spearman(none, "x", "z").first()) == (0, None)


def _rows_in_any_order(spark, monkeypatch):
    """Cuts that are other ones at each evaluation, as estimates that arrive in another order are; 20,000 values, ties among them."""
    some = F.udf(lambda _: sorted(b / 0.4 for b in set(os.urandom(40))), "array<double>")
    monkeypatch.setattr(ranks, "_cuts", lambda x: some(F.min(x)))
    return spark.range(0, 20_000, 1, 4).select("id", F.lit("A").alias("g"), (F.pmod(F.col("id") * 7919, F.lit(5003)) / 10).alias("x"), F.pmod(F.col("id") * 31, F.lit(977)).cast("double").alias("z"))


def test_results_do_not_depend_on_the_cuts(spark, monkeypatch):
    df = _rows_in_any_order(spark, monkeypatch)
    monkeypatch.setattr(ranks, "SMALL", 0, raising=False)
    xs = [i * 7919 % 5003 / 10 for i in range(20_000)]
    zs = [float(i * 31 % 977) for i in range(20_000)]
    got = {r.column: r.q for r in ranks.quantiles(df, ["x", "z"], [0.05, 0.5, 0.95], ["g"]).collect()}
    for name, v in (("x", xs), ("z", zs)):
        assert got[name] == pytest.approx(np.quantile(v, [0.05, 0.5, 0.95]), abs=1e-9)
    rank = lambda v: np.array([np.searchsorted(np.sort(v), a, "left") + np.searchsorted(np.sort(v), a, "right") + 1 for a in v]) / 2
    assert ranks.spearman(df, "x", "z").first().rho == pytest.approx(np.corrcoef(rank(np.array(xs)), rank(np.array(zs)))[0, 1], abs=1e-9)
    order = sorted(range(20_000), key=lambda i: (xs[i], i))
    assert {r.id: r._rn for r in ranks.ordered(df, "x", "id").collect()} == {i: n for n, i in enumerate(order, 1)}


@pytest.mark.parametrize("small", [0, 1 << 16])
def test_quantiles_of_small_and_of_large_groups_are_the_same(df, rows, monkeypatch, small):
    monkeypatch.setattr(ranks, "SMALL", small, raising=False)
    got = {(r.g, r.column): r.q for r in ranks.quantiles(df, ["x", "z"], [0.0, 0.3, 0.5, 1.0], ["g"]).collect()}
    for g in "AB":
        for i, name in ((2, "x"), (3, "z")):
            assert got[g, name] == pytest.approx(np.quantile([r[i] for r in rows if r[1] == g and r[i] is not None], [0.0, 0.3, 0.5, 1.0]), abs=1e-12)
