"""Scoped trade measures against pandas, with null keys, ties and empty frames."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import drilldown

SCHEMA = "market string, fold_id int, position int, base_position int, gross double, slippage_cost double, commission_cost double, cost double, net double, p_long double, p_short double, p_fade double, p_trend double, y_sign int, flat_ok boolean, fade_ok boolean, trend_block boolean, entry_price double, exit_price double, point_value double, cost_ticks double, tick_value double, slippage_ticks double, scope string"


def rows(n=400):
    rng = np.random.default_rng(5)
    out = []
    for i in range(n):
        pos = int(rng.integers(-1, 2))
        gross = float(rng.integers(-8, 9)) * (pos != 0)
        slip, com = (1.0, 0.5) if pos else (0.0, 0.0)
        out.append((["ES", "CL", None][i % 3], i % 4, pos, pos or int(rng.integers(-1, 2)), gross, slip, com, slip + com, gross - slip - com, *[float(x) for x in rng.random(4).round(2)], int(rng.integers(-1, 3)), bool(i % 5), bool(i % 7), i % 6 == 0, 10.0, 11.0, 2.0, 3.0, 0.5, 0.25, "clash"))
    return out


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def test_measures_equal_pandas(df):
    scopes = {"all": ((), None), "by": (("market", "fold_id"), None), "longs": (("market",), "position = 1")}
    got = {(r["scope"], r["bucket"]): r for r in drilldown.measures(df, scopes, drilldown.sums() | drilldown.quality(), drilldown.MEDIANS).collect()}
    pdf = pd.DataFrame(rows(), columns=[c.split()[0] for c in SCHEMA.split(", ")])
    groups = {("all", ""): pdf}
    groups |= {("by", f"market={'null' if m is None else m}|fold_id={f}"): g for (m, f), g in pdf.assign(market=pdf.market.fillna("null")).groupby(["market", "fold_id"])}
    groups |= {("longs", f"market={m}"): g for m, g in pdf[pdf.position == 1].assign(market=pdf.market.fillna("null")).groupby("market")}
    assert set(got) == set(groups)
    for key, g in groups.items():
        r, t = got[key], g[g.position != 0]
        assert (r["row_count"], r["trade_count"], r["long_count"], r["short_count"]) == (len(g), len(t), (g.position == 1).sum(), (g.position == -1).sum())
        for name, want in {"net": g.net.sum(), "median_gross": t.gross.median(), "median_net": t.net.median(), "mean_net": t.net.mean(), "net_win_rate": (t.net > 0).mean(), "avg_cost": g.cost.sum() / len(t), "avg_margin": (t.p_long - t.p_short).abs().mean()}.items():
            assert r[name] == pytest.approx(want), (key, name)
        hits = t[t.y_sign.isin([-1, 0, 1])]
        assert r["traded_accuracy"] == pytest.approx((hits.position == hits.y_sign).mean())


def test_categories(df):
    got = {tuple(r) for r in df.select("position", "base_position", "flat_ok", "fade_ok", "trend_block", drilldown.category().alias("a"), drilldown.category(("fade_filter", "trend_danger")).alias("b")).distinct().collect()}
    for pos, base, flat_ok, fade_ok, trend, a, b in got:
        if pos:
            want = ("traded", "traded")
        elif not base:
            want = ("no_direction", "no_direction")
        elif not flat_ok:
            want = ("flat_probability", "flat_probability")
        else:
            stops = [n for n, on in (("trend_danger", trend), ("fade_filter", not fade_ok)) if on] or ["other"]
            want = (stops[0], stops[-1])
        assert (a, b) == want


def test_thresholds_and_decision(df):
    dated = df.withColumn("ts", F.lit("2024-03-05 07:00:00").cast("timestamp_ntz"))
    s = drilldown.stability(dated, 0.2, 0.5, 0.8)
    by = {(r["scope"], r["bucket"]): r for r in s.collect()}
    want = sum(1 for r in rows() if abs(r[9] - r[10]) >= 0.2 and r[11] >= 0.5 and r[12] < 0.8)
    assert by["overall", ""]["trade_count"] == want == by["month", "month=2024-03"]["trade_count"] and by["hour", "hour=7"]["row_count"] == 400
    d = drilldown.decision(s, 10_000, 9, 0).first()
    assert not d["stable"] and d["markets"] == 3 and d["folds"] == 4 and d["reasons"].startswith(f"only {want} trades below minimum 10000; only ")
    none = drilldown.decision(s.limit(0), 1, 1, 1).first()
    assert not none["stable"] and none["trades"] == 0


def test_findings_and_empty(spark, df):
    full = df.withColumns({"side": F.when(F.col("position") > 0, "long").when(F.col("position") < 0, "short").otherwise("flat"), "hour": F.lit(1), "confidence": F.lit("x"), "regime": F.lit(None).cast("string"), "volatility": F.lit("q1")})
    drilled = drilldown.trades(full)
    f = drilled.transform(drilldown.findings).first()
    nets = {r["bucket"]: r["net"] for r in drilled.where("scope = 'market'").collect()}
    assert f["worst_market_net"] == min(nets.values()) and nets[f["worst_market"]] == f["worst_market_net"] and f["traded_rows"] == sum(1 for r in rows() if r[2])
    assert all(r["gross"] > 0 and r["net"] > 0 for r in drilldown.positive_examples(drilled).collect())
    empty = drilldown.trades(full.limit(0))
    assert empty.count() == 0 and drilldown.findings(empty).first()["any_positive"] is False and drilldown.positive_examples(empty).count() == 0
    assert drilldown.cost_components(df.limit(0)).first()["cost"] == 0.0
