"""Worked examples of sessions, gaps, labels, features, folds, policy and backtest."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtest, causal, features, joins, labels, metrics, models, policy, splits, validation
from tidemark.sources import bars as sources
from tidemark.sources import tables


def ts(text):
    return dt.datetime.fromisoformat(text)


RAW = "market string, ts timestamp_ntz, open double, high double, low double, close double, volume long, instrument_id int, data_quality_degraded boolean"


def raw(spark, times, ids=None, degraded=()):
    rows = [("ES", ts(t), 100.5, 101.0, 100.0, 100.5, 10, 1 if ids is None else ids[i], t in degraded) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, RAW)


# causal base


@pytest.mark.parametrize(("second", "most", "synthetic"), [("2024-01-02T15:02", 120, 1), ("2024-01-02T15:03", 3, 2), ("2024-01-02T15:04", 3, 0)])
def test_gaps_fill_up_to_their_limit(spark, second, most, synthetic):
    out = causal.build(raw(spark, ["2024-01-02T15:00", second]), causal.Calendar(), most_minutes=most).where("is_synthetic").collect()
    assert len(out) == synthetic and all(r.open == r.close == 100.5 and r.volume == 0 and r.boundary_session_flag for r in out)


def test_gaps_stay_open_where_the_contract_changes(spark):
    assert causal.build(raw(spark, ["2024-01-02T15:00", "2024-01-02T15:03"], [1, 2]), causal.Calendar()).where("is_synthetic").count() == 0


def test_sessions_follow_the_exchange_clock(spark):
    cal = causal.Calendar(closed=("2024-01-03",), early={"2024-01-05": 720})
    times = ["2024-01-02T23:00", "2024-01-02T21:59", "2024-01-02T22:30", "2024-01-05T17:59", "2024-01-05T18:00", "2024-01-06T15:00", "2024-07-01T21:30", "2024-07-01T22:00"]
    got = {r.ts: r for r in causal.with_sessions(raw(spark, times), cal).collect()}
    assert got[ts(times[1])].session_id == "session_2024-01-02" and got[ts(times[1])].minutes_until_session_close == 1
    assert not got[ts(times[0])].inside_session and not got[ts(times[2])].inside_session  # a holiday's session, and the daily break
    assert got[ts(times[3])].inside_session and not got[ts(times[4])].inside_session and not got[ts(times[5])].inside_session
    assert not got[ts(times[6])].inside_session and got[ts(times[7])].session_id == "session_2024-07-02" and got[ts(times[7])].minutes_since_session_open == 0


def test_degraded_bars_spoil_their_session(spark):
    out = causal.build(raw(spark, ["2024-01-02T15:00", "2024-01-02T15:01"], degraded=("2024-01-02T15:01",)), causal.Calendar())
    assert all("degraded_session" in r.causal_invalid_reason for r in out.collect())


def test_rolls_open_segments_and_windows(spark):
    times = [f"2024-01-02T15:{m:02d}" for m in range(40)]
    out = causal.with_rolls(causal.with_sessions(raw(spark, times, [1] * 20 + [2] * 20), causal.Calendar()), 5).orderBy("ts").collect()
    assert [r.roll_boundary_flag for r in out] == [i == 20 for i in range(40)]
    assert [r.roll_window_flag for r in out] == [15 <= i <= 25 for i in range(40)]
    assert out[19].session_segment_id.endswith("_seg0") and out[20].session_segment_id.endswith("_seg1")


def test_raw_rules_count_what_is_broken(spark):
    rows = [("ES", 1, ts("2024-01-02T15:00"), 1.0, 2.0, 0.5, 1.0, 5), ("ES", 2, ts("2024-01-02T14:00"), 1.0, 0.9, 0.5, 1.0, -1), ("ES", 3, None, 1.0, 2.0, 0.5, 1.0, 1), ("ES", 4, ts("2024-01-02T15:00"), 1.0, 2.0, 0.5, 1.0, 1)]
    r = causal.raw_rules(spark.createDataFrame(rows, "market string, source_row int, ts timestamp_ntz, open double, high double, low double, close double, volume long")).first()
    assert (r.n_rows, r.null_ts, r.duplicate_ts, r.not_monotonic, r.bad_ohlcv, r.negative_volume) == (4, 1, 1, 1, 1, 1)


# labels and features


def ramp(spark, n=70, step=0.25, bad=()):
    rows = []
    for i in range(n):
        o = 100 + step * i
        rows.append(("ES", ts("2024-01-02T15:00") + dt.timedelta(minutes=i), o, o + 0.25, o - 0.25, o, 10 + i % 3, "seg0", i not in bad, True, False, False, False, False, i, n - 1 - i, i / n, 540 + i, 1, 0.25, 12.5, 2.0, 4.0, 6.0))
    return spark.createDataFrame(rows, "market string, ts timestamp_ntz, open double, high double, low double, close double, volume long, session_segment_id string, causal_valid boolean, valid_ohlcv boolean, is_synthetic boolean, boundary_session_flag boolean, roll_boundary_flag boolean, roll_window_flag boolean, minutes_since_session_open int, minutes_until_session_close int, session_progress double, minute_of_day int, day_of_week int, tick_size double, tick_value double, cost_ticks double, min_profit_ticks double, min_stop_ticks double")


def test_labels_enter_at_the_next_open_and_leave_fifteen_later(spark):
    out = labels.add_labels(ramp(spark, 40)).orderBy("ts").collect()
    assert out[0].target_entry_price == 100.25 and out[0].target_exit_price == 104.0 and out[0].target_ret_ticks_15m == 15.0
    assert out[0].target_net_ticks_after_est_cost == 13.0 and out[0].target_sign_with_deadzone == 1
    assert out[24].target_invalid_reason == "exit_missing" and out[39].target_invalid_reason == "entry_missing" and out[23].target_valid


def test_labels_refuse_bad_rows_and_paths(spark):
    out = labels.add_labels(ramp(spark, 60, bad=(3,)).withColumn("is_synthetic", F.minute("ts") == 30)).orderBy("ts").collect()
    assert out[3].target_invalid_reason == "current_causal_valid_false" and out[14].target_invalid_reason == "synthetic_path" and out[13].target_valid


def test_small_moves_are_in_the_dead_zone(spark):
    out = labels.add_labels(ramp(spark, 40, step=0.05)).orderBy("ts").first()
    assert out.target_ret_ticks_15m == pytest.approx(3.0) and out.target_sign_with_deadzone == 0 and out.target_sign_15m == 1


def feature_rows(spark, df):
    out = features.build(labels.add_labels(df)).orderBy("ts")
    return [x for x in out.columns if x.startswith("feature_")], out.collect()


def test_features_do_not_see_the_future(spark):
    df = ramp(spark)
    names, a = feature_rows(spark, df)
    _, b = feature_rows(spark, df.withColumn("close", F.when(F.col("minutes_since_session_open") > 40, F.col("close") * 3).otherwise(F.col("close"))))
    for x, y in zip(a[:41], b[:41], strict=True):
        assert all(x[n] == y[n] for n in names)
    assert a[50]["feature_ret_1"] != b[41]["feature_ret_1"]


def test_labels_do_not_see_the_past(spark):
    df = ramp(spark)
    a = labels.add_labels(df).orderBy("ts").collect()
    b = labels.add_labels(df.withColumn("open", F.when(F.col("minutes_since_session_open") < 20, F.col("open") + 1).otherwise(F.col("open")))).orderBy("ts").collect()
    assert all(x.target_ret_15m == y.target_ret_15m for x, y in zip(a[20:], b[20:], strict=True))


def test_features_are_null_on_invalid_bars_and_not_across_them(spark):
    names, out = feature_rows(spark, ramp(spark, 50, bad=(20,)))
    assert all(out[20][n] in (None, False) for n in names)
    assert out[24]["feature_ret_5"] is None and out[26]["feature_ret_5"] is not None
    assert out[10]["feature_prior_high_20_dist"] is None and out[49]["feature_prior_high_20_dist"] is not None


def test_registry_has_122_features_in_14_families():
    assert len(features.FEATURES) == len(set(features.FEATURES)) == 122 and len(features.FAMILIES) == 14
    with pytest.raises(ValueError):
        features.registry(["feature_target_leak"])


# joins and metrics


def test_asof_takes_exact_and_earlier_versions(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (1, 2), (2, 7), (None, 3)], "k int, t int")
    right = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (3, 1, "c")], "k int, t2 int, v string")
    assert {(r.k, r.t): r.v for r in joins.asof_backward(left, right, ["k"], "t", "t2", ["v"]).collect()} == {(1, 5): "a", (1, 10): "b", (1, 2): None, (2, 7): None, (None, 3): None}


def test_null_keys_match_where_asked(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, x int")
    right = spark.createDataFrame([(None, 10), ("b", 20)], "k string, y int")
    assert {(r.k, r.y) for r in joins.nullsafe_left(left, right, ["k"]).collect()} == {(None, 10), ("a", None)}


def test_range_join_equals_a_nested_loop(spark):
    rows = spark.range(300).select(F.lit("m").alias("m"), F.col("id").cast("int").alias("t"))
    ranges = spark.createDataFrame([("m", i, i * 7 % 290, i * 7 % 290 + i) for i in range(40)], "m string, r int, lo int, hi int")
    got = {(r.t, r.r) for r in joins.range_join(rows, ranges, "t", "lo", "hi", ["m"], 16).select("t", "r").collect()}
    assert got == {(t, i) for i in range(40) for t in range(300) if i * 7 % 290 <= t <= i * 7 % 290 + i}


def test_order_dependent_metrics(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([5, -1, -2, 4, -1, -1, -1, 3])], "m string, t int, net double")
    assert metrics.with_drawdown(df, "net", ["m"], ["t"]).agg(F.min("drawdown")).first()[0] == -3.0
    assert metrics.with_streak(df, "net", ["m"], ["t"]).agg(F.max("streak")).first()[0] == 3


def test_deciles_go_by_rank_not_by_tile(spark):
    got = metrics.with_decile(spark.range(13).withColumn("x", F.col("id")), "x", "d").orderBy("id").collect()
    assert [r.d for r in got] == [f"d{-(-10 * (i + 1) // 13):02d}" for i in range(13)]


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(metrics.pearson("a", "b")).first()[0] is None


# policy and backtest


PRED = "market string, fold_id int, session_id string, bar int, ts int, p_long double, p_short double, p_flat double, p_fade double, p_trend double, expected_return double, entry_price double, exit_price double, y_sign int"


def test_policy_reasons(spark):
    rows = [
        ("ES", 0, "s", 1, 1, 0.7, 0.1, 0.2, 0.9, 0.1, 0.0, 100.0, 102.0, 1),
        ("ES", 0, "s", 2, 2, 0.1, 0.7, 0.2, 0.9, 0.1, 0.0, 102.0, 101.0, -1),
        ("ES", 0, "s", 3, 3, 0.7, 0.1, 0.2, 0.9, None, 0.0, 100.0, 100.0, 0),
        ("ES", 0, "s", 4, 4, 0.7, 0.1, 0.2, None, 0.1, 0.0, 100.0, 100.0, 0),
        ("ES", 0, "s", 5, 5, 0.4, 0.1, 0.5, 0.9, 0.1, 0.0, 100.0, 100.0, 0),
        ("ES", 0, "s", 6, 6, 0.40, 0.38, 0.2, 0.9, 0.1, 0.0, 100.0, 100.0, 0),
    ]
    df = policy.frame(spark.createDataFrame(rows, PRED), sources.costs(spark)).orderBy("bar").collect()
    assert [r.reason for r in df] == ["trade", "trade", "trend_danger_block", "fade_filter_block", "flat_probability_block", "no_direction_edge"]
    assert [r.position for r in df] == [1, -1, 0, 0, 0, 0] and sum(r.gross for r in df) == 150.0 and sum(r.cost for r in df) == 50.0
    assert [r.turnover for r in df] == [1, 2, 1, 0, 0, 0]


def test_equal_times_go_by_bar(spark):
    rows = [("ES", 0, "s", i, 1, 0.7 if i % 3 else 0.1, 0.1 if i % 3 else 0.7, 0.0, 0.9, 0.1, 0.0, 100.0, 100.0 + (i % 7 - 3), 1) for i in range(60)]
    df = spark.createDataFrame(rows[::-1], PRED).coalesce(1).withColumn("ts", F.timestamp_seconds("ts"))
    frame = policy.frame(df, sources.costs(spark))
    pos = [1 if i % 3 else -1 for i in range(60)]
    assert [r.turnover for r in frame.orderBy("bar").collect()] == [abs(a - b) for a, b in zip(pos, [0, *pos[:-1]], strict=True)]
    cum = pd.Series([r.net for r in frame.orderBy("bar").collect()]).cumsum()
    assert policy.max_drawdown(frame, ["market"]).first().max_drawdown == pytest.approx((cum - cum.cummax()).min())


def test_pivot_restores_wide_rows_with_null_keys(spark):
    wide = spark.createDataFrame([("ES", None, None, 1, 1, 0.1, 0.2, 0.3, None, 0.5, 0.6, 1.0, 2.0, 1)], PRED)
    got = policy.pivot(policy.to_long(wide), policy.KEYS).first().asDict()
    assert got == wide.first().asDict()


def run_backtest(spark, prices, signals, slip=0.0, fee=0.0):
    rows = [("ES", i, "s", float(p), float(s)) for i, (p, s) in enumerate(zip(prices, signals, strict=True))]
    df = spark.createDataFrame(rows, "market string, ts int, session_id string, mark double, signal double")
    df = df.withColumns({"tick_size": F.lit(0.25), "tick_value": F.lit(12.5), "point_value": F.lit(50.0), "slippage_ticks": F.lit(slip), "commission_per_contract": F.lit(fee)})
    return backtest.run(backtest.desired_positions(df, flat_at_end=False))


def test_backtest_by_hand(spark):
    a = run_backtest(spark, [100, 101, 101], [1, 1, 0])
    assert a.agg(F.sum("net")).first()[0] == 50.0 and [r.order_qty for r in backtest.fills(a).orderBy("ts").collect()] == [1.0, -1.0]
    b = run_backtest(spark, [100, 100.5], [1, -1])
    assert [r.order_qty for r in backtest.fills(b).orderBy("ts").collect()] == [1.0, -2.0] and backtest.metrics(b).first().turnover == 3.0
    c = run_backtest(spark, [100, 100], [1, 1], slip=1.0, fee=4.0).orderBy("ts").first()
    assert (c.fill_price, c.slippage, c.commission) == (100.25, 12.5, 4.0)
    d = backtest.metrics(run_backtest(spark, [100, 99, 101, 101], [1, 1, 1, 0])).first()
    assert d.max_drawdown == -50.0 and d.ending_equity == 100_050.0


# folds and models


def minutes(spark, days=7):
    rows = spark.range(days * 1440).select(F.lit("ES").alias("market"), F.timestamp_add("MINUTE", F.col("id").cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("ts"))
    return rows.withColumn("eligible", F.lit(True))


def test_folds_step_purge_and_do_not_overlap(spark):
    w = splits.Windows(2, 1, 1, 3)
    plan = splits.plan(minutes(spark), w).orderBy("fold").collect()
    assert [r.fold for r in plan] == [1, 2, 3, 4] and all((r.n_train, r.n_purged, r.n_test) == (2877, 3, 1440) for r in plan)
    assert plan[0].test_start == ts("2024-01-03T00:00") and plan[0].purged_train_end == ts("2024-01-02T23:56")
    assert splits.overlap_guard(splits.assign(minutes(spark), w)).count() == 0


def test_split_groups_and_policy():
    assert splits.split_group(2025, {2025}, {2026}) == "final_holdout" and splits.split_group(2024, {2025}, {2026}) == "research"
    assert splits.policy_problems({"purge_bars": 16, "entry_lag_bars": 1, "target_horizon_bars": 15}) == []


def model_frame(spark, n=900):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 3))
    y = x @ [1.5, -2.0, 0.0] + 0.3 + rng.normal(size=n) * 0.1
    key = np.where(np.arange(n) % 3 == 0, "a", "b")
    rows = [(str(k), [float(v) for v in r], float(t)) for k, r, t in zip(key, x, y, strict=True)]
    return key, x, y, spark.createDataFrame(rows, "key string, x array<double>, y double")


def by_key(weights):
    return {r.key: np.array(r.w) for r in weights.collect()}


def test_ridge_equals_the_closed_form(spark, monkeypatch):
    key, x, y, df = model_frame(spark)
    table = models.ridge(df, 3, alpha=2.0)
    got = by_key(table)
    monkeypatch.setattr(models, "KEPT", 5)  # a task that hands its sums on early
    assert all(np.allclose(v, got[k]) for k, v in by_key(models.ridge(df, 3, alpha=2.0)).items())
    for k in "ab":
        a = np.hstack([x[key == k], np.ones(((key == k).sum(), 1))])
        assert np.allclose(got[k], np.linalg.solve(a.T @ a + np.diag([2, 2, 2, 0]), a.T @ y[key == k]))
    pred = models.predict(df, table).agg(F.avg(F.abs(F.col("y") - F.col("y_pred")))).first()[0]
    assert pred < 0.15


def test_logistic_is_at_its_optimum(spark):
    key, x, y, df = model_frame(spark)
    w, ok = models.logistic(df.withColumn("y", (F.col("y") > 0).cast("double")), 3)
    assert ok
    w = by_key(w)
    a = np.hstack([x[key == "b"], np.ones(((key == "b").sum(), 1))])
    p = 1 / (1 + np.exp(-a @ w["b"]))
    assert np.abs(a.T @ (p - (y[key == "b"] > 0)) + np.array([1, 1, 1, 0]) * w["b"]).max() < 1e-5


def test_fits_leave_nothing_by_fold_on_the_driver(spark, monkeypatch):
    """Only flags come back: no row a fold, no sums, no weights."""
    _, _, _, df = model_frame(spark)
    many = df.withColumn("key", F.concat("key", (F.monotonically_increasing_id() % 20).cast("string"))).withColumn("y", F.signum("y"))
    many = spark.createDataFrame(many.collect(), many.schema)
    came = []
    from pyspark.sql.classic.dataframe import DataFrame as Frame

    real = Frame.collect
    monkeypatch.setattr(Frame, "collect", lambda self: came.append(rows := real(self)) or rows)
    models.classifier(many, 3)
    models.ridge(many, 3)
    assert came and max(map(len, came)) <= 3


def test_softmax_is_at_its_optimum(spark):
    key, x, y, df = model_frame(spark)
    df = df.withColumn("y", F.when(F.abs("y") < 0.8, 0).otherwise(F.signum("y")).cast("double"))
    w, ok = models.softmax(df, 3)
    assert ok
    w = {k: v.reshape(3, 4) for k, v in by_key(w).items()}
    for k in "ab":
        a = np.hstack([x[key == k], np.ones(((key == k).sum(), 1))])
        t = np.where(np.abs(y[key == k]) < 0.8, 0, np.sign(y[key == k]))
        p = np.exp(a @ w[k].T)
        p /= p.sum(axis=1, keepdims=True)
        grad = (p - (t[:, None] == np.array([-1, 0, 1]))).T @ a + np.array([1, 1, 1, 0]) * w[k]
        assert np.abs(grad).max() < 1e-5
        assert np.abs(w[k][:, :3].sum(axis=0)).max() < 1e-6


def test_classifier_knows_the_classes_of_each_fold(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(v)], float(y)) for k, ys in (("one", [1]), ("two", [-1, 1]), ("three", [-1, 0, 1])) for v in rng.normal(size=60) for y in [ys[int(abs(v * 10)) % len(ys)]]]
    df = spark.createDataFrame(rows, "key string, x array<double>, y double")
    w, ok = models.classifier(df, 1)
    assert ok
    out = {k: [r for r in models.predict_classes(df, w).collect() if r.key == k] for k in ("one", "two", "three")}
    assert all((r.p_short, r.p_flat, r.p_long) == (None, None, 1.0) for r in out["one"])
    assert all(r.p_flat is None and r.p_short + r.p_long == pytest.approx(1) for r in out["two"])
    assert all(r.p_flat + r.p_short + r.p_long == pytest.approx(1) for r in out["three"])
    two, _ = models.logistic(df.where("key = 'two'").withColumn("y", (F.col("y") == 1).cast("double")), 1)
    two = by_key(two)
    r = out["two"][0]
    assert r.p_long == pytest.approx(1 / (1 + np.exp(-(two["two"][0] * r.x[0] + two["two"][1]))))


def test_drawdown_by_scopes_equals_a_running_sum(spark):
    rng = np.random.default_rng(5)
    days = pd.date_range("2024-01-01", periods=120, freq="1D")
    rows = [(m, f, str(rng.integers(2)), d.to_pydatetime(), None if rng.random() < 0.1 else float(rng.integers(-9, 9))) for m in ("A", "B") for f in (0, 1) for d in days[f * 50 : f * 50 + 70]]
    pdf = pd.DataFrame(rows, columns=["market", "fold_id", "reason", "ts", "net"]).sort_values(["market", "fold_id", "ts"])
    df = spark.createDataFrame(rows, "market string, fold_id int, reason string, ts timestamp_ntz, net double")
    scopes = {"all": [], "market": ["market"], "fold": ["fold_id"], "reason": ["reason"], "market_reason": ["market", "reason"]}
    got = metrics.drawdown_by_scopes(df, "net", scopes, ["market", "fold_id"]).collect()
    for scope, cols in scopes.items():
        groups = pdf.groupby(cols) if cols else [((), pdf)]
        for k, g in groups:
            k = k if isinstance(k, tuple) else (k,)
            cum = g["net"].fillna(0).cumsum()
            (mine,) = [r for r in got if r.scope == scope and all(r[c] == v for c, v in zip(cols, k, strict=True))]
            assert mine.max_drawdown == pytest.approx((cum - cum.cummax()).min())


def test_fitted_predictions_reach_the_policy(spark, sf_dir):
    from tidemark.operators import walkforward
    from tidemark.plans import research_queries as r

    table = r.fitted_predictions(spark, sf_dir, hours=6).cache()
    assert len(table.columns) == 30 and table.count() > 0
    assert table.groupBy(*walkforward.KEYS, "model_id").count().where("count > 1").isEmpty()
    wide = walkforward.to_policy(table)
    assert wide.count() == table.select(*walkforward.KEYS).distinct().count()
    probs = F.coalesce("p_long", F.lit(0.0)) + F.coalesce("p_short", F.lit(0.0)) + F.coalesce("p_flat", F.lit(0.0))
    assert wide.where(F.abs(probs - 1) > 1e-9).isEmpty()
    assert table.where("model_family = 'logistic' and not y_pred_raw between -1 and 1").isEmpty()


def test_correlations_of_many_columns_equal_pandas(spark):
    from tidemark.operators import screens

    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 5))
    x[:, 1] = x[:, 0] * 3 + 1000
    x[:, 4] = 7.0
    x[rng.random(x.shape) < 0.2] = np.nan
    pdf = pd.DataFrame(x, columns=list("abcde"))
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"{c} double" for c in "abcde")).repartition(5)
    want = pdf.corr()
    got = screens.correlations(df, list("abcde")).collect()
    assert len(got) == 10
    for r in got:
        v = want.loc[r.feature_a, r.feature_b]
        assert r["corr"] is None if "e" in (r.feature_a, r.feature_b) else r["corr"] == pytest.approx(v, abs=1e-9)
        assert r.n == pdf[[r.feature_a, r.feature_b]].dropna().shape[0]
    assert [(r.feature_a, r.feature_b) for r in screens.correlations(df, list("abcde"), 0.98).collect()] == [("a", "b")]
    assert screens.correlations(df.where("false"), list("abcde")).isEmpty()


def test_scaling_fills_and_survives_constants(spark):
    df = spark.createDataFrame([("a", 1.0, None, 2.0), ("a", 3.0, None, 2.0), ("a", None, None, 2.0)], "key string, f double, g double, h double")
    out = models.scaled(df, models.scaling(df, ["f", "g", "h"], ["key"]), ["f", "g", "h"], ["key"]).collect()
    assert sorted(r.x[0] for r in out) == pytest.approx([-1.224744871, 0, 1.224744871]) and all(r.x[1:] == [0.0, 0.0] for r in out)


# tables and gates


def test_alias_cycles(spark):
    assert tables.resolve_alias("a", {"a": "b", "b": "c"}) == "c"
    with pytest.raises(ValueError):
        tables.resolve_alias("a", {"a": "b", "b": "a"})
    assert tables.resolve_alias("a", {"a": "b", "b": "a"}, strict=False) == "a"


def test_writes_are_checked_and_partitions_replaced(spark, tmp_path):
    df = spark.createDataFrame([("ES", 1), ("CL", 2)], "market string, v int")
    with pytest.raises(ValueError):
        tables.publish(df, f"file://{tmp_path}/x", F.col("v") > 1)
    tables.write_parquet(df, f"file://{tmp_path}/y")
    tables.write_parquet(spark.createDataFrame([("ES", 9)], "market string, v int"), f"file://{tmp_path}/y")
    assert {(r.market, r.v) for r in spark.read.parquet(f"file://{tmp_path}/y").collect()} == {("ES", 9), ("CL", 2)}


def test_coverage_and_holdout(spark):
    k = lambda *v: spark.createDataFrame([(x,) for x in v], "m string")
    got = {r.m: r.status for r in validation.coverage(k("a", "b", "c"), k("a", "z"), k("c"), ["m"]).collect()}
    assert got == {"a": "present", "b": "missing", "c": "unavailable", "z": "extra"}
    assert validation.holdout_guard({"policy", "report"}) == ["policy"]


def test_cost_resolution_order():
    assert labels.resolve_cost({"round_turn_cost_ticks": 2.5, "cost_dollars": 100}) == 2.5 and labels.resolve_cost({"cost_dollars": 25.0, "tick_value": 12.5}) == 2.0
    assert labels.resolve_cost({"slippage_ticks_per_side": 0.5, "commission_per_contract_dollars": 1.25, "tick_value": 12.5}) == pytest.approx(1.2) and labels.resolve_cost({}) == 2.0


def test_scans_prune_columns_and_push_filters(spark, sf_dir):
    df = tables.read_columns(spark, f"{sf_dir}/events.parquet", {"event_id": "bigint", "event_type": "string"}).where("event_type = 'click'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in plan and "EqualTo(event_type,click)" in plan
