"""The tail audit's runs and gates against plain loops."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators import tail


def longest(values):
    best = run = 0
    for v in values:
        run = run + 1 if v is not None and v < 0 else 0
        best = max(best, run)
    return best


def test_losing_runs_merge_across_months_folds_and_markets(spark):
    rng = random.Random(2)
    rows = []
    for m in "AB":
        for fold in (0, 1):
            t = dt.datetime(2024, 1 + 2 * fold, 20)
            for _ in range(rng.randint(0, 60)):
                t += dt.timedelta(hours=rng.randint(1, 60))
                rows.append((m, fold, t, rng.choice([-1.0, -1.0, -2.0, -1.0, 0.0, 3.0, None]), rng.choice(["x", "y"])))
    df = spark.createDataFrame(rows, "market string, fold_id int, ts timestamp_ntz, net double, kind string").withColumn("one", F.lit(1)).repartition(4)
    order = sorted(rows, key=lambda r: r[:3])
    assert tail.losing_streaks(df, "net", ["one"]).first().max_losing_streak == longest([r[3] for r in order])
    for by, i in (("market", 0), ("kind", 4), ("fold_id", 1)):
        got = {r[0]: r.max_losing_streak for r in tail.losing_streaks(df, "net", [by]).collect()}
        assert got == {k: longest([r[3] for r in order if r[i] == k]) for k in {r[i] for r in rows}}, by
    all_lost = df.withColumn("net", F.lit(-1.0))
    assert tail.losing_streaks(all_lost, "net", ["one"]).first().max_losing_streak == len(rows)
    assert tail.losing_streaks(df.limit(0), "net", ["one"]).count() == 0


def bar(i, base, edge, fade, trend):
    return ("A", 0, dt.datetime(2024, 1, 1, i), "s", base, edge, fade, trend, 100.0, 101.0, 1.0, 2.0, 1.0, 0.5)


SCHEMA = "market string, fold_id int, ts timestamp_ntz, session_id string, base_position int, expected_return double, p_fade double, p_trend double, entry_price double, exit_price double, point_value double, cost_ticks double, tick_value double, slippage_ticks double"


def test_gates_escape_and_reasons(spark):
    # an edge of 0.1 is 10 dollars; the cost is 2, the buffer 3
    rows = [bar(0, 0, 0.1, 0.9, 0.1), bar(1, 1, 0.1, 0.1, 0.1), bar(2, 1, 0.05, 0.9, 0.1), bar(3, 1, 0.1, 0.9, 0.1), bar(4, 1, 0.1, 0.9, 0.9), bar(5, 1, 0.3, 0.9, None), bar(6, -1, 0.1, 0.9, 0.1), bar(7, 1, None, 0.9, 0.1), bar(8, 1, 0.1, None, 0.1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = tail.overlay(df, tail.Gates(buffer=3.0, escape=True, escape_edge=20.0)).orderBy("ts").collect()
    assert [r.overlay_reason for r in got] == ["no_direction_edge", "fade_success_below_cutoff", "edge_below_cost_plus_buffer", "trade", "trend_danger_block", "momentum_escape", "edge_below_cost_plus_buffer", "edge_below_cost_plus_buffer", "fade_success_below_cutoff"]
    assert [r.free_position for r in got] == [0, 0, 0, 1, 1, 1, 0, 0, 0] and [r.overlay_position for r in got] == [0, 0, 0, 1, 0, 1, 0, 0, 0]
    calm = tail.overlay(df, tail.Gates(buffer=3.0)).orderBy("ts").collect()
    assert [r.overlay_position for r in calm] == [0, 0, 0, 1, 0, 0, 0, 0, 0] and not any(r.escaped for r in calm)
    s = tail.summary(tail.scenario(tail.overlay(df, tail.Gates(buffer=3.0)), "no_trend_danger_block"), ["market"]).first()
    assert (s.n_rows, s.candidates, s.trade_count, s.blocked, s.gross_sum, s.cost_sum, s.slippage_sum, s.commission_sum, s.net_sum, s.turnover, s.max_losing_streak) == (9, 8, 3, 2, 3.0, 6.0, 3.0, 3.0, -3.0, 2.0, 3)
    worst = tail.worst_sessions(tail.scenario(tail.overlay(df), "mr_tail_overlay"), 5).collect()
    assert [r.session for r in worst] == ["A|s"]
