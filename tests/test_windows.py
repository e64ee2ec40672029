"""Window primitives against naive row-by-row models, and their null rules."""

import math
import random

from pyspark.sql import functions as F

from tidemark.functions import windows as W
from tidemark.functions.windows import MARKET, SEG

_rng = random.Random(7)


def bars(spark, n=200, segments=3):
    rows = []
    for i in range(n):
        seg = f"s{i * segments // n}"
        close = 100 + _rng.gauss(0, 2)
        rows.append(("ES", seg, i, close - _rng.random(), close + _rng.random() + 1, close - _rng.random() - 1, close, _rng.randint(1, 90), _rng.random() > 0.08, None if _rng.random() < 0.1 else _rng.gauss(0, 1)))
    return rows, spark.createDataFrame(rows, "market string, session_segment_id string, ts int, open double, high double, low double, close double, volume int, valid boolean, x double")


def by_segment(rows):
    out = {}
    for r in rows:
        out.setdefault(r[1], []).append(r)
    return out.values()


def check(got, want):
    got = {r.ts: r.v for r in got.collect()}
    assert len(got) == len(want)
    for t, v in want.items():
        assert (got[t] is None) == (v is None) and (v is None or math.isclose(got[t], v, rel_tol=1e-9, abs_tol=1e-9)), (t, got[t], v)


def test_rolling_needs_values_not_rows(spark):
    rows, df = bars(spark)
    want = {}
    for seg in by_segment(rows):
        for i, r in enumerate(seg):
            xs = [s[9] for s in seg[max(0, i - 4) : i + 1] if s[9] is not None]
            want[r[2]] = sum(xs) / 5 if len(xs) == 5 else None
    check(df.select("ts", SEG.full("x", 5, F.avg).alias("v")), want)


def test_returns_need_consecutive_valid_bars(spark):
    rows, df = bars(spark)
    want = {}
    for seg in by_segment(rows):
        for i, r in enumerate(seg):
            ok = i >= 5 and all(s[8] for s in seg[i - 5 : i + 1])
            want[r[2]] = r[6] / seg[i - 5][6] - 1 if ok else None
    check(df.select("ts", SEG.ret_over("close", "valid", 5).alias("v")), want)


def test_bars_since_skips_invalid_bars_without_reset(spark):
    rows, df = bars(spark)
    want = {}
    for seg in by_segment(rows):
        count = None
        for r in seg:
            if not r[8]:
                want[r[2]] = None
                continue
            count = 0 if r[7] > 70 else None if count is None else count + 1
            want[r[2]] = count
    check(W.with_bars_since(df, F.col("volume") > 70, "valid", "v"), want)


def test_consecutive_resets_on_invalid(spark):
    rows, df = bars(spark)
    want = {}
    for seg in by_segment(rows):
        n = 0
        for r in seg:
            n = n + 1 if r[8] and r[7] > 30 else 0
            want[r[2]] = n
    check(W.with_consecutive(df, F.col("volume") > 30, "valid", "v"), want)


def test_ewm_std_equals_pandas(spark):
    import pandas as pd

    rows, df = bars(spark)
    want = {}
    for seg in by_segment(rows):
        s = pd.Series([r[9] for r in seg], dtype=float).ewm(span=6, min_periods=6, adjust=False).std()
        for r, v in zip(seg, s, strict=True):
            if r[9] is not None:
                want[r[2]] = None if math.isnan(v) else v
    check(W.with_ewm_std(df, "x", 6, "v").where("x is not null"), want)


def test_first_hit_takes_the_earliest_offset(spark):
    rows, df = bars(spark, 60, 1)
    want = {r[2]: next((k for k in range(1, 9) if i + k < len(rows) and rows[i + k][4] >= r[6] + 2), None) for i, r in enumerate(rows)}
    check(df.select("ts", MARKET.first_hit("high", F.col("close") + 2, 8).alias("v")), want)


def test_future_flags_are_false_past_the_end(spark):
    rows, df = bars(spark, 40, 2)
    want = {r[2]: float(any(not s[8] for s in rows[i : i + 5])) for i, r in enumerate(rows)}
    check(df.select("ts", MARKET.future_any(~F.col("valid"), 4).cast("double").alias("v")), want)
    same = {r[2]: float(len(rows[i + 1 : i + 5]) == 4 and all(s[1] == r[1] for s in rows[i + 1 : i + 5])) for i, r in enumerate(rows)}
    check(df.select("ts", MARKET.future_same("session_segment_id", 4).cast("double").alias("v")), same)


def test_shock_state_follows_a_row_by_row_model(spark):
    rows, df = bars(spark)
    df = df.withColumns({"prev_close": SEG.lag("close")})
    df = df.withColumns({"tr": W.true_range("prev_close"), "shock": F.col("volume") > 75})
    got = {r.ts: (r.post_shock_retrace_pct, r.post_shock_continuation_pct, r.post_shock_range_decay) for r in W.with_shock_state(df, "shock", "valid").collect()}
    for seg in by_segment(rows):
        state, recent, prev = None, [], None
        for r in seg:
            _, _, ts, _, h, lo, c, vol, ok, _ = r
            tr = h - lo if prev is None else max(h - lo, abs(h - prev), abs(lo - prev))
            want = (None, None, None)
            if not ok:
                state, recent = None, []
            else:
                if vol > 75:
                    state, recent = (c, h, lo, tr, 0 if prev is None else (c > prev) - (c < prev)), [tr]
                elif state:
                    recent.append(tr)
                if state and state[4] and prev is not None or state and state[4]:
                    sc, sh, sl, st, d = state
                    move = sc - sl if d > 0 else sh - sc
                    move = move if move >= max(1e-12, 0.01 * st) else st
                    want = (max(0, (sc - c) * d) / move, max(0, h - sh if d > 0 else sl - lo) / move, sum(recent[-5:]) / len(recent[-5:]) / st)
            prev = c
            for a, b in zip(got[ts], want, strict=True):
                assert (a is None) == (b is None) and (b is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)), (ts, got[ts], want)


def test_equal_windows_share_one_sort(spark):
    _, df = bars(spark)
    out = df.select("ts", *[SEG.full("x", n, a).alias(f"a{n}{i}") for n in (5, 20, 60) for i, a in enumerate((F.avg, F.max, F.stddev_pop))])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") <= 2


def test_null_markets_are_a_group_of_their_own(spark):
    df = spark.createDataFrame([(None, "a", 1, 1.0), (None, "a", 2, 2.0), ("ES", "a", 1, 5.0)], "market string, session_segment_id string, ts int, x double")
    assert {(r.market, r.ts): r.v for r in df.select("market", "ts", SEG.lag("x").alias("v")).collect()} == {(None, 1): None, (None, 2): 1.0, ("ES", 1): None}


def test_running_sum_is_rounded_once(spark):
    rows, df = bars(spark, 600, 2)
    want = {}
    for seg in by_segment(rows):
        known = []
        for r in seg:
            if r[8]:
                known.append(r[6] * r[7])
            want[r[2]] = math.fsum(known) if r[8] else None
    x = F.when(F.col("valid"), F.col("close") * F.col("volume").cast("double"))
    got = {r.ts: r.v for r in df.select("ts", SEG.running_sum(x).alias("v")).collect()}
    plain = {r.ts: r.v for r in df.select("ts", SEG.running(x, F.sum).alias("v")).collect()}
    assert got == want and plain != want
