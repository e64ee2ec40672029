"""Stream state: any cut into micro-batches, restarts and late bars give what the whole table gives."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import windows as W
from tidemark.operators import causal
from tidemark.plans.window_queries import shocked
from tidemark.streaming import holes, ordered, running
from tidemark.streaming.ordered import AT, NONE

T0 = dt.datetime(2024, 1, 2, tzinfo=dt.timezone.utc)
BARS = "market string, session_id string, ts timestamp, open double, high double, low double, close double, volume long, instrument_id long, inside_session boolean, session_end long"


def processor(kind, rows, **settings):
    return kind(T.StructType([]), T.StructType.fromDDL(rows), T.StructType([]), 10**9, **settings)


def released(one, rows, cuts, nows=None):
    """What a processor gives out over releases that end at ``cuts``."""
    carry, out = one.fresh, {}
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows[AT])], strict=True)):
        now = nows[i] if nows else int(rows[AT][b - 1]) if b else NONE
        found, carry, _ = one.release({k: v[a:b] for k, v in rows.items()}, carry, now)
        for k, v in found.items():
            out.setdefault(k, []).extend(v)
    return out


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert len(a[k]) == len(b[k]), k
        for x, y in zip(a[k], b[k], strict=True):
            assert (x is None) == (y is None) and (x is None or abs(float(x) - float(y)) < 1e-9), k


def wave(seed, n):
    r = np.random.default_rng(seed)
    close = 100 + r.normal(0, 1, n).cumsum() * (1 + 5 * (r.random(n) < 0.05))
    return {AT: (np.arange(n) * 60_000).astype(np.int64), "revision": np.zeros(n, np.int64), "high": close + r.random(n), "low": close - r.random(n), "close": close, "causal_valid": r.random(n) > 0.03, "flag": r.random(n) < 0.1}


def test_running_state_is_the_same_for_any_cut(spark):
    rng = random.Random(1)
    one = processor(running.Running, "at_ms long, revision long, high double, low double, close double, causal_valid boolean, flag boolean")
    for seed in range(12):
        rows = wave(seed, rng.randint(1, 160))
        n = len(rows[AT])
        whole = released(one, rows, [])
        for _ in range(4):
            same(released(one, rows, sorted(rng.randint(0, n) for _ in range(rng.randint(1, 12)))), whole)
        same(released(one, rows, list(range(1, n))), whole)


def test_running_state_equals_the_windows(spark):
    rows = wave(5, 400)
    one = processor(running.Running, "at_ms long, revision long, high double, low double, close double, causal_valid boolean, flag boolean")
    got = released(one, rows, [7, 7, 60, 61, 222])
    data = [("A", "s", i, float(h), float(lo), float(c), bool(v), bool(f)) for i, (h, lo, c, v, f) in enumerate(zip(*(rows[k] for k in ("high", "low", "close", "causal_valid", "flag")), strict=True))]
    df = shocked(spark.createDataFrame(data, "market string, session_segment_id string, ts int, high double, low double, close double, causal_valid boolean, flag boolean"))
    df = W.with_consecutive(W.with_bars_since(df, F.col("flag"), "causal_valid", "since"), F.col("close") > F.col("prev_close"), "causal_valid", "run")
    want = W.with_shock_state(df, "shock", "causal_valid").orderBy("ts").collect()
    same(
        {k: got[k] for k in ("bars_since", "up_run", "tr", "shock", "retrace", "continuation", "decay")},
        {"bars_since": [r.since for r in want], "up_run": [r.run for r in want], "tr": [r.tr for r in want], "shock": [r.shock for r in want], "retrace": [r.post_shock_retrace_pct for r in want], "continuation": [r.post_shock_continuation_pct for r in want], "decay": [r.post_shock_range_decay for r in want]},
    )
    assert sum(x is not None for x in got["decay"]) > 100


def bars(seed, n=70, markets=("A", "B")):
    rng, out = random.Random(seed), []
    for m in markets:
        t = 0
        for i in range(n):
            t += rng.choice([1, 1, 1, 1, 2, 3, 5, 6, 7, 9])
            out.append((m, "s1" if t < 150 else "s2" if t < 260 else None, T0 + dt.timedelta(minutes=t), float(i), i + 2.0, i - 1.0, i + 0.5 if rng.random() > 0.05 else None, i, rng.choice([7, 7, 7, 7, 8, None]), t < 260, int(T0.timestamp() * 1000) + (150 if t < 150 else 260) * 60_000))
    return out


def gap_filled(spark, rows):
    df = causal.fill_gaps(spark.createDataFrame(rows, BARS), 1, 6)
    return {(r.market, r.ts, r.close, r.volume, r.is_synthetic, r.synthetic_gap_size_minutes) for r in df.collect()}


def streamed(spark, tmp_path, rows, cuts, **settings):
    """The stream's rows, with a stop and a restart after each part of the input."""
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        spark.createDataFrame(rows[a:b], BARS).coalesce(1 + i % 2).write.mode("append").parquet(f"file://{tmp_path}/in")
        source = spark.readStream.schema(BARS).parquet(f"file://{tmp_path}/in")
        ordered.start(holes.filled(source, "10 minutes", 1, 6, **settings), f"file://{tmp_path}/out", f"file://{tmp_path}/marks").awaitTermination()
    return spark.read.parquet(f"file://{tmp_path}/out").withColumn("ts", F.timestamp_millis("at")).collect()


def far(m="Z"):
    """A bar that lets the watermark pass all others."""
    return (m, "s9", T0 + dt.timedelta(days=2), 1.0, 1.0, 1.0, 1.0, 1, 1, True, 0)


def test_holes_equal_the_batch_over_restarts_and_disorder(spark, tmp_path):
    rng = random.Random(3)
    rows = bars(4)
    came = sorted(rows, key=lambda r: (r[2] + dt.timedelta(minutes=rng.randint(0, 8)), r[0]))
    out = streamed(spark, tmp_path, [*came, far()], [30, 31, 100])
    got = [(r.market, r.ts, r.close, r.volume, r.is_synthetic, r.gap_minutes) for r in out if r.market != "Z"]
    assert len(got) == len(set(got)) and set(got) == gap_filled(spark, rows)
    assert sum(r[4] for r in got) > 20


def test_live_holes_follow_the_watermark_and_drop_late_bars(spark, tmp_path):
    minute = lambda t, v=1.0: ("A", "s1", T0 + dt.timedelta(minutes=t), v, v, v, v, 5, 7, True, int(T0.timestamp() * 1000) + 60 * 60_000)
    # the watermark reaches 20: flat bars for 11 to 16, six at most; then a bar for 14 comes too late, one for 40 in time
    parts = [minute(10), minute(30, 3.0), minute(14, 9.0), minute(40, 4.0), far()]
    out = streamed(spark, tmp_path, parts, [2, 4], live=True)
    got = sorted(((r.at - int(T0.timestamp() * 1000)) // 60_000, r.close, r.is_synthetic) for r in out if r.market == "A")
    flat = lambda a, n, v: [(a + k, v, True) for k in range(1, n + 1)]
    assert got == sorted([(10, 1.0, False), *flat(10, 6, 1.0), (30, 3.0, False), *flat(30, 6, 3.0), (40, 4.0, False), *flat(40, 6, 4.0)])


def test_live_holes_end_with_the_session(spark):
    one = processor(holes.Holes, "at_ms long, revision long, open double, high double, low double, close double, volume long, instrument_id long, session_end long, inside_session boolean", step_minutes=1, most_minutes=9, live=True)
    row = {AT: np.array([600_000]), "revision": np.array([0]), **{p: np.array([1.0]) for p in holes.PRICES}, "volume": np.array([3]), "instrument_id": np.array([NONE]), "session_end": np.array([780_000]), "inside_session": np.array([True])}
    out, carry, wake = one.release(row, one.fresh, 600_000)
    assert out["at"].tolist() == [600_000] and wake == 660_000
    nothing = {k: v[:0] for k, v in row.items()}
    out, carry, wake = one.release(nothing, carry, 660_000)
    assert out["at"].tolist() == [660_000] and wake == 720_000 and one.settled(carry) == 660_000
    out, carry, wake = one.release(nothing, carry, 10**9)
    assert out["at"].tolist() == [720_000] and wake is None


def test_revisions_replace_what_waits_and_idle_keys_are_forgotten(spark, tmp_path):
    kept = []

    class Handle:
        def getValueState(self, name, schema):
            return State()

        def registerTimer(self, t):
            kept.append(t)

        def deleteTimer(self, t):
            kept.remove(t)

    class State:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, v):
            self.value = v

        def clear(self):
            self.value = None

    class Echo(ordered.InOrder):
        carried, fresh = "n long", (0,)

        def release(self, rows, carry, now):
            return {"at": rows[AT], "v": rows["v"]}, (carry[0] + len(rows[AT]),), None

    import pandas as pd

    one = Echo(T.StructType([]), T.StructType.fromDDL("at_ms long, revision long, v double"), T.StructType.fromDDL("at long, v double"), 1000)
    one.init(Handle())
    clock = lambda now: type("C", (), {"getCurrentWatermarkInMs": lambda self: now, "getExpiryTimeInMs": lambda self: now})()
    list(one.handleInputRows((), iter([pd.DataFrame({"at_ms": [50, 40, 50], "revision": [0, 0, 2], "v": [1.0, 2.0, 3.0]})]), clock(0)))
    list(one.handleInputRows((), iter([pd.DataFrame({"at_ms": [50, 30], "revision": [1, 0], "v": [9.0, None]})]), clock(0)))
    assert kept == [30]
    kept.clear()
    got = pd.concat(one.handleExpiredTimer((), clock(45), clock(30)))
    assert got["at"].tolist() == [30, 40] and kept == [50] and one.carry.get() == (2,)
    list(one.handleInputRows((), iter([pd.DataFrame({"at_ms": [40, 60], "revision": [5, 0], "v": [7.0, 8.0]})]), clock(45)))
    kept.clear()
    got = pd.concat(one.handleExpiredTimer((), clock(100), clock(50)))
    assert got["v"].tolist() == [3.0, 8.0] and kept == [1060]
    assert pd.concat(one.handleExpiredTimer((), clock(1060), clock(1060))).empty and not one.clock.exists() and not one.carry.exists()


@pytest.mark.parametrize("name", ["stream_gap_fill", "stream_live_fill", "stream_running"])
def test_streams_equal_their_twins(spark, sf_dir, name):
    import duckdb

    from tidemark.plans.catalog import ORACLE, QUERIES

    duck = duckdb.connect()
    duck.execute(f"create view events as select * from '{sf_dir}/events.parquet'")
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    rel = duck.sql(ORACLE[name])
    want = sorted((tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall()), key=repr)
    assert sorted(rel.columns) == cols and got == want
