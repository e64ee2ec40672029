"""Models compared by target, market and fold, against a model row by row."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import walkforward as wf
from tidemark.plans import research_queries as rq
from tidemark.plans.catalog import QUERIES

MEASURES = ["prediction_mean", "prediction_std", "target_mean", "target_std", "mse", "mae", "brier_score", "direction_accuracy"]
SCHEMA = "model_id string, model_family string, target_name string, market string, fold_id int, timestamp int, prediction_type string, y_true double, y_pred_calibrated double, p_long double, p_short double, p_flat double, p_fade_success double, p_trend_danger double, calibration_id string, model_config_hash string, feature_config_hash string"


def mean(xs):
    return sum(xs) / len(xs) if xs else None


def std(xs):
    return math.sqrt(mean([(x - mean(xs)) ** 2 for x in xs])) if xs else None


def compare(rows):
    """What the reference does with each group, in plain Python."""
    groups = {}
    for r in rows:
        groups.setdefault(tuple(r[k] for k in wf.BY_MODEL), []).append(r)
    out = {}
    for key, group in groups.items():
        target = key[2]
        if target == wf.DIRECTION:
            scores = [(r["p_long"] or 0.0) - (r["p_short"] or 0.0) for r in group]
        else:
            scores = [r[{wf.FADE: "p_fade_success", wf.TREND: "p_trend_danger"}.get(target, "y_pred_calibrated")] for r in group]
        ys = [r["y_true"] for r in group]
        s, y = [x for x in scores if x is not None], [x for x in ys if x is not None]
        both = [(a, b) for a, b in zip(scores, ys, strict=True) if a is not None and b is not None]
        mse = mean([(a - b) ** 2 for a, b in both])
        one = {"row_count": len(group), "prediction_mean": mean(s), "prediction_std": std(s), "target_mean": mean(y), "target_std": std(y), "mse": mse, "mae": mean([abs(a - b) for a, b in both])}
        one["brier_score"] = mse if both and all(b in (0, 1) and 0 <= a <= 1 for a, b in both) else None
        sides = ["p_short", "p_flat", "p_long"]
        one["direction_accuracy"] = None
        if target == wf.DIRECTION and all(any(r[k] is not None for r in group) for k in sides) and y:
            hits = []
            for r in group:
                values = [-math.inf if r[k] is None else r[k] for k in sides]
                if r["y_true"] is not None:
                    hits.append(values.index(max(values)) - 1 == r["y_true"])
            one["direction_accuracy"] = mean(hits)
        for k in ("prediction_type", "model_config_hash", "feature_config_hash"):
            one[k] = next((r[k] for r in sorted(group, key=lambda r: r["timestamp"]) if r[k] is not None), None)
        one["calibration_ids"] = ",".join(sorted({r["calibration_id"] for r in group if r["calibration_id"] is not None}))
        out[key] = one
    return out


def check(got, want):
    assert len(got) == len(want)
    for r in got:
        one = want[tuple(r[k] for k in wf.BY_MODEL)]
        assert set(r.asDict()) == {*one, *wf.BY_MODEL}
        for k, v in one.items():
            assert r[k] == (pytest.approx(v, abs=1e-9) if k in MEASURES and v is not None else v), (one, k)


def table(n=900):
    rng = random.Random(3)
    share = lambda: None if rng.random() < 0.2 else rng.randrange(11) / 10
    rows = []
    for i in range(n):
        target, fold, market = rng.choice([wf.RETURN, wf.DIRECTION, wf.FADE, wf.TREND]), rng.randrange(5), rng.choice(["ES", "CL", None])
        y = {wf.RETURN: rng.uniform(-1, 1), wf.DIRECTION: rng.choice([-1, 0, 1]), wf.FADE: rng.choice([0, 1]), wf.TREND: rng.choice([0, 1, 2] if fold == 2 else [0, 1])}[target]
        y = None if rng.random() < 0.1 or fold == 4 else float(y)
        sides = [share(), share(), None if fold == 3 else share()] if target == wf.DIRECTION else [None] * 3
        late = rng.choice([None, "b", "a", "no_calibration"]) if i > n // 2 else None
        rows.append((
            f"m_{target}", None if market == "CL" else "f", target, market, fold, i, None if fold == 1 else late, y, rng.uniform(-1, 1) if target == wf.RETURN else None, *sides,
            share() if target == wf.FADE else None, rng.uniform(0, 1.2) if target == wf.TREND and fold == 1 else share() if target == wf.TREND else None, late, None if fold == 1 else f"h{i}", "g",
        ))
    return rows


def test_odd_tables_equal_the_model(spark):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    rows = [dict(zip(names, r, strict=True)) for r in table()]
    want = compare(rows)
    # every rule has groups on both sides
    assert all({v[k] is None for v in want.values()} == {True, False} for k in ("mse", "brier_score", "direction_accuracy", "prediction_type", "model_config_hash"))
    check(wf.comparison(spark.createDataFrame(table(), SCHEMA)).collect(), want)
    assert wf.comparison(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_has_every_model_and_target(spark, sf_dir):
    got = QUERIES["agg_model_comparison"](spark, sf_dir).collect()
    wide = rq.preds(spark, sf_dir).collect()
    assert {tuple(r[k] for k in wf.BY_MODEL) for r in got} == {(m.model_id, m.family, m.target, *at) for m in wf.MODELS for at in {(p.market, p.fold_id) for p in wide}}
    assert sum(r.row_count for r in got) == 4 * len(wide)
    for r in got:
        assert r.mse is not None and r.mae is not None and r.calibration_ids == "no_calibration"
        assert (r.brier_score == r.mse) == (r.target_name in (wf.FADE, wf.TREND)) and (r.direction_accuracy is None) == (r.target_name != wf.DIRECTION)


def test_query_table_equals_the_model(spark, sf_dir):
    long_ = rq.prediction_table(spark, sf_dir)
    check(wf.comparison(long_).collect(), compare([r.asDict() for r in long_.withColumn("timestamp", F.col("timestamp").cast("string")).collect()]))
