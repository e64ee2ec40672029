"""Predictions taken apart: parts add up, ranges are those of training, extremes are the largest."""

import numpy as np
import pytest

from tidemark.operators import models, replay


def test_contributions_add_up_and_flag_what_training_never_saw(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        a, b = rng.normal(), rng.normal() * 3
        role = "train" if i % 3 else "test"
        if role == "test" and i % 30 == 0:
            a = 50.0 if i % 60 else -40.0
        rows.append(("k1" if i % 2 else "k2", i, role, float(a), None if i % 41 == 0 else float(b), float(2 * a - b + rng.normal())))
    df = spark.createDataFrame(rows, "key string, bar int, role string, a double, b double, y double")
    train = df.where("role = 'train'")
    scaled = models.scaled(df, models.scaling(train, ["a", "b"], ["key"]), ["a", "b"], ["key"])
    w = models.ridge(scaled.where("role = 'train'"), 2)
    predicted = models.predict(scaled.where("role = 'test'"), w)
    extreme = replay.outliers(predicted, 4)
    got = extreme.collect()
    every = {k: sorted((r for r in predicted.collect() if r.key == k), key=lambda r: (-abs(r.y_pred), r.bar))[:4] for k in ("k1", "k2")}
    assert {(r.key, r.nth, r.bar) for r in got} == {(k, n, r.bar) for k, rs in every.items() for n, r in enumerate(rs, 1)}
    parts = replay.contributions(extreme, w, replay.training_ranges(train, ["a", "b"]), ["a", "b"])
    seen = parts.collect()
    assert len(seen) == 16 and all(r.agrees and r.rebuilt == pytest.approx(r.y_pred) for r in replay.reconciled(parts).collect())
    of = {k: [x for x in rows if x[0] == k and x[2] == "train"] for k in ("k1", "k2")}
    for r in seen:
        known = [x[3 if r.feature == "a" else 4] for x in of[r.key]]
        known = [x for x in known if x is not None]
        assert r.outside == (r.value is not None and not min(known) <= r.value <= max(known))
        assert 0 <= r.share <= 1 and r.added == pytest.approx(r.scaled * r.weight)
    assert any(r.outside and r.feature == "a" for r in seen)
    assert replay.contributions(extreme.limit(0), w, replay.training_ranges(train, ["a", "b"]), ["a", "b"]).count() == 0
