"""From labelled features to predictions of every fold, and on to the policy."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import argmax3, default
from tidemark.operators import models
from tidemark.sources.staging import stage


@dataclass(frozen=True)
class Model:
    model_id: str
    family: str
    target: str
    alpha: float = 1.0

    @property
    def classifies(self) -> bool:
        return self.family == "logistic"

    @property
    def config_hash(self) -> str:
        return hashlib.sha256(repr((self.model_id, self.family, self.target, self.alpha)).encode()).hexdigest()


#: target of each signal the policy reads
RETURN, DIRECTION, FADE, TREND = "target_ret_15m", "target_sign_with_deadzone", "target_fade_success_15m", "target_trend_danger_30m"
MODELS = (Model("return_ridge", "ridge", RETURN), Model("direction_logistic", "logistic", DIRECTION), Model("fade_logistic", "logistic", FADE), Model("trend_logistic", "logistic", TREND))


def _scaled(rows: DataFrame, features: Sequence[str], specs: Sequence[Model]) -> DataFrame:
    """``rows`` with the statistics of each model's features in their fold (``{model's place}_{feature}__med`` and so on), once for all models.

    A model's are of the training rows that have its target. Rows are written in the order of folds, so a fold's statistics are one run of equal values.
    """
    at = {f"{i}_{f}": (m, f) for i, m in enumerate(specs) for f in features}
    train = rows.where("role = 'train'").select("key", *[F.col(m.target).isNotNull().alias(f"_has{i}") for i, m in enumerate(specs)], *[F.col(f).alias(f) for f in features])
    train = train.withColumns({c: F.col(f) for c, (_, f) in at.items()})
    stats = models.scaling(train, list(at), ["key"], {c: F.col(f"_has{i}") for i, _ in enumerate(specs) for c in at if c.startswith(f"{i}_")})
    return stage(rows.join(stats, "key").sortWithinPartitions("key"), "scaled-rows")


def _fit(rows: DataFrame, features: Sequence[str], model: Model, place: int) -> DataFrame:
    """Test rows of every fold with y_true, y_pred and the probabilities of the model's target; ``rows`` are those of ``_scaled``."""
    rows = rows.withColumn("y", F.col(model.target)).where(F.col("y").isNotNull())
    rows = rows.withColumn("x", models.scaled_array({f"{place}_{f}": f for f in features}))
    x, test = rows.where("role = 'train'").select("key", "x", "y"), rows.where("role = 'test'").withColumn("y_true", F.col("y"))
    none = F.lit(None).cast("double")
    names = ["p_long", "p_short", "p_flat", "p_fade_success", "p_trend_danger"]
    if not model.classifies:
        out = models.predict(test, models.ridge(x, len(features), model.alpha))
        return out.withColumns({n: none for n in names})
    weights, _ = models.classifier(x, len(features), 1.0 / model.alpha)
    out = models.predict_classes(test, weights)
    if model.target == DIRECTION:
        out = out.withColumn("y_pred", default("p_long", 0.0) - default("p_short", 0.0))
        return out.withColumns({n: none for n in names[3:]})
    mine = "p_fade_success" if model.target == FADE else "p_trend_danger"
    out = out.withColumns({"y_pred": F.col("p_long"), mine: F.col("p_long")})
    return out.withColumns({n: none for n in names if n != mine})


#: what predictions keep of a row
KEEP = ["ts", "session_segment_id", "close", "causal_valid", "target_valid", "target_entry_price", "target_exit_price", "target_entry_ts", "target_exit_ts", "minutes_until_session_close"]


def used(rows: DataFrame, features: Sequence[str], specs: Sequence[Model] = MODELS) -> DataFrame:
    """The columns of ``rows`` that folds and ``predictions`` read, written once: folds read them again, and features are costly to make."""
    wanted = ["market", *KEEP, "training_row_valid", "session_id", "split_group", *dict.fromkeys([m.target for m in specs]), *features]
    return stage(rows.select(*[c for c in wanted if c in rows.columns]), "feature-rows")


def predictions(assigned: DataFrame, features: Sequence[str], specs: Sequence[Model] = MODELS) -> DataFrame:
    """One row per test bar, fold and model, in the thirty columns of a prediction table.

    ``assigned`` is labelled features by fold and role (``splits.assign``). What is used of it is written once, and once more with the
    statistics of its folds, which all models and each step of a fit read. A fold without usable training rows has no predictions.
    """
    usable = default("causal_valid", False) & default("target_valid", False) & ((F.col("role") == "test") | ((F.col("role") == "train") & default("training_row_valid", False)))
    assigned = assigned.where(usable).withColumn("key", F.concat_ws("_", "market", F.col("n").cast("string")))
    have = set(assigned.columns)
    rest = {"session_id": F.col("session_id") if "session_id" in have else F.lit(None).cast("string"), "split_group": F.col("split_group") if "split_group" in have else F.lit("research")}
    of_test = [F.when(F.col("role") == "test", F.col(k)).alias(k) for k in (*KEEP, *rest)]  # training rows are only fitted
    targets = [F.col(t).cast("double").alias(t) for t in dict.fromkeys([m.target for m in specs])]
    rows = stage(assigned.withColumns(rest).select("market", "n", "key", "role", *of_test, *targets, *[F.col(f).cast("double").alias(f) for f in features]), "fold-rows")
    rows = _scaled(rows, features, specs)
    feature_hash = hashlib.sha256(",".join(features).encode()).hexdigest()
    out = None
    for i, m in enumerate(specs):
        one = _fit(rows, features, m, i).select(
            "market",
            F.year("ts").alias("year"),
            F.col("n").cast("int").alias("fold_id"),
            F.col("ts").alias("timestamp"),
            "session_id",
            "session_segment_id",
            "split_group",
            F.lit(m.model_id).alias("model_id"),
            F.lit(m.family).alias("model_family"),
            F.lit(m.target).alias("target_name"),
            F.lit("classification_probability" if m.classifies else "regression").alias("prediction_type"),
            "y_true",
            F.col("y_pred").alias("y_pred_raw"),
            F.col("y_pred").alias("y_pred_calibrated"),
            *["p_long", "p_short", "p_flat", "p_fade_success", "p_trend_danger"],
            F.lit("no_calibration").alias("calibration_id"),
            F.lit(m.config_hash).alias("model_config_hash"),
            F.lit(feature_hash).alias("feature_config_hash"),
            F.col("target_entry_price").alias("execution_open"),
            F.col("target_exit_price").alias("execution_close"),
            *["target_valid", "causal_valid", "close", "target_entry_ts", "target_exit_ts", "minutes_until_session_close"],
        )
        out = one if out is None else out.unionByName(one)
    return out


KEYS = ["market", "fold_id", "session_segment_id", "timestamp"]


def to_policy(table: DataFrame) -> DataFrame:
    """One row per bar and fold with the signals under the names the policy reads: one aggregation for all targets."""
    of = lambda target, column, name: F.max(F.when(F.col("target_name") == target, F.col(column))).alias(name)
    return table.groupBy(*KEYS).agg(
        of(RETURN, "y_pred_calibrated", "expected_return"),
        of(DIRECTION, "p_long", "p_long"),
        of(DIRECTION, "p_short", "p_short"),
        of(DIRECTION, "p_flat", "p_flat"),
        of(DIRECTION, "y_true", "y_sign"),
        of(FADE, "p_fade_success", "p_fade"),
        of(TREND, "p_trend_danger", "p_trend"),
        F.max("execution_open").alias("entry_price"),
        F.max("execution_close").alias("exit_price"),
    ).withColumnRenamed("timestamp", "ts")


BY_MODEL = ["model_id", "model_family", "target_name", "market", "fold_id"]


def score() -> Column:
    """What a prediction is measured by: the probability of its target, long less short for the direction, else the calibrated value."""
    target = F.col("target_name")
    edge = default("p_long", 0.0) - default("p_short", 0.0)
    return F.when(target == FADE, F.col("p_fade_success")).when(target == TREND, F.col("p_trend_danger")).when(target == DIRECTION, edge).otherwise(F.col("y_pred_calibrated"))


def comparison(table: DataFrame) -> DataFrame:
    """One row per model, target, market and fold of a prediction table: its scores against what came.

    Errors are of rows that have both. A Brier score needs outcomes of 0 and 1 and scores that are shares; direction accuracy is that of the
    likeliest side, if each side has a probability somewhere in the group. Kinds and hashes are the earliest that are there.
    """
    rows = table.withColumns({"_s": score().cast("double"), "_y": F.col("y_true").cast("double")})
    err = F.col("_s") - F.col("_y")
    shares = F.coalesce(F.min(F.when(err.isNotNull(), F.col("_y").isin(0.0, 1.0) & F.col("_s").between(0.0, 1.0))), F.lit(False))
    sides = (F.count("p_long") > 0) & (F.count("p_short") > 0) & (F.count("p_flat") > 0)
    right = F.when(F.col("_y").isNotNull(), (argmax3("p_short", "p_flat", "p_long") == F.col("_y")).cast("double"))
    first = lambda x: F.min_by(x, F.when(F.col(x).isNotNull(), F.struct("timestamp", x))).alias(x)
    return rows.groupBy(*BY_MODEL).agg(
        F.count("*").alias("row_count"),
        first("prediction_type"),
        F.avg("_s").alias("prediction_mean"), F.stddev_pop("_s").alias("prediction_std"), F.avg("_y").alias("target_mean"), F.stddev_pop("_y").alias("target_std"),
        first("model_config_hash"), first("feature_config_hash"),
        F.array_join(F.array_sort(F.collect_set(F.col("calibration_id").cast("string"))), ",").alias("calibration_ids"),
        F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"),
        F.when(shares, F.avg(err * err)).alias("brier_score"),
        F.when((F.col("target_name") == DIRECTION) & sides, F.avg(right)).alias("direction_accuracy"),
    )
