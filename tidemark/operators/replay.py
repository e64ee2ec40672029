"""Why a refitted linear model says what it says of its extreme rows: a prediction taken apart by feature."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def outliers(predicted: DataFrame, most: int, by: Sequence[str] = ("key",), tie: Sequence[str] = ("bar",)) -> DataFrame:
    """The ``most`` rows of each group whose prediction is largest either way, numbered from 1; each task keeps no more of a group than that."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.abs("y_pred").desc(), *tie))
    return predicted.withColumn("nth", nth).where(F.col("nth") <= most)


def training_ranges(train: DataFrame, features: Sequence[str], by: Sequence[str] = ("key",)) -> DataFrame:
    """(by, ranges): least and greatest value of each feature in training, in the order of ``features``; NULL where it has none."""
    return train.groupBy(*by).agg(F.array(*[F.struct(F.min(F.col(f).cast("double")).alias("least"), F.max(F.col(f).cast("double")).alias("most")) for f in features]).alias("ranges"))


def contributions(rows: DataFrame, weights: DataFrame, ranges: DataFrame, features: Sequence[str], by: Sequence[str] = ("key",)) -> DataFrame:
    """One row per row and feature: its value, its scaled value, weight, what it adds to the prediction and its share of all that is added.

    ``rows`` has the features and x, their scaled values; ``weights`` (key, w) has the intercept last. What is added sums to the prediction
    less the intercept. ``outside``: the value lies beyond the training range; a missing value, which was filled, does not.
    """
    wide = rows.join(weights.select(*by, "w"), list(by)).join(ranges, list(by))
    parts = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"), F.col("x")[i].alias("scaled"), F.col("w")[i].alias("weight"), F.col("ranges")[i].alias("range")) for i, f in enumerate(features)]
    size = F.aggregate(F.zip_with("x", F.slice("w", 1, len(features)), lambda a, b: F.abs(a * b)), F.lit(0.0), lambda s, v: s + v)
    long = wide.withColumns({"intercept": F.element_at("w", -1), "_size": size}).withColumn("_part", F.explode(F.array(*parts))).drop(*[f for f in features if f not in by], "x", "w", "ranges")
    part = lambda n: F.col(f"_part.{n}")
    added = part("scaled") * part("weight")
    outside = F.coalesce((part("value") < part("range.least")) | (part("value") > part("range.most")), F.lit(False))
    return long.withColumns({"feature": part("feature"), "value": part("value"), "scaled": part("scaled"), "weight": part("weight"), "added": added, "share": F.abs(added) / F.when(F.col("_size") > 0, F.col("_size")), "outside": outside}).drop("_part", "_size")


def reconciled(parts: DataFrame, tolerance: float = 1e-9, by: Sequence[str] = ("key", "bar")) -> DataFrame:
    """(by, y_pred, rebuilt, agrees): the prediction, and what intercept and contributions add up to."""
    out = parts.groupBy(*by).agg(F.max("y_pred").alias("y_pred"), (F.max("intercept") + F.sum("added")).alias("rebuilt"))
    return out.withColumn("agrees", F.abs(F.col("y_pred") - F.col("rebuilt")) <= tolerance * F.greatest(F.lit(1.0), F.abs("y_pred")))
