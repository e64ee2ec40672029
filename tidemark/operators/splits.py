"""Walk-forward folds with purge and embargo."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.blocks import numbered
from tidemark.functions.scalars import default


@dataclass(frozen=True)
class Windows:
    train_days: int
    test_days: int
    step_days: int
    purge_rows: int = 16


PROFILES = {"smoke": Windows(90, 15, 15), "recent": Windows(365, 30, 30), "long": Windows(730, 30, 30)}


def policy_problems(policy: dict) -> list[str]:
    """What a split policy gets wrong; purging covers the entry lag and the horizon."""
    out = []
    if policy.get("random_splits"):
        out.append("random_splits")
    if policy.get("holdout_tuning"):
        out.append("holdout_tuning")
    if policy.get("purge_bars") != (policy.get("entry_lag_bars") or 0) + (policy.get("target_horizon_bars") or 0):
        out.append("purge_bars")
    return out


def split_group(year: int, holdout: set[int], forward: set[int], restricted: bool = False) -> str:
    if year in holdout and year in forward:
        return "invalid"
    if year in holdout:
        return "final_holdout"
    if year in forward:
        return "forward"
    return "restricted" if restricted else "research"


def eligible(df: DataFrame) -> DataFrame:
    """Rows that may train: by the strictest flags that the table has."""
    have = set(df.columns)
    if "training_row_valid" in have:
        flag = default("training_row_valid", False)
    elif {"target_valid", "feature_input_valid"} <= have:
        flag = default("target_valid", False) & default("feature_input_valid", False)
    elif "target_valid" in have:
        flag = default("target_valid", False)
    else:
        flag = F.lit(True)
    return df.withColumn("eligible", flag)


def fold_starts(rows: DataFrame, w: Windows) -> DataFrame:
    """(market, n, train_start, test_start, test_end) while a whole test fits; one row per fold."""
    span = rows.groupBy("market").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    steps = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.timestamp_diff("SECOND", F.col("first"), F.col("last")) / 86400 - w.train_days - w.test_days) / w.step_days)).cast("int"))
    day = lambda n, ts: F.timestamp_add("DAY", n, ts)
    out = span.withColumn("n", F.explode(steps))
    out = out.withColumn("test_start", day(F.lit(w.train_days) + F.col("n") * w.step_days, F.col("first")))
    out = out.withColumns({"train_start": day(F.lit(-w.train_days), F.col("test_start")), "test_end": day(F.lit(w.test_days), F.col("test_start"))})
    return out.where(F.col("test_end") <= F.col("last")).drop("first", "last")


def assign(rows: DataFrame, w: Windows, tie: Sequence[str] = ()) -> DataFrame:
    """Rows by fold and role: train, purged or test; rows of equal times go by ``tie``. Folds are cut into days, so the join is on equality.

    The last row before a test is found from the rows' numbers alone, so whole rows are shuffled before they are copied into folds.
    """
    rows = numbered(rows, order=("ts", *tie)).withColumn("_day", F.to_date("ts"))
    folds = fold_starts(rows, w)
    by_day = lambda df: df.withColumn("_day", F.explode(F.sequence(F.to_date("train_start"), F.to_date("test_end"))))
    trained = (F.col("ts") >= F.col("train_start")) & (F.col("ts") < F.col("test_start"))
    last = rows.select("market", "_day", "ts", "_rn").join(by_day(folds), ["market", "_day"]).where(trained).groupBy("market", "n").agg(F.max("_rn").alias("_before"))
    both = rows.join(by_day(folds.join(last, ["market", "n"], "left")), ["market", "_day"]).where((F.col("ts") >= F.col("train_start")) & (F.col("ts") < F.col("test_end")))
    role = F.when(F.col("ts") >= F.col("test_start"), "test").when(F.col("_rn") > F.col("_before") - w.purge_rows, "purged").otherwise("train")
    return both.withColumn("role", role).drop("_rn", "_day", "_before")


def plan(rows: DataFrame, w: Windows, tie: Sequence[str] = ()) -> DataFrame:
    """One row per fold that has training and test rows, numbered without gaps. Rows need ``eligible``."""
    a = assign(rows, w, tie)
    n = lambda role: F.count_if((F.col("role") == role) & F.col("eligible"))
    out = a.groupBy("market", "n", "train_start", "test_start", "test_end").agg(
        n("train").alias("n_train"),
        F.count_if(F.col("role") == "purged").alias("n_purged"),
        n("test").alias("n_test"),
        F.max(F.when(F.col("role") == "train", F.col("ts"))).alias("purged_train_end"),
    )
    out = out.where("n_train > 0 and n_test > 0")
    return out.withColumn("fold", F.row_number().over(Window.partitionBy("market").orderBy("n"))).drop("n")


def overlap_guard(assigned: DataFrame) -> DataFrame:
    """Folds whose last training row is not before their first test row."""
    ends = assigned.groupBy("market", "n").agg(F.max(F.when(F.col("role") == "train", F.col("ts"))).alias("a"), F.min(F.when(F.col("role") == "test", F.col("ts"))).alias("b"))
    return ends.where(F.col("a") >= F.col("b")).select("market", "n")


def missing_folds(plan_: DataFrame, found: DataFrame) -> DataFrame:
    """Planned (market, fold) without predictions."""
    return plan_.select("market", "fold").exceptAll(found.select("market", "fold").distinct())
