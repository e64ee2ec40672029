"""Plans of costly steps: folds and fits."""

import re

from pyspark.sql import functions as F

from tidemark.operators import models, splits


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_are_not_shuffled_after_they_are_copied_into_folds(spark):
    rows = spark.range(0, 20_000, 7).select(F.lit("ES").alias("market"), F.timestamp_add("MINUTE", "id", F.lit("2024-01-01").cast("timestamp_ntz")).alias("ts"))
    out = splits.assign(rows, splits.Windows(5, 2, 2, 3))
    assert not re.search(r"windowspecdefinition\(market#\d+, n#\d+", _plan(out))
    got = {(r.n, r.role): r for r in out.groupBy("n", "role").agg(F.count("*").alias("k"), F.min("ts").alias("a"), F.max("ts").alias("b")).collect()}
    for n in {n for n, _ in got}:
        assert got[n, "purged"].k == 3 and got[n, "train"].b < got[n, "purged"].a and got[n, "purged"].b < got[n, "test"].a


def test_rows_of_equal_times_are_purged_by_bar(spark):
    at = F.timestamp_add("MINUTE", (F.floor(F.col("id") / 40) * 40).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"))
    rows = spark.range(0, 20_000).select(F.lit("ES").alias("market"), F.col("id").alias("bar"), at.alias("ts")).orderBy(F.desc("bar")).coalesce(1)
    out = splits.assign(rows, splits.Windows(5, 2, 2, 3), ["bar"])
    for r in out.groupBy("n").agg(F.max(F.when(F.col("role") == "train", F.col("bar"))).alias("train"), F.sort_array(F.collect_list(F.when(F.col("role") == "purged", F.col("bar")))).alias("purged"), F.min(F.when(F.col("role") == "test", F.col("bar"))).alias("test")).collect():
        assert r.purged == [r.test - 3, r.test - 2, r.test - 1] and r.train == r.test - 4


def test_sums_of_folds_are_shuffled_once(spark):
    rows = spark.range(100).select(F.concat(F.lit("k"), (F.col("id") % 5).cast("string")).alias("key"), F.array(F.col("id") * 1.0).alias("x"), F.col("id").alias("y"))
    sums = models._sums(rows, lambda w, x, y: x.sum(axis=0)).groupBy("key").agg(F.sum("v").alias("v"))
    assert sums._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {r.key: r.v for r in sums.collect()} == {f"k{i}": float(sum(range(i, 100, 5))) for i in range(5)}


def test_scaling_of_columns_with_rows_of_their_own(spark):
    df = spark.createDataFrame([("k", 1.0, True), ("k", None, True), ("k", 5.0, True), ("k", 100.0, False)], "key string, x double, has boolean")
    both = df.withColumn("all", F.col("x"))
    r = models.scaling(both, ["x", "all"], ["key"], {"x": F.col("has")}).first()
    alone = models.scaling(df.where("has"), ["x"], ["key"]).first()
    assert [r[f"x__{k}"] for k in ("med", "mean", "std")] == [alone[f"x__{k}"] for k in ("med", "mean", "std")] and r["all__med"] == 5.0
