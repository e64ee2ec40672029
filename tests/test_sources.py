"""Derived tables far beyond the sizes of the tests."""

from pyspark.sql import functions as F

from tidemark.sources import bars


def test_predictions_of_markets_of_millions_of_bars(spark):
    """Products of a bar pass 32 bits from the 271,177th bar on."""
    far = [0, 271_176, 271_177, 400_000, 3_000_000]
    rows = spark.createDataFrame([("ES", b, "s", 1.0, 2.0) for b in far], "market string, bar int, session_segment_id string, open double, close double")
    got = {r.bar: r for r in bars.predictions(rows.withColumn("ts", F.lit(0))).collect()}
    for b in far:
        assert got[b].p_long == (b * 7919 + 2) % 1000 / 1000 and got[b].p_flat == (b * 3571 + 2) % 500 / 500
        assert got[b].fold_id == b // 60 % 5 and got[b].y_sign == b * 13 % 3 - 1
        assert got[b].expected_return == ((b * 5113 + 2) % 1000 / 1000 - 0.5) / 100


def test_a_table_of_many_files_is_discovered_once(spark, tmp_path):
    from tidemark.plans.basic_queries import src_discover

    spark.range(9).repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(1).toPandas().to_parquet(tmp_path / "orders.parquet")
    assert sorted(r.stem for r in src_discover(spark, str(tmp_path)).collect()) == ["events", "orders"]
