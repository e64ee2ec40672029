"""A table is replaced as a whole or stays as it was."""

import pytest
from pyspark.sql import functions as F

from tidemark.sources import tables


def test_publish_replaces_or_keeps(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = lambda n: spark.range(n).withColumn("ok", F.lit(True))
    tables.publish(rows(5), path)
    tables.publish(rows(9), path, ~F.col("ok"))
    assert spark.read.parquet(path).count() == 9
    with pytest.raises(ValueError):
        tables.publish(rows(3).withColumn("ok", F.col("id") > 0), path, ~F.col("ok"))
    assert spark.read.parquet(path).count() == 9 and [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["t"]


def test_a_table_can_be_published_over_its_own_source(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    tables.publish(spark.range(6), path)
    tables.publish(spark.read.parquet(path).where("id % 2 = 0"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 2, 4]


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    tables.publish(spark.range(4), path)
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        tables.publish(spark.range(4).withColumn("id", F.expr("id div (id - id)").cast("long")), path)
    assert spark.read.parquet(path).count() == 4 and [p.name for p in tmp_path.iterdir()] == ["t"]
