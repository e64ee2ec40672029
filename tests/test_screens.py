"""Screens over many columns read rows that are costly to make once."""

from pyspark.sql import functions as F

from tidemark.operators import screens


def test_shift_reads_its_rows_once(spark):
    made = F.udf(lambda v: float(v), "double")
    df = spark.range(20).select((F.col("id") % 2 == 0).alias("traded"), made("id").alias("a"))
    out = screens.feature_shift(df, ["a"])
    assert "<lambda>" not in out._jdf.queryExecution().optimizedPlan().toString()
    r = out.first()
    assert (r.n, r.n_traded, r["mean"], r.mean_traded) == (20, 10, 9.5, 9.0)
