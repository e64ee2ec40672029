"""Plans of costly steps: screens of features."""

from tidemark.operators import features, screens
from tidemark.plans.domain_queries import minute_bars


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_masks_and_counts_of_flags_do_not_slide(spark, sf_dir):
    plan = _plan(features.add_base(minute_bars(spark, sf_dir)))
    assert "RowFrame, -119" not in plan and "specifiedwindowframe(RowFrame, -59" in plan


def test_missing_values_are_counted_without_a_copy_by_column(spark):
    df = spark.createDataFrame([(1.0, None, 2), (None, None, 3), (4.0, None, 5)], "a double, `b.c` double, d int")
    out = screens.null_rates(df, ["a", "b.c", "d"])
    assert "Expand" not in _plan(out)
    assert {tuple(r) for r in out.collect()} == {("a", 3, 1, 1 / 3, False), ("b.c", 3, 3, 1.0, True), ("d", 3, 0, 0.0, False)}
    assert screens.null_rates(df.limit(0), ["a"]).count() == 0
