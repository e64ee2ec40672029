"""Two-level windows against windows over whole markets, and that no plan orders the bars of a whole market."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.blocks import carried, numbered, over_blocks
from tidemark.functions.windows import Bars
from tidemark.operators import backtest, causal, labels

SCHEMA = "market string, ts timestamp_ntz, x long, y double, s string"


def rows(seed, n=260, markets=("A", "B", "C")):
    """Most bars are A's; days are empty, short or long."""
    rng, out = random.Random(seed), {}
    for _ in range(n):
        m = rng.choice(markets + markets[:1] * 4)
        t = dt.datetime(2024, 1, rng.choice([1, 2, 2, 2, 2, 5, 6, 20]), rng.randint(0, 23), rng.randint(0, 59))
        out[m, t] = (m, t, rng.choice([None, *range(-5, 9)]), rng.choice([None, rng.random()]), rng.choice(["p", "q"]))
    return list(out.values())


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(rows(1), SCHEMA)


def test_carried_columns_equal_windows_over_the_market(frame):
    got = carried(frame, {"a": ("sum", F.col("x")), "b": ("max", F.col("x")), "c": ("last", F.col("x")), "d": ("next", F.col("x")), "e": ("lag", F.col("x"))})
    w = Window.partitionBy("market").orderBy("ts")
    run, rest = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    want = frame.withColumns({"a": F.sum("x").over(run), "b": F.max("x").over(run), "c": F.last("x", True).over(run), "d": F.first("x", True).over(rest), "e": F.lag("x").over(w)})
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert carried(frame.limit(0), {"a": ("sum", F.col("x"))}).count() == 0
    with pytest.raises(ValueError):
        carried(frame, {"a": ("median", F.col("x"))})


def test_numbers_by_another_order_and_bucket(frame):
    got = numbered(frame.where("y is not null"), ("market", "s"), ("y", "ts"), F.floor(F.col("y") * 5))
    want = frame.where("y is not null").withColumn("_rn", F.row_number().over(Window.partitionBy("market", "s").orderBy("y", "ts")).cast("long"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


@pytest.mark.parametrize("size", [7, 8, 64, 8192])
def test_blocks_see_across_their_borders(frame, size):
    def add(df, b):
        df = df.withColumn("back", b.lag("x", 7))
        return df.withColumns({"sum": F.sum("x").over(b.back(5)), "ahead": b.lead("x", 6), "most": b.future("y", 7, F.max), "hit": b.first_hit("x", F.lit(5), 7), "same": b.future_same("s", 3)})

    got, want = over_blocks(frame, add, 7, 7, size=size), add(frame, Bars(("market",)))
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_a_bar_that_is_missing_at_a_border_moves_it(spark):
    every = rows(2)
    for gone in range(0, 40, 9):
        df = spark.createDataFrame(every[:gone] + every[gone + 1 :], SCHEMA)
        lead = lambda d, b: d.withColumn("v", b.lead("x", 2))
        assert sorted(map(tuple, over_blocks(df, lead, 0, 2, size=5).collect()), key=repr) == sorted(map(tuple, lead(df, Bars(("market",))).collect()), key=repr)


def test_halos_are_no_wider_than_blocks(frame):
    with pytest.raises(ValueError):
        over_blocks(frame, lambda d, b: d, 9, 0, size=8)


def test_no_plan_orders_the_bars_of_a_whole_market(spark, sf_dir):
    from tidemark.plans.domain_queries import minute_bars, raw_clock
    from tidemark.plans.research_queries import ran
    from tidemark.plans.catalog import QUERIES

    plans = {
        "labels": labels.add_labels(minute_bars(spark, sf_dir)),
        "causal": causal.build(raw_clock(spark, sf_dir), causal.Calendar()),
        "backtest": backtest.running_equity(ran(spark, sf_dir), "net"),
        **{n: QUERIES[n](spark, sf_dir) for n in ("win_lead_ungrouped", "win_roll_distance", "win_segment_number", "win_cum_equity", "target_valid", "win_atr_60")},
    }
    for name, df in plans.items():
        text = df._jdf.queryExecution().optimizedPlan().toString()
        assert not [x for x in re.findall(r"windowspecdefinition\(market#\d+, (\w+)#\d+\w* ASC", text) if x not in ("_bucket", "_day")], name


def test_no_frame_runs_to_the_end_of_its_partition_row_by_row(frame):
    """Such a frame is gone through anew for each row, so a day's work would grow with its square."""
    plan = carried(frame, {"c": ("last", F.col("x")), "d": ("next", F.col("x"))})._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedfollowing" not in plan.lower()
