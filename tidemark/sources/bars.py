"""Bars out of tables that have none: ticks by count, by clock, and from order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.blocks import numbered

#: Which market an event type stands for.
MARKETS = {"click": "ES", "error": "CL", "purchase": "ZN", "signup": "6E", "view": "RTY"}
#: market, tick_size, tick_value, point_value, cost_ticks, min_profit_ticks, min_stop_ticks, slippage_ticks
COSTS = [
    ("ES", 0.25, 12.5, 50.0, 2.0, 4.0, 6.0, 0.5),
    ("CL", 0.01, 10.0, 1000.0, 3.0, 8.0, 10.0, 1.0),
    ("ZN", 0.015625, 15.625, 1000.0, 1.5, 3.0, 4.0, 0.5),
    ("6E", 0.00005, 6.25, 125000.0, 2.5, 5.0, 6.0, 0.5),
    ("RTY", 0.1, 5.0, 50.0, 2.0, 4.0, 6.0, 1.0),
]
COST_COLUMNS = "market string, tick_size double, tick_value double, point_value double, cost_ticks double, min_profit_ticks double, min_stop_ticks double, slippage_ticks double"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def costs(spark: SparkSession) -> DataFrame:
    """One row per market; small by construction."""
    return spark.createDataFrame(COSTS, COST_COLUMNS)


def market_of(event_type: str = "event_type"):
    out = None
    for kind, market in MARKETS.items():
        out = F.when(F.col(event_type) == kind, market) if out is None else out.when(F.col(event_type) == kind, market)
    return out


def tick_bars(spark: SparkSession, sf_dir: str, every: int = 3, segment: int = 150) -> DataFrame:
    """Every ``every`` events of a market are a bar; ``segment`` bars are a session segment. Flags are fixed functions of the bar."""
    ticks = events(spark, sf_dir).select(market_of().alias("market"), "ts", "event_id", (F.col("value") + 100).alias("price"))
    ticks = numbered(ticks, order=("ts", "event_id")).withColumn("nth", F.col("_rn") - 1)
    bars = ticks.groupBy("market", F.floor(F.col("nth") / every).cast("int").alias("bar")).agg(
        F.min("ts").alias("ts"),
        F.min_by("price", "nth").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "nth").alias("close"),
        F.sum(F.col("event_id") % 97 + 1).cast("long").alias("volume"),
    )
    bar = F.col("bar")
    return bars.withColumns(
        {
            "seg": F.floor(bar / segment).cast("int"),
            "session_segment_id": F.concat(F.lit("s"), F.lpad(F.floor(bar / segment).cast("int").cast("string"), 5, "0")),
            "causal_valid": bar % 41 != 17,
            "is_synthetic": bar % 211 == 7,
            "roll_boundary_flag": (bar % 150 == 0) & (bar > 0),
            "roll_window_flag": (bar > 0) & ((bar % 150 < 3) | (bar % 150 > 147)),
            "boundary_session_flag": bar < 5,
        }
    )


def clock_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars by market; the contract changes every ten days."""
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp_ntz")).cast("timestamp_ntz")
    ticks = events(spark, sf_dir).select(market_of().alias("market"), hour.alias("hour"), "ts", "event_id", (F.col("value") + 100).alias("price"))
    bars = ticks.groupBy("market", F.col("hour").alias("ts")).agg(
        F.min_by("price", F.struct("ts", "event_id")).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", F.struct("ts", "event_id")).alias("close"),
        F.count("*").alias("volume"),
    )
    return bars.withColumn("instrument_id", (F.floor((F.dayofmonth("ts") - 1) / 10) + 100).cast("int"))


def line_bars(spark: SparkSession, sf_dir: str, every: int = 10, segment: int = 400) -> DataFrame:
    """A heavier load: order lines in order of shipping, 31 markets."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    market = F.concat(F.lit("M"), (F.col("l_suppkey") % 31).cast("string"))
    nth = F.row_number().over(Window.partitionBy("market").orderBy("l_shipdate", "l_orderkey", "l_linenumber")) - 1
    ticks = lines.select(market.alias("market"), "l_shipdate", "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_quantity").withColumn("nth", nth)
    bars = ticks.groupBy("market", F.floor(F.col("nth") / every).cast("int").alias("bar")).agg(
        F.min_by("price", "nth").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "nth").alias("close"),
        F.sum("l_quantity").cast("long").alias("volume"),
    )
    seg = F.floor(F.col("bar") / segment).cast("int")
    return bars.withColumns({"ts": F.col("bar"), "seg": seg, "session_segment_id": F.concat(F.lit("s"), F.lpad(seg.cast("string"), 5, "0")), "causal_valid": F.col("bar") % 41 != 17})


def predictions(bars: DataFrame) -> DataFrame:
    """A wide frame of deterministic model outputs per bar: whole-number arithmetic on the bar."""
    b = F.col("bar").cast("long")  # bars are whole numbers of 32 bits: products with them are not
    p = lambda a, m: (F.pmod(b * a + F.length("market"), F.lit(m)) / float(m))
    return bars.select(
        "market",
        "bar",
        "ts",
        F.pmod(F.floor(b / 60), F.lit(5)).cast("int").alias("fold_id"),
        F.col("session_segment_id").alias("session_id"),
        p(7919, 1000).alias("p_long"),
        p(6271, 1000).alias("p_short"),
        p(3571, 500).alias("p_flat"),
        F.when(b % 29 != 3, p(2203, 1000)).alias("p_fade"),
        F.when(b % 31 != 4, p(4409, 1000)).alias("p_trend"),
        ((p(5113, 1000) - 0.5) / 100).alias("expected_return"),
        F.col("open").alias("entry_price"),
        F.col("close").alias("exit_price"),
        (F.pmod(b * 13, F.lit(3)) - 1).cast("int").alias("y_sign"),
    )
