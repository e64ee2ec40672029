"""Signals to positions, fills, marks and equity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.blocks import carried, day

CAPITAL = 100_000.0


def running_equity(df: DataFrame, pnl: str, capital: float = CAPITAL, order: tuple[str, ...] = ("market", "ts")) -> DataFrame:
    """Equity and drawdown in the global order (market, then time).

    The order is global, the work is not: each day of a market is summed by itself, and the totals of the days before it
    and of the markets before, one small row each, are added. The running maximum goes the same way.
    """
    head, rest = order[0], order[1:]
    df = df.withColumn("_day", day(df, rest[0]))
    w = Window.partitionBy(head, "_day").orderBy(*rest).rowsBetween(Window.unboundedPreceding, 0)
    own = df.withColumn("_own", F.sum(pnl).over(w)).withColumn("_top", F.max("_own").over(w))
    # one row a day and market from here to the join
    days = own.groupBy(head, "_day").agg(F.sum(pnl).alias("_sum"), F.max("_own").alias("_peak"))
    earlier = Window.partitionBy(head).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_base", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0))).withColumn("_reached", F.col("_base") + F.col("_peak"))
    days = days.withColumn("_high", F.max("_reached").over(earlier))
    before = Window.orderBy(head).rowsBetween(Window.unboundedPreceding, -1)
    markets = days.groupBy(head).agg(F.sum("_sum").alias("_sum"), F.max("_reached").alias("_reached"))
    markets = markets.withColumn("_market", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)))
    markets = markets.withColumn("_market_high", F.max(F.col("_market") + F.col("_reached")).over(before)).select(head, "_market", "_market_high")
    out = own.join(days.select(head, "_day", "_base", "_high"), [head, "_day"]).join(markets, head)
    start = F.col("_market") + F.col("_base")
    out = out.withColumn("equity", capital + start + F.col("_own"))
    peak = F.greatest(start + F.col("_top"), F.col("_market") + F.col("_high"), F.col("_market_high"))
    return out.withColumn("drawdown", F.col("equity") - (capital + peak)).drop("_day", "_own", "_top", "_base", "_high", "_market", "_market_high")


def desired_positions(df: DataFrame, max_position: int = 1, flat_at_end: bool = True) -> DataFrame:
    """Sign of the signal times the size allowed; the last row of a session goes flat."""
    want = F.signum("signal") * max_position
    if flat_at_end:
        last = F.lead("ts").over(Window.partitionBy("market", "session_id").orderBy("ts")).isNull()
        want = F.when(last, 0.0).otherwise(want)
    return df.withColumn("desired", F.coalesce(want, F.lit(0.0)))


def run(df: DataFrame) -> DataFrame:
    """Per row: order, fill price, commission, slippage, gross and net. Needs desired, mark, and the market's contract terms."""
    out = carried(df, {"prev_position": ("lag", F.col("desired")), "prev_mark": ("lag", F.col("mark"))})
    out = out.withColumn("prev_position", F.coalesce("prev_position", F.lit(0.0)))
    out = out.withColumn("order_qty", F.col("desired") - F.col("prev_position"))
    size = F.abs("order_qty")
    return out.withColumns(
        {
            "fill_price": F.col("mark") + F.signum("order_qty") * F.col("slippage_ticks") * F.col("tick_size"),
            "commission": size * F.col("commission_per_contract"),
            "slippage": size * F.col("slippage_ticks") * F.col("tick_value"),
            "gross": F.coalesce(F.col("prev_position") * (F.col("mark") - F.col("prev_mark")) * F.col("point_value"), F.lit(0.0)),
        }
    ).withColumn("net", F.col("gross") - F.col("commission") - F.col("slippage"))


def fills(ran: DataFrame) -> DataFrame:
    return ran.where(F.col("order_qty") != 0)


def metrics(ran: DataFrame, capital: float = CAPITAL) -> DataFrame:
    """One row of totals."""
    eq = running_equity(ran, "net", capital)
    return eq.agg(
        F.count("*").alias("n_rows"),
        F.sum((F.col("order_qty") != 0).cast("int")).cast("long").alias("n_fills"),
        F.sum(F.abs("order_qty")).alias("turnover"),
        F.sum("gross").alias("gross"),
        F.sum("commission").alias("commission"),
        F.sum("slippage").alias("slippage"),
        F.sum("net").alias("net"),
        F.min("drawdown").alias("max_drawdown"),
        (F.lit(capital) + F.sum("net")).alias("ending_equity"),
        F.sum((F.col("net") > 0).cast("int")).cast("long").alias("winning_rows"),
        F.sum((F.col("net") < 0).cast("int")).cast("long").alias("losing_rows"),
    )
