"""Tail risk of a mean-reversion overlay: what it trades, what the trend gate blocks, and how bad losses get.

``overlay`` puts the overlay on a policy frame; ``summary`` measures any grouping of it for either scenario, with the means
of the worst trades and the longest run of losing ones. Runs merge across blocks: of a month of one (market, fold) only four
numbers are kept (trades, losing ones at its begin and at its end, its longest run), and they chain in order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.blocks import numbered
from tidemark.functions.scalars import default
from tidemark.operators.metrics import cvar
from tidemark.operators.ranks import with_decile
from tidemark.sources.staging import stage


@dataclass(frozen=True)
class Gates:
    """``buffer`` and ``escape_edge`` in money: beyond the cost, and beyond that for a blocked trade to be taken all the same."""

    fade: float = 0.50
    trend: float = 0.50
    buffer: float = 0.0
    escape: bool = False
    escape_edge: float = 0.0


#: What a scenario trades.
POSITIONS = {"no_trend_danger_block": "free_position", "mr_tail_overlay": "overlay_position"}


def overlay(df: DataFrame, g: Gates = Gates()) -> DataFrame:
    """Positions without and with the trend gate, and why: needs base_position, p_fade, p_trend, expected_return, prices and contract terms."""
    base = F.col("base_position")
    edge = base * F.col("expected_return") * F.col("entry_price") * F.col("point_value")
    hurdle = F.col("cost_ticks") * F.col("tick_value") + g.buffer
    df = df.withColumns({"edge_dollars": edge, "clears": default(edge > hurdle, False), "fade_gate": default(F.col("p_fade") >= g.fade, False), "trend_gate": default(F.col("p_trend") >= g.trend, True)})
    df = df.withColumn("free_position", F.when(F.col("fade_gate") & F.col("clears"), base).otherwise(0))
    df = df.withColumn("blocked", (F.col("free_position") != 0) & F.col("trend_gate"))
    df = df.withColumn("escaped", F.col("blocked") & default(edge > hurdle + g.escape_edge, False) if g.escape else F.lit(False))
    df = df.withColumn("overlay_position", F.when(~F.col("blocked") | F.col("escaped"), F.col("free_position")).otherwise(0))
    reason = F.when(F.col("escaped"), "momentum_escape").when(F.col("blocked"), "trend_danger_block").when(base == 0, "no_direction_edge").when(~F.col("fade_gate"), "fade_success_below_cutoff").when(~F.col("clears"), "edge_below_cost_plus_buffer").otherwise("trade")
    return df.withColumn("overlay_reason", reason)


def with_deciles(df: DataFrame) -> DataFrame:
    """Deciles of both gates' probabilities over the whole frame; equal ones in the order market, fold, time.

    An order reads its rows, their cuts and their totals apart, so the frame is written before each.
    """
    df = stage(numbered(df, (), ("market", "fold_id", "ts"), F.struct("market", "fold_id"), "_place"), "tail-places")
    df = stage(with_decile(df, "p_trend", "trend_danger_decile", "_place"), "tail-deciles")
    return with_decile(df, "p_fade", "fade_success_decile", "_place").drop("_place")


def scenario(df: DataFrame, name: str) -> DataFrame:
    """The money of one scenario's positions, as traded, gross, slippage, commission, cost, net and turnover."""
    pos = F.col(POSITIONS[name])
    traded = pos != 0
    cost = F.when(traded, F.col("cost_ticks") * F.col("tick_value")).otherwise(0.0)
    slip = F.when(traded, 2.0 * F.col("slippage_ticks") * F.col("tick_value")).otherwise(0.0)
    gross = pos * (F.col("exit_price") - F.col("entry_price")) * F.col("point_value")
    before = F.lag(POSITIONS[name], 1, 0).over(Window.partitionBy("market", "fold_id").orderBy("ts"))
    return df.withColumns({"traded": traded, "gross": gross, "slippage": slip, "commission": F.greatest(cost - slip, F.lit(0.0)), "cost": cost, "net": gross - cost, "turnover": F.abs(pos - before)})


def losing_streaks(trades: DataFrame, x: str, by: Sequence[str], parts: Sequence[str] = ("market", "fold_id"), ts: str = "ts", name: str = "max_losing_streak") -> DataFrame:
    """(by, name): the longest run of ``x`` below zero in each group, rows in the order ``parts``, then ``ts``."""
    block = list(dict.fromkeys([*by, *parts, "_month"]))
    rows = trades.withColumn("_month", F.date_trunc("month", ts)).withColumn("_lost", F.coalesce(F.col(x) < 0, F.lit(False)).cast("int"))
    w = Window.partitionBy(*block).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    isles = rows.withColumn("_isle", F.sum(1 - F.col("_lost")).over(w)).groupBy(*block, "_isle").agg(F.count("*").alias("_n"), F.sum("_lost").alias("_run"))
    ends = isles.groupBy(*block).agg(F.sum("_n").alias("n"), F.coalesce(F.max(F.when(F.col("_isle") == 0, F.col("_run"))), F.lit(0)).alias("head"), F.max_by("_run", "_isle").alias("tail"), F.max("_run").alias("best"))
    chain = ends.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*parts, "_month", "n", "head", "tail", "best"))).alias("_blocks"))
    zero = F.lit(0).cast("long")
    step = lambda s, b: F.struct(F.when(b["head"] == b["n"], s["run"] + b["n"]).otherwise(b["tail"]).alias("run"), F.greatest(s["best"], s["run"] + b["head"], b["best"]).alias("best"))
    longest: Column = F.aggregate("_blocks", F.struct(zero.alias("run"), zero.alias("best")), step, lambda s: s["best"])
    return chain.select(*by, longest.alias(name))


def summary(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per group of a ``scenario`` frame: counts, money, turnover, the means of the worst 5 and 1 % of trades, the longest losing run."""
    keys = ["_all", *by]
    df = df.withColumn("_all", F.lit(1))
    count = lambda x: F.count_if(x).alias
    n, trades = F.count("*"), F.count_if("traded")
    money = ("gross", "slippage", "commission", "cost", "net")
    out = df.groupBy(*keys).agg(
        n.alias("n_rows"), count(F.col("base_position") != 0)("candidates"), trades.alias("trade_count"), count("blocked")("blocked"), count("escaped")("escaped"),
        *[F.sum(default(c, 0.0)).alias(f"{c}_sum") for c in money],
        F.sum("turnover").cast("double").alias("turnover"), (F.sum("turnover") / n).alias("turnover_per_row"),
        (F.sum("cost") / F.when(trades > 0, trades)).alias("cost_per_trade"), F.avg(F.when(F.col("traded"), F.col("net"))).alias("net_per_trade"),
    )
    only = df.where("traded")
    for part in (cvar(only, "net", keys, 0.95, "cvar_95"), cvar(only, "net", keys, 0.99, "cvar_99"), losing_streaks(only, "net", keys)):
        out = out.join(part, keys, "left")
    return out.withColumn("max_losing_streak", F.coalesce("max_losing_streak", F.lit(0))).drop("_all")


def worst_sessions(df: DataFrame, most: int = 20) -> DataFrame:
    """The sessions of a ``scenario`` frame that lost most, at most ``most``."""
    own = df.withColumn("session", F.concat_ws("|", "market", F.coalesce("session_id", F.date_format("ts", "yyyy-MM-dd"))))
    return summary(own, ["session"]).orderBy("net_sum", "session").limit(most)
