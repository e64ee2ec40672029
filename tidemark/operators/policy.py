"""From predictions to positions, costs and profit, under a fixed policy."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import last_match, reasons
from tidemark.operators.joins import lookup, nullsafe_left
from tidemark.operators.metrics import by_scopes, drawdown_by_scopes, summary
from tidemark.sources.staging import stage


@dataclass(frozen=True)
class Policy:
    margin: float = 0.05
    fade: float = 0.50
    trend: float = 0.50
    flat_gate: bool = True


KEYS = ["market", "fold_id", "session_id", "bar", "ts"]
#: target_name, then what it predicts
LONG_TARGETS = {"return": ["expected_return"], "direction": ["p_long", "p_short", "p_flat"], "fade": ["p_fade"], "trend": ["p_trend"]}


def top_fraction(df: DataFrame, by_size: Column, fraction: float, by: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """The largest ceil(fraction * n) rows of each group."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(by_size.desc(), *tie))
    n = F.count("*").over(Window.partitionBy(*by))
    return df.withColumns({"_nth": nth, "_n": n}).where(F.col("_nth") <= F.ceil(F.lit(fraction) * F.col("_n"))).drop("_nth", "_n")


def to_long(wide: DataFrame) -> DataFrame:
    """One row per bar and target, as a model runner writes them."""
    every = [v for vs in LONG_TARGETS.values() for v in vs]
    keep = [k for k in wide.columns if k not in every]
    rows = F.array(*[F.struct(F.lit(t).alias("target_name"), *[(F.col(v) if v in vs else F.lit(None).cast("double")).alias(v) for v in every]) for t, vs in LONG_TARGETS.items()])
    return wide.select(*keep, F.explode(rows).alias("r")).select(*keep, "r.*")


def pivot(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Back to one row per key: one aggregation instead of a join per target, so NULL keys match as well."""
    value = lambda t, v: F.max(F.when(F.col("target_name") == t, F.col(v))).alias(v)
    rest = [k for k in long.columns if k not in {*keys, "target_name", *[v for vs in LONG_TARGETS.values() for v in vs]}]
    return long.groupBy(*keys).agg(*[value(t, v) for t, vs in LONG_TARGETS.items() for v in vs], *[F.max(r).alias(r) for r in rest])


def base_direction(p: Policy = Policy()) -> Column:
    margin = F.col("p_long") - F.col("p_short")
    return F.when(margin >= p.margin, 1).when(margin <= -p.margin, -1).otherwise(0)


def apply(df: DataFrame, p: Policy = Policy()) -> DataFrame:
    """Direction, gates, position and reason. A missing fade probability blocks, and so does a missing trend one."""
    base = base_direction(p)
    side = F.when(base == 1, F.col("p_long")).when(base == -1, F.col("p_short"))
    df = df.withColumns(
        {
            "base_position": base,
            "flat_ok": F.coalesce(side > F.col("p_flat"), F.lit(False)) if p.flat_gate else F.lit(True),
            "fade_ok": F.coalesce(F.col("p_fade") >= p.fade, F.lit(False)),
            "trend_block": F.coalesce(F.col("p_trend") >= p.trend, F.lit(True)),
        }
    )
    ok = (F.col("base_position") != 0) & F.col("flat_ok") & F.col("fade_ok") & ~F.col("trend_block")
    on = F.col("base_position") != 0
    reason = last_match("trade", (~on, "no_direction_edge"), (on & ~F.col("fade_ok"), "fade_filter_block"), (on & F.col("trend_block"), "trend_danger_block"), (on & ~F.col("flat_ok"), "flat_probability_block"))
    return df.withColumns({"position": F.when(ok, F.col("base_position")).otherwise(0), "reason": reason})


def ties(df: DataFrame) -> list[str]:
    """What orders rows of equal times: the bar, where the frame has it."""
    return [k for k in df.columns if k == "bar"]


def economics(df: DataFrame, costs: DataFrame) -> DataFrame:
    """Costs of traded rows, gross and net profit, and turnover within market and fold, by time and then bar. ``costs`` is one row a market."""
    df = lookup(df, costs, "market")
    traded = (F.col("position") != 0).cast("double")
    cost = traded * F.col("cost_ticks") * F.col("tick_value")
    slip = F.least(cost, traded * 2 * F.col("slippage_ticks") * F.col("tick_value"))
    df = df.withColumns(
        {
            "gross": F.col("position") * (F.col("exit_price") - F.col("entry_price")) * F.col("point_value"),
            "cost": cost,
            "slippage_cost": slip,
            "commission_cost": F.greatest(cost - slip, F.lit(0.0)),
        }
    )
    prev = F.lag("position", 1, 0).over(Window.partitionBy("market", "fold_id").orderBy("ts", *ties(df)))
    return df.withColumns({"net": F.col("gross") - F.col("cost"), "turnover": F.abs(F.col("position") - prev)})


def frame(wide: DataFrame, costs: DataFrame, p: Policy = Policy()) -> DataFrame:
    return economics(apply(wide, p), costs)


#: What a summary reads.
SUMMED = ("position", "base_position", "gross", "cost", "net", "turnover", "slippage_cost", "commission_cost", "trend_block", "fade_ok", "flat_ok")
SCOPES = {"overall": [], "market": ["market"], "fold": ["fold_id"], "market_fold": ["market", "fold_id"], "reason": ["reason"]}


def metrics(df: DataFrame, scopes: dict[str, list[str]] | None = None) -> DataFrame:
    """The whole summary of each group of each scope, with its drawdown in the order market, fold, time, bar.

    Sums and drawdowns read the frame apart, so it is written first, in the columns that they need.
    """
    scopes = scopes or SCOPES
    keys = sorted({k for cols in scopes.values() for k in cols})
    df = stage(df.select(*dict.fromkeys(["market", "fold_id", "ts", *ties(df), *keys, *SUMMED])), "policy-frame")
    falls = drawdown_by_scopes(df, "net", scopes, ["market", "fold_id"], tie=ties(df))
    return nullsafe_left(by_scopes(df, scopes, summary()), falls, ["scope", *keys])


def max_drawdown(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Least drawdown of the running net in the order market, fold, time, bar."""
    return drawdown_by_scopes(df, "net", {"one": list(by)}, ["market", "fold_id"], tie=ties(df)).drop("scope")


def promotion_gate(df: DataFrame, min_net: float = 0.0, max_turnover: float = 0.10, min_trades: int = 1, max_cost_drag: float = 1.0) -> DataFrame:
    """One row: what the gate looks at, what fails, and the verdict."""
    over = df.agg(*[a.alias(k) for k, a in summary().items()])
    markets = df.groupBy("market").agg(F.sum("net").alias("net")).agg(F.count_if(F.col("net") <= 0).alias("losing_markets"))
    folds = df.groupBy("fold_id").agg(F.sum("net").alias("net")).agg(F.count_if(F.col("net") <= 0).alias("losing_folds"))
    out = over.crossJoin(markets).crossJoin(folds)
    failed = reasons(
        (F.col("net_sum") <= min_net, "net"),
        (F.coalesce(F.col("sharpe_like"), F.lit(-1.0)) <= 0, "sharpe"),
        (F.coalesce(F.col("cost_drag"), F.lit(2.0)) > max_cost_drag, "cost_drag"),
        (F.col("turnover_per_bar") > max_turnover, "turnover"),
        (F.col("trade_count") < min_trades, "trades"),
        (F.col("losing_markets") > 0, "market"),
        (F.col("losing_folds") > 0, "fold"),
    )
    return out.withColumn("failed", failed).withColumn("promoted", F.col("failed") == "")

