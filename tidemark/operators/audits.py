"""Slices of a policy frame: scenarios, thresholds, calibration, tails."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import argmax3, cut, default, last_match
from tidemark.operators.joins import nullsafe_left
from tidemark.operators.policy import base_direction

#: scenario, share of commission, share of slippage
COST_SCENARIOS = [("zero", 0.0, 0.0), ("commission_only", 1.0, 0.0), ("slippage_0", 1.0, 0.0), ("slippage_25", 1.0, 0.25), ("slippage_50", 1.0, 0.5), ("slippage_75", 1.0, 0.75), ("full", 1.0, 1.0)]


def slice_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Trades and sums of each group; NULL groups stay."""
    traded = F.col("position") != 0
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(traded).alias("trades"),
        F.sum("gross").alias("gross"),
        F.sum("cost").alias("cost"),
        F.sum("net").alias("net"),
        F.avg(F.when(traded, (F.col("net") > 0).cast("double"))).alias("win_rate"),
    )


def with_side(df: DataFrame, position: str = "position") -> DataFrame:
    return df.withColumn("side", F.when(F.col(position) > 0, "long").when(F.col(position) < 0, "short").otherwise("flat"))


def with_confidence(df: DataFrame) -> DataFrame:
    return df.withColumn("confidence", cut(F.abs(F.col("p_long") - F.col("p_short")), [0.05, 0.1, 0.25, 0.5]))


def cost_counterfactuals(df: DataFrame, by: Sequence[str] = ("market",)) -> DataFrame:
    """Net profit under other costs. Sums are taken once; the scenarios are applied to them."""
    sums = df.groupBy(*by).agg(F.sum("gross").alias("gross"), F.sum("commission_cost").alias("commission"), F.sum("slippage_cost").alias("slippage"))
    scenario = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, a, b in COST_SCENARIOS])
    return sums.withColumn("s", F.explode(scenario)).select(*by, F.col("s.scenario").alias("scenario"), (F.col("gross") - F.col("s.a") * F.col("commission") - F.col("s.b") * F.col("slippage")).alias("net"))


def blocked(df: DataFrame) -> DataFrame:
    """What base signals would have earned that a gate blocked."""
    out = df.where((F.col("position") == 0) & (F.col("base_position") != 0))
    missed = F.col("base_position") * (F.col("exit_price") - F.col("entry_price")) * F.col("point_value") - F.col("cost_ticks") * F.col("tick_value")
    return out.groupBy("market", "reason").agg(F.count("*").alias("n"), F.sum(missed).alias("missed_net"), F.avg((missed > 0).cast("double")).alias("would_win"))


def threshold_grid(df: DataFrame, margins: Sequence[float], fades: Sequence[float], trends: Sequence[float]) -> DataFrame:
    """Trades and net profit of every threshold triple, without the flat gate.

    Each row is tried against every triple in the expression, in one pass; no join multiplies the rows before
    the partial aggregation.
    """
    grid = F.array(*[F.struct(F.lit(m).alias("margin"), F.lit(f).alias("fade"), F.lit(t).alias("trend")) for m in margins for f in fades for t in trends])
    diff = F.col("p_long") - F.col("p_short")
    base = F.when(diff >= 0, 1).otherwise(-1)
    pnl = base * (F.col("exit_price") - F.col("entry_price")) * F.col("point_value") - F.col("cost_ticks") * F.col("tick_value")
    passes = F.filter(grid, lambda g: (F.abs(diff) >= g["margin"]) & F.coalesce(F.col("p_fade") >= g["fade"], F.lit(False)) & F.coalesce(F.col("p_trend") < g["trend"], F.lit(False)))
    return df.select(pnl.alias("pnl"), F.explode(passes).alias("g")).groupBy("g.margin", "g.fade", "g.trend").agg(F.count("*").alias("trades"), F.sum("pnl").alias("net"))


#: margin and, where the mode has them, the least lead over flat and the most flat probability
EDGE_SCENARIOS = [
    spec
    for m in (0.05, 0.10, 0.15, 0.20, 0.30)
    for spec in [("current_margin", m, None, x) for x in (None, 0.35, 0.45, 0.55)] + [("direction_beats_flat", m, x, None) for x in (0.0, 0.05, 0.10, 0.20)] + [("argmax_nonflat", m, None, None)]
]


def edge_scenarios(df: DataFrame, specs: Sequence[tuple] = EDGE_SCENARIOS) -> DataFrame:
    """Counts, profit and accuracy under every way to demand an edge, behind the fade and trend gates.

    A scenario is a struct in an array literal, and only the scenarios that a row trades in are exploded, so the partial
    aggregation of the scan does the work. A scenario without trades keeps its row of zeros.
    """
    num = lambda v: F.lit(v).cast("double")
    literal = [F.struct(F.lit(mode).alias("mode"), num(m).alias("margin"), num(f).alias("flat_margin"), num(x).alias("max_flat")) for mode, m, f, x in specs]
    long_, short, flat = F.col("p_long"), F.col("p_short"), F.col("p_flat")
    diff = long_ - short
    top = argmax3("p_short", "p_flat", "p_long")

    def side(s: Column) -> Column:
        by_margin = F.when(diff >= s["margin"], 1).when(diff <= -s["margin"], -1)
        by_flat = F.when((diff >= s["margin"]) & (long_ - flat >= s["flat_margin"]), 1).when((short - long_ >= s["margin"]) & (short - flat >= s["flat_margin"]), -1)
        by_top = F.when((top == 1) & (diff >= s["margin"]), 1).when((top == -1) & (diff <= -s["margin"]), -1)
        pos = F.when(s["mode"] == "current_margin", by_margin).when(s["mode"] == "direction_beats_flat", by_flat).otherwise(by_top)
        return F.when(s["max_flat"].isNull() | (flat <= s["max_flat"]), pos)

    taken = F.filter(F.transform(F.array(*literal), lambda s: F.struct(s.alias("s"), side(s).alias("side"))), lambda t: t["side"].isNotNull())
    gate = F.col("fade_ok") & ~F.col("trend_block")
    move = F.coalesce(F.col("exit_price") - F.col("entry_price"), F.lit(0.0))
    rows = df.select(
        F.explode(F.when(gate, taken)).alias("t"),
        (move * F.coalesce("point_value", F.lit(0.0))).alias("pnl"),
        F.coalesce(F.col("cost_ticks") * F.col("tick_value"), F.lit(0.0)).alias("cost"),
        *["y_sign", flat.alias("flat"), F.abs(diff).alias("abs_margin"), (F.greatest("p_long", "p_short") - flat).alias("lead")],
        F.signum(F.col("exit_price") - F.col("entry_price")).cast("int").alias("came"),
    )
    pos = F.col("t.side")
    hit = lambda x: F.avg(F.when(F.col(x).isin(-1, 0, 1), (pos == F.col(x)).cast("double")))
    sums = rows.groupBy("t.s").agg(
        F.count("*").alias("trades"),
        F.count_if(pos == 1).alias("longs"),
        F.count_if(pos == -1).alias("shorts"),
        F.sum(pos * F.col("pnl")).alias("gross"),
        F.sum("cost").alias("cost"),
        F.sum(pos * F.col("pnl") - F.col("cost")).alias("net"),
        hit("y_sign").alias("target_accuracy"),
        hit("came").alias("realized_accuracy"),
        F.avg("flat").alias("mean_flat"),
        F.avg("abs_margin").alias("mean_margin"),
        F.avg("lead").alias("mean_lead"),
    )
    every = df.sparkSession.range(1).select(F.explode(F.array(*literal)).alias("s")).select("s.*")
    sums = sums.select("s.*", *[x for x in sums.columns if x != "s"])
    zero = ["trades", "longs", "shorts", "gross", "cost", "net"]
    return nullsafe_left(every, sums, ["mode", "margin", "flat_margin", "max_flat"]).fillna(0, zero)


#: buckets of the signals by whose side an alignment is read
SIGNAL_BUCKETS = {"margin": [0.05, 0.10, 0.20, 0.40], "p_long": [0.25, 0.40, 0.55, 0.70, 0.85], "p_short": [0.25, 0.40, 0.55, 0.70, 0.85], "p_fade": [0.50, 0.70, 0.85, 0.95], "p_trend": [0.10, 0.25, 0.50, 0.75]}


def with_alignment(df: DataFrame) -> DataFrame:
    """Buckets of every signal, the gate that decided, what came, and what base and inverted positions would have earned."""
    on = F.col("base_position") != 0
    move = F.coalesce((F.col("exit_price") - F.col("entry_price")) * F.col("point_value"), F.lit(0.0))
    cost = F.coalesce(F.col("cost_ticks") * F.col("tick_value"), F.lit(0.0))
    df = df.withColumns({"margin": F.abs(F.col("p_long") - F.col("p_short")), "came": F.signum(F.col("exit_price") - F.col("entry_price")).cast("int")})
    gate = last_match("other", (F.col("position") != 0, "traded"), (~on, "no_direction"), (on & ~F.col("fade_ok"), "fade_filter_block"), (on & F.col("trend_block"), "trend_danger_block"))
    return df.withColumns(
        {
            **{f"{x}_bucket": cut(x, edges) for x, edges in SIGNAL_BUCKETS.items()},
            "gate": gate,
            "base_side": F.when(F.col("base_position") > 0, "long").when(F.col("base_position") < 0, "short").otherwise("flat"),
            "base_gross": F.col("base_position") * move,
            "base_net": F.col("base_position") * move - F.when(on, cost).otherwise(0.0),
            "inverted_gross": -F.col("position") * move,
            "inverted_net": F.when(F.col("position") != 0, -F.col("position") * move - cost).otherwise(0.0),
            "top": argmax3("p_short", "p_flat", "p_long"),
        }
    )


def _agree(position: Column, actual: str, where: Column, sign: int = 1, among: tuple = (-1, 0, 1)) -> Column:
    return F.avg(F.when(where & (position != 0) & F.col(actual).isin(*among), (position == sign * F.col(actual)).cast("double")))


def alignment_measures() -> dict[str, Column]:
    """How positions and base signals agree with targets and with what came; for ``with_alignment`` rows."""
    pos, base_ = F.col("position"), F.col("base_position")
    traded, on = pos != 0, base_ != 0
    every = F.lit(True)
    trades = F.count_if(traded)
    net, base_net = F.sum(default("net", 0.0)), F.sum("base_net")
    mean = lambda x: F.avg(F.when(traded, F.col(x)))
    top_right = lambda where: F.avg(F.when(where & F.col("y_sign").isin(-1, 0, 1), (F.col("top") == F.col("y_sign")).cast("double")))
    return {
        "n_rows": F.count(F.lit(1)),
        "base_signals": F.count_if(on),
        "trades": trades,
        "blocked": F.count_if(on & ~traded),
        "longs": F.count_if(pos == 1),
        "shorts": F.count_if(pos == -1),
        "mismatches": F.count_if(traded & (pos != base_)),
        "gross": F.sum(default("gross", 0.0)),
        "cost": F.sum(default("cost", 0.0)),
        "net": net,
        "base_gross": F.sum("base_gross"),
        "base_net": base_net,
        "gate_delta": net - base_net,
        "trade_rate": trades / F.when(F.count_if(on) > 0, F.count_if(on)),
        "target_accuracy": _agree(pos, "y_sign", every),
        "realized_accuracy": _agree(pos, "came", every),
        "target_inverted": _agree(pos, "y_sign", every, -1, (-1, 1)),
        "realized_inverted": _agree(pos, "came", every, -1, (-1, 1)),
        "base_accuracy": _agree(base_, "y_sign", every),
        "blocked_accuracy": _agree(base_, "y_sign", ~traded),
        "top_accuracy_traded": top_right(traded),
        "top_accuracy": top_right(every),
        "mean_margin": mean("margin"),
        "mean_p_long": mean("p_long"),
        "mean_p_short": mean("p_short"),
        "mean_p_fade": mean("p_fade"),
        "mean_p_trend": mean("p_trend"),
    }


def inversion(df: DataFrame) -> DataFrame:
    """One row: traded positions against the same positions turned round."""
    t = df.where("position <> 0")
    pos, every = F.col("position"), F.lit(True)
    return t.agg(
        F.count("*").alias("trades"),
        *[F.sum(x).alias(x) for x in ("gross", "net", "inverted_gross", "inverted_net")],
        (F.sum("inverted_net") - F.sum("net")).alias("delta"),
        _agree(pos, "y_sign", every).alias("target_accuracy"),
        _agree(-pos, "y_sign", every).alias("target_accuracy_inverted"),
        _agree(pos, "came", every).alias("realized_accuracy"),
        _agree(-pos, "came", every).alias("realized_accuracy_inverted"),
    )


def block_category(df: DataFrame) -> Column:
    on = base_direction() != 0
    return last_match("trade", (~on, "no_direction"), (on & F.coalesce(F.col("p_trend") >= 0.5, F.lit(True)), "trend"), (on & ~F.coalesce(F.col("p_fade") >= 0.5, F.lit(False)), "fade"), (on & ~F.col("flat_ok"), "flat"))


def prediction_scale(df: DataFrame, by: Sequence[str], pred: str, actual: str) -> DataFrame:
    """How predictions compare with what came: deviations, their ratio, signs, correlation."""
    from tidemark.operators.metrics import pearson

    sp, sa = F.stddev_pop(pred), F.stddev_pop(actual)
    ratio = sp / F.when(sa > 1e-15, sa)
    out = df.groupBy(*by).agg(sp.alias("pred_std"), sa.alias("actual_std"), ratio.alias("ratio"), F.avg((F.signum(pred) == F.signum(F.col(actual).cast("double"))).cast("double")).alias("sign_agreement"), pearson(pred, actual).alias("corr"))
    return out.withColumn("warning", F.when(F.col("ratio") > 100, "too_large").when(F.col("ratio") < 0.01, "too_small"))


def class_calibration(df: DataFrame) -> DataFrame:
    """By predicted class and confidence, how often each class came."""
    from tidemark.functions.scalars import argmax3, cut10

    pred = argmax3("p_short", "p_flat", "p_long")
    conf = cut10(F.greatest("p_short", "p_flat", "p_long"))
    rate = lambda k: F.avg((F.col("y_sign") == k).cast("double"))
    return df.groupBy(pred.alias("predicted"), conf.alias("bin")).agg(F.count("*").alias("n"), rate(-1).alias("short_rate"), rate(0).alias("flat_rate"), rate(1).alias("long_rate"))


def tail_overlay(df: DataFrame, buffer: float = 0.0) -> DataFrame:
    """Mean-reversion overlay: the expected edge in money must cover cost and buffer; a trend signal blocks."""
    edge = F.col("base_position") * F.col("expected_return") * F.col("entry_price") * F.col("point_value")
    cost = F.col("cost_ticks") * F.col("tick_value")
    pos = F.when(F.col("base_position") == 0, 0).when(default(F.col("p_trend") >= 0.5, True), 0).when(edge >= cost + buffer, F.col("base_position")).otherwise(0)
    df = df.withColumns({"edge_dollars": edge, "overlay_position": pos})
    gross = F.col("overlay_position") * (F.col("exit_price") - F.col("entry_price")) * F.col("point_value")
    return df.withColumn("overlay_net", gross - F.when(F.col("overlay_position") != 0, cost).otherwise(0.0))


def side_adjusted(df: DataFrame) -> DataFrame:
    """Adverse and favourable excursions as seen from the position."""
    long_ = F.col("position") > 0
    return df.withColumns({"adverse_ticks": F.when(F.col("position") != 0, F.when(long_, F.col("mae_ticks")).otherwise(-F.col("mfe_ticks"))), "favourable_ticks": F.when(F.col("position") != 0, F.when(long_, F.col("mfe_ticks")).otherwise(-F.col("mae_ticks")))})


def decision(scenarios: DataFrame, least_trades: int = 100) -> DataFrame:
    """The scenario with the most net profit among those with enough trades, if it earns anything."""
    ok = scenarios.where((F.col("trades") >= least_trades) & (F.col("net") > 0))
    return ok.orderBy(F.desc("net"), *[c for c in scenarios.columns if c not in ("trades", "net")]).limit(1)
