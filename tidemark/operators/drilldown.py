"""Where a policy earns and loses: the same trade measures over any number of scopes, what gates blocked, and the findings from them.

A scope is a name, the columns it groups by, and, if it looks at some rows only, which. Each row is sent to its group in every scope and is
summed before anything shuffles; a group is known by its text (``market=ES|side=long``), in which NULL is ``null``. Medians are exact, by
``ranks.quantiles``, so no group's values meet in one task. Results are one long table, small next to the frame.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import default
from tidemark.operators.ranks import quantiles
from tidemark.sources.staging import stage

#: columns, and a condition in SQL
Scope = tuple[Sequence[str], str | None]
_c = F.col
#: What the measures of a trade read.
TRADED = ("position", "base_position", "gross", "slippage_cost", "commission_cost", "cost", "net")
SIGNALS = ("p_long", "p_short", "p_fade", "p_trend", "y_sign")


def _traded() -> Column:
    return default(_c("position") != 0, False)


def sums() -> dict[str, Column]:
    """Counts, sums, means and rates of a slice."""
    traded = _traded()
    trades = F.count_if(traded)
    per = lambda x: F.sum(default(x, 0.0)) / F.when(trades > 0, trades)
    won = lambda x: F.avg(F.when(traded, (_c(x) > 0).cast("double")))
    gross, cost = F.sum(default("gross", 0.0)), F.sum(default("cost", 0.0))
    return {
        "row_count": F.count("*"),
        "trade_count": trades,
        "block_count": F.count("*") - trades,
        "long_count": F.count_if(_c("position") == 1),
        "short_count": F.count_if(_c("position") == -1),
        "flat_count": F.count_if(_c("position") == 0),
        "gross": gross,
        "slippage": F.sum(default("slippage_cost", 0.0)),
        "commission": F.sum(default("commission_cost", 0.0)),
        "cost": cost,
        "net": F.sum(default("net", 0.0)),
        "mean_gross": F.avg(F.when(traded, _c("gross"))),
        "mean_net": F.avg(F.when(traded, _c("net"))),
        "gross_win_rate": won("gross"),
        "net_win_rate": won("net"),
        "avg_slippage": per("slippage_cost"),
        "avg_commission": per("commission_cost"),
        "avg_cost": per("cost"),
        "cost_drag": cost / F.when(F.abs(gross) > 0, F.abs(gross)),
    }


def accuracy(side: str) -> Column:
    """How often a side that was taken came; outcomes other than -1, 0 and 1 do not count."""
    return F.avg(F.when((_c(side) != 0) & _c("y_sign").isin(-1, 0, 1), (_c(side) == _c("y_sign")).cast("double")))


def quality() -> dict[str, Column]:
    """How sure and how right the signals of a slice were."""
    of = lambda x: F.avg(F.when(_traded(), x))
    return {
        "avg_margin": of(F.abs(_c("p_long") - _c("p_short"))),
        "traded_accuracy": accuracy("position"),
        "base_accuracy": accuracy("base_position"),
        **{f"avg_{p}": of(_c(p)) for p in ("p_long", "p_short", "p_fade", "p_trend")},
    }


def opportunity() -> dict[str, Column]:
    """What the base signals of a slice would have earned."""
    on = default(_c("base_position") != 0, False)
    return {"base_signal_count": F.count_if(on), "opportunity_gross": F.sum("chance"), "opportunity_cost": F.sum(F.when(on, _c("round_turn")).otherwise(0.0)), "opportunity_net": F.sum(_c("chance") - F.when(on, _c("round_turn")).otherwise(0.0))}


def with_chance(df: DataFrame) -> DataFrame:
    chance = default("base_position", 0) * default(_c("exit_price") - _c("entry_price"), 0.0) * default("point_value", 0.0)
    return df.withColumns({"chance": chance, "round_turn": default(_c("cost_ticks") * _c("tick_value"), 0.0)})


def category(first: Sequence[str] = ("trend_danger", "fade_filter")) -> Column:
    """Why a row did not trade. The flat gate is named before all others; of fade and trend, the one that stands first."""
    on = _c("base_position") != 0
    stops = {"fade_filter": on & ~_c("fade_ok"), "trend_danger": on & _c("trend_block")}
    out = F.when(_c("position") != 0, "traded").when(on & ~_c("flat_ok"), "flat_probability")
    for name in first:
        out = out.when(stops[name], name)
    return out.when(~on, "no_direction").otherwise("other")


def _groups(scopes: Mapping[str, Scope]) -> Column:
    def one(name: str, cols: Sequence[str], where: str | None) -> Column:
        text = F.concat_ws("|", *[F.concat(F.lit(f"{k}="), F.coalesce(_c(k).cast("string"), F.lit("null"))) for k in cols])
        group = F.struct(F.lit(name).alias("scope"), text.alias("bucket"))
        return group if where is None else F.when(F.coalesce(F.expr(where), F.lit(False)), group)

    return F.array_compact(F.array(*[one(n, cols, where) for n, (cols, where) in scopes.items()]))


def measures(df: DataFrame, scopes: Mapping[str, Scope], aggs: Mapping[str, Column], medians: Mapping[str, str]) -> DataFrame:
    """(scope, bucket, aggregates, medians): medians of expressions are over traded rows where they are known."""
    rows = df.withColumns({f"_m_{n}": F.when(_traded(), F.expr(x).cast("double")) for n, x in medians.items()})
    rows = rows.select(F.explode(_groups(scopes)).alias("_g"), *[c for c in rows.columns if c not in ("scope", "bucket")]).select("_g.*", "*").drop("_g")
    total = rows.groupBy("scope", "bucket").agg(*[a.alias(n) for n, a in aggs.items()])
    if not medians:
        return total
    half = quantiles(rows, [f"_m_{n}" for n in medians], [0.5], ["scope", "bucket"])
    wide = half.groupBy("scope", "bucket").agg(*[F.max(F.when(_c("column") == f"_m_{n}", _c("q")[0])).alias(n) for n in medians])
    return total.join(wide, ["scope", "bucket"], "left")


MEDIANS = {"median_gross": "gross", "median_net": "net"}


def long_scopes() -> dict[str, Scope]:
    long_ = "position = 1"
    return {"long_overall": ((), long_), "long_market": (("market",), long_), "long_market_fold": (("market", "fold_id"), long_)}


def drilldown_scopes() -> dict[str, Scope]:
    """Scopes of the trade drilldown; the frame has side, hour, confidence, regime, volatility and category."""
    plain = {
        "overall": (),
        "market": ("market",),
        "side": ("side",),
        "market_side": ("market", "side"),
        "market_side_hour": ("market", "side", "hour"),
        "fold": ("fold_id",),
        "confidence": ("confidence",),
        "regime": ("regime",),
        "volatility": ("volatility",),
        "category": ("category",),
    }
    return {n: (cols, None) for n, cols in plain.items()} | long_scopes()


def trades(df: DataFrame) -> DataFrame:
    """The trade drilldown: every scope with its measures, and what its base signals would have earned."""
    needed = dict.fromkeys([*TRADED, "chance", "round_turn", *[k for cols, _ in drilldown_scopes().values() for k in cols]])
    rows = stage(with_chance(df).withColumn("category", category()).select(*needed), "drilldown")
    return measures(rows, drilldown_scopes(), sums() | opportunity(), MEDIANS)


def signals(df: DataFrame) -> DataFrame:
    """The signal audit: how sure and how right trades were, by market, fold or confidence and side, for longs, and by category."""
    traded, long_ = "position <> 0", "position = 1"
    scopes: dict[str, Scope] = {
        "overall": ((), None),
        "traded_market_side": (("market", "side"), traded),
        "traded_fold_side": (("fold_id", "side"), traded),
        "traded_confidence_side": (("confidence", "side"), traded),
        "long_market_fold_confidence": (("market", "fold_id", "confidence"), long_),
        "category": (("category",), None),
    }
    needed = dict.fromkeys([*TRADED, *SIGNALS, *[k for cols, _ in scopes.values() for k in cols]])
    rows = stage(df.withColumn("category", category(("fade_filter", "trend_danger"))).select(*needed), "signals")
    return measures(rows, scopes, sums() | quality(), MEDIANS | {"median_margin": "abs(p_long - p_short)"})


def rethreshold(df: DataFrame, margin: float, fade: float, trend: float) -> DataFrame:
    """The frame under other thresholds, without the flat gate: positions and what they earn and cost."""
    diff = _c("p_long") - _c("p_short")
    ok = F.coalesce((_c("p_fade") >= fade) & (_c("p_trend") < trend), F.lit(False))
    position = F.when(ok & (diff >= margin), 1).when(ok & (diff <= -margin), -1).otherwise(0)
    move = default(_c("exit_price") - _c("entry_price"), 0.0) * default("point_value", 0.0)
    round_turn, slip = default(_c("cost_ticks") * _c("tick_value"), 0.0), 2.0 * default("slippage_ticks", 0.0) * default("tick_value", 0.0)
    on = (_c("position") != 0).cast("double")
    df = df.withColumn("position", position)
    df = df.withColumns({"gross": _c("position") * move, "slippage_cost": on * slip, "commission_cost": on * F.greatest(round_turn - slip, F.lit(0.0)), "cost": on * round_turn})
    return df.withColumns({"net": _c("gross") - _c("cost"), "side": F.when(_c("position") > 0, "long").when(_c("position") < 0, "short").otherwise("flat")})


STABILITY = {
    "overall": (),
    "market": ("market",),
    "fold": ("fold_id",),
    "side": ("side",),
    "year": ("year",),
    "month": ("month",),
    "hour": ("hour",),
    "market_side": ("market", "side"),
    "market_fold": ("market", "fold_id"),
    "side_hour": ("side", "hour"),
    "market_month": ("market", "month"),
}


def stability(df: DataFrame, margin: float, fade: float, trend: float) -> DataFrame:
    """Eleven scopes of the frame under other thresholds."""
    rows = rethreshold(df, margin, fade, trend).withColumns({"year": F.year("ts"), "month": F.date_format("ts", "yyyy-MM"), "hour": F.hour("ts")})
    needed = dict.fromkeys([*TRADED, "y_sign", *[k for cols in STABILITY.values() for k in cols]])
    return measures(stage(rows.select(*needed), "stability"), {n: (cols, None) for n, cols in STABILITY.items()}, sums() | {"accuracy": accuracy("position")}, MEDIANS)


def decision(stable: DataFrame, min_trades: int, min_markets: int, min_folds: int) -> DataFrame:
    """One row: whether the thresholds hold across markets and folds, and why not. No rows at all are not stable."""
    of = lambda scope, what: F.max(F.when(_c("scope") == scope, _c(what)))
    count = lambda scope, more=F.lit(True): F.count_if((_c("scope") == scope) & more)
    up = _c("net") > 0
    one = stable.agg(
        F.coalesce(of("overall", "trade_count"), F.lit(0)).alias("trades"), F.coalesce(of("overall", "net"), F.lit(0.0)).alias("net"), F.coalesce(of("overall", "gross"), F.lit(0.0)).alias("gross"),
        count("market").alias("markets"), count("market", up).alias("positive_markets"), count("fold").alias("folds"), count("fold", up).alias("positive_folds"),
    )
    say = lambda n, what, least: F.when(_c(n) < least, F.concat(F.lit("only "), _c(n).cast("string"), F.lit(f" {what} below minimum {least}")))
    why = F.concat_ws(
        "; ",
        say("trades", "trades", min_trades),
        say("positive_markets", "net-positive markets", min_markets),
        say("positive_folds", "net-positive folds", min_folds),
        F.when(_c("net") <= 0, "overall net is not positive"),
        F.when(_c("gross") <= 0, "overall gross is not positive"),
    )
    return one.select("*", (why == "").alias("stable"), why.alias("reasons"))


#: Where gains are looked for, in this order.
POSITIVE = ("market_side", "fold", "confidence", "regime", "volatility")


def positive_examples(drilled: DataFrame, n: int = 5) -> DataFrame:
    """The first groups that gain before and after costs, scope by scope, least net first."""
    rank = F.array_position(F.lit(list(POSITIVE)), _c("scope"))
    return drilled.where(_c("scope").isin(*POSITIVE) & (_c("gross") > 0) & (_c("net") > 0)).orderBy(rank, "net", "bucket").limit(n)


def findings(drilled: DataFrame) -> DataFrame:
    """One row: gross, net and cost, the worst market and side, net without costs, rows traded and stopped by the trend gate, and whether any group gains."""
    of = lambda scope, what: F.max(F.when(_c("scope") == scope, _c(what)))
    named = lambda scope, cond=F.lit(True): F.min(F.when((_c("scope") == scope) & cond, F.struct("net", "bucket")))
    kind = lambda k: F.coalesce(F.max(F.when((_c("scope") == "category") & (_c("bucket") == f"category={k}"), _c("row_count"))), F.lit(0))
    one = drilled.agg(
        of("overall", "gross").alias("gross"), of("overall", "cost").alias("cost"), of("overall", "net").alias("net"), of("overall", "cost_drag").alias("cost_drag"), of("overall", "gross").alias("net_without_costs"),
        named("market").alias("m"), named("side", _c("bucket").isin("side=long", "side=short")).alias("s"), kind("traded").alias("traded_rows"), kind("trend_danger").alias("trend_rows"),
        F.coalesce(F.max(_c("scope").isin(*POSITIVE) & (_c("gross") > 0) & (_c("net") > 0)), F.lit(False)).alias("any_positive"),
    )
    return one.select(*[c for c in one.columns if c not in "ms"], _c("m.bucket").alias("worst_market"), _c("m.net").alias("worst_market_net"), _c("s.bucket").alias("worst_side"), _c("s.net").alias("worst_side_net"))


def model_targets(long: DataFrame, score: Mapping[str, str], truth: Mapping[str, Column], binary: Sequence[str] = ()) -> DataFrame:
    """(target_name, …): predictions of each target against what came, in one pass over long predictions.

    ``score`` names the column that holds a target's prediction, ``truth`` what it predicts. Brier scores are for ``binary`` targets whose
    outcomes are 0 or 1 and whose predictions are shares.
    """
    pick = lambda values: F.coalesce(*[F.when(_c("target_name") == t, v.cast("double")) for t, v in values.items()])
    rows = long.where(_c("target_name").isin(*score)).select("target_name", "market", "fold_id", pick({t: _c(v) for t, v in score.items()}).alias("s"), pick(truth).alias("y"))
    err = _c("s") - _c("y")
    known = F.coalesce(F.min(F.when(err.isNotNull(), _c("y").isin(0.0, 1.0) & _c("s").between(0.0, 1.0))), F.lit(False))
    return rows.groupBy("target_name").agg(
        F.count("*").alias("row_count"),
        F.count_distinct("market").alias("markets"),
        F.count_distinct("fold_id").alias("folds"),
        F.avg("s").alias("prediction_mean"), F.stddev_pop("s").alias("prediction_std"), F.avg("y").alias("target_mean"), F.stddev_pop("y").alias("target_std"),
        F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"),
        F.when(_c("target_name").isin(*binary) & known, F.avg(err * err)).alias("brier"),
    )


def cost_components(df: DataFrame) -> DataFrame:
    """One row: gross, cost by kind, net, and shares of the cost."""
    one = df.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("gross", "slippage_cost", "commission_cost", "cost", "net")])
    share = lambda c: _c(c) / F.when(_c("cost") > 0, _c("cost"))
    return one.withColumns({"cost_drag": _c("cost") / F.when(F.abs("gross") > 0, F.abs("gross")), "slippage_share": share("slippage_cost"), "commission_share": share("commission_cost")})
