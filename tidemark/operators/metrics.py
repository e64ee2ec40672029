"""Metrics of position frames over many scopes, quantile buckets, and order-dependent measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import c, default
from tidemark.operators.ranks import quantiles
from tidemark.sources.staging import stage


def sharpe_like(x: Column | str) -> Column:
    """Mean over population deviation times the root of the count, missing as zero; NULL without spread."""
    y = F.coalesce(c(x), F.lit(0.0))
    std = F.stddev_pop(y)
    return F.when(std > 1e-15, F.avg(y) / std * F.sqrt(F.count(F.lit(1))))


def with_drawdown(df: DataFrame, x: str, by: Sequence[str], order: Sequence[str], name: str = "drawdown") -> DataFrame:
    """Running sum less its running maximum; the maximum starts with the first value."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    step = df.withColumn("_cum", F.sum(F.coalesce(c(x), F.lit(0.0))).over(w))
    return step.withColumn(name, F.col("_cum") - F.max("_cum").over(w)).drop("_cum")


def with_streak(df: DataFrame, x: str, by: Sequence[str], order: Sequence[str], name: str = "streak") -> DataFrame:
    """Length so far of the run of values below zero."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    step = df.withColumn("_isle", F.sum((~(F.coalesce(c(x), F.lit(0.0)) < 0)).cast("int")).over(w))
    isle = Window.partitionBy(*by, "_isle")
    return step.withColumn(name, F.sum((c(x) < 0).cast("int")).over(isle)).drop("_isle")


def cvar(df: DataFrame, x: str, by: Sequence[str], level: float, name: str = "cvar") -> DataFrame:
    """Mean of the values at or below the (1 - level) quantile, which is exact whatever the size of a group."""
    df = stage(df.select(*by, x), "cvar")
    edge = quantiles(df, [x], [1 - level], by).select(*by, F.col("q")[0].alias("_edge"))
    return df.join(edge, list(by)).where(F.col(x) <= F.col("_edge")).groupBy(*by).agg(F.avg(x).alias(name))


def with_decile(df: DataFrame, x: str, name: str, by: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """d01 to d10 by rank in order of appearance; ``missing`` for NULL."""
    w = Window.partitionBy(*by, F.col(x).isNull()).orderBy(x, *tie)
    n = F.count(x).over(Window.partitionBy(*by))
    rank = F.ceil(F.row_number().over(w) * 10.0 / n)
    label = F.concat(F.lit("d"), F.lpad(F.greatest(F.lit(1), F.least(F.lit(10), rank)).cast("int").cast("string"), 2, "0"))
    return df.withColumn(name, F.when(F.col(x).isNull(), "missing").otherwise(label))


def with_qcut(df: DataFrame, x: str, parts: int, name: str, by: Sequence[str]) -> DataFrame:
    """Right-closed quantile buckets from 1; equal edges fall together."""
    edges = df.groupBy(*by).agg(F.percentile(x, F.array(*[F.lit(i / parts) for i in range(1, parts)])).alias("_edges"))
    above = F.size(F.filter(F.array_distinct("_edges"), lambda e: F.col(x) > e))
    return df.join(edges, list(by)).withColumn(name, F.when(F.col(x).isNotNull(), above + 1).cast("int")).drop("_edges")


def average_rank(df: DataFrame, x: str, name: str, by: Sequence[str]) -> DataFrame:
    """Ranks from 1, ties sharing their mean."""
    w = Window.partitionBy(*by).orderBy(x)
    ties = F.count("*").over(Window.partitionBy(*by, x))
    return df.withColumn(name, F.rank().over(w) + (ties - 1) / 2)


def pearson(a: Column | str, b: Column | str) -> Column:
    """Correlation of complete pairs, NULL where either side is constant; written without a division that could fail."""
    both = c(a).isNotNull() & c(b).isNotNull()
    x, y = (F.when(both, c(v)).cast("double") for v in (a, b))
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx > 1e-12) & (sy > 1e-12), (F.avg(x * y) - F.avg(x) * F.avg(y)) / (sx * sy))


def summary() -> dict[str, Column]:
    """Aggregates of a policy frame: counts, sums, means, rates, costs by kind, and what each gate stopped."""
    n = F.count(F.lit(1))
    traded = F.col("position") != 0
    on = F.col("base_position") != 0
    count = lambda x: F.sum(x.cast("int")).cast("long")
    trades = F.sum(traded.cast("int"))
    gross, cost, net = (F.sum(default(x, 0.0)) for x in ("gross", "cost", "net"))
    return {
        "n_rows": n.cast("long"),
        "trade_count": trades.cast("long"),
        "long_count": count(F.col("position") > 0),
        "short_count": count(F.col("position") < 0),
        "flat_count": count(F.col("position") == 0),
        "gross_sum": gross,
        "cost_sum": cost,
        "net_sum": net,
        "gross_mean": F.avg("gross"),
        "net_mean": F.avg("net"),
        "net_per_trade": net / F.when(trades > 0, trades),
        "gross_sharpe": sharpe_like("gross"),
        "sharpe_like": sharpe_like("net"),
        "cost_drag": cost / F.when(F.abs(gross) > 1e-12, F.abs(gross)),
        "position_changes": F.sum("turnover").cast("double"),
        "turnover_per_bar": F.sum("turnover") / n,
        "slippage_sum": F.sum(default("slippage_cost", 0.0)),
        "commission_sum": F.sum(default("commission_cost", 0.0)),
        "round_turns_per_bar": trades / n,
        "win_rate": F.sum((traded & (F.col("net") > 0)).cast("int")) / F.when(trades > 0, trades),
        "trend_blocks": count(on & F.col("trend_block")),
        "fade_blocks": count(on & ~F.col("fade_ok")),
        "flat_blocks": count(on & ~F.col("flat_ok")),
        "no_direction": count(~on),
    }


def trade_measures() -> dict[str, Column]:
    """What a slice of a policy frame traded, by sums, means and medians of a trade."""
    n = F.count(F.lit(1))
    traded = F.col("position") != 0
    of = lambda x: F.when(traded, F.col(x))
    count = lambda x: F.sum(x.cast("int")).cast("long")
    won = lambda x: F.avg(F.when(traded, (F.col(x) > 0).cast("double")))
    right = F.when(traded & F.col("y_sign").isin(-1, 0, 1), (F.col("position") == F.col("y_sign")).cast("double"))
    return {
        "n_rows": n.cast("long"),
        "trade_count": count(traded),
        "long_count": count(F.col("position") > 0),
        "short_count": count(F.col("position") < 0),
        "flat_count": count(~traded),
        "gross_sum": F.sum(default("gross", 0.0)),
        "slippage_sum": F.sum(default("slippage_cost", 0.0)),
        "commission_sum": F.sum(default("commission_cost", 0.0)),
        "cost_sum": F.sum(default("cost", 0.0)),
        "net_sum": F.sum(default("net", 0.0)),
        "gross_mean": F.avg(of("gross")),
        "gross_median": F.percentile(of("gross"), F.lit(0.5)),
        "net_mean": F.avg(of("net")),
        "net_median": F.percentile(of("net"), F.lit(0.5)),
        "gross_win_rate": won("gross"),
        "net_win_rate": won("net"),
        "cost_mean": F.avg(of("cost")),
        "slippage_mean": F.avg(of("slippage_cost")),
        "commission_mean": F.avg(of("commission_cost")),
        "direction_accuracy": F.avg(right),
        "gross_positive": F.sum(default("gross", 0.0)) > 0,
        "net_positive": F.sum(default("net", 0.0)) > 0,
    }


def by_scopes(df: DataFrame, scopes: dict[str, list[str]], aggs: dict[str, Column]) -> DataFrame:
    """The same aggregates for several groupings in one pass; ``scope`` names the grouping, keys outside it are NULL."""
    keys = sorted({k for cols in scopes.values() for k in cols})
    sets = df.groupingSets([tuple(F.col(k) for k in cols) for cols in scopes.values()], *keys)
    mask = lambda cols: sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in cols)
    label = None
    gid = F.grouping_id()
    for name, cols in scopes.items():
        label = F.when(gid == mask(cols), name) if label is None else label.when(gid == mask(cols), name)
    return sets.agg(label.alias("scope"), *[a.alias(k) for k, a in aggs.items()])


def drawdown_by_scopes(df: DataFrame, x: str, scopes: dict[str, list[str]], parts: Sequence[str], ts: str = "ts", name: str = "max_drawdown", tie: Sequence[str] = ()) -> DataFrame:
    """Least drawdown of the running sum of ``x`` in each group of each scope, rows in the order ``parts``, then ``ts``, then ``tie``.

    Rows meet only within a month of one combination of ``parts``. Each month leaves four numbers (sum, highest and lowest
    running sum, least drawdown), which chain: a scope's value follows from its months in order.
    """
    df = df.withColumn("_month", F.date_trunc("month", ts))
    by_extra: dict[tuple[str, ...], dict[str, list[str]]] = {}
    for scope, cols in scopes.items():
        by_extra.setdefault(tuple(k for k in cols if k not in parts), {})[scope] = cols
    out = None
    for extra, some in by_extra.items():
        month = [*extra, *parts, "_month"]
        w = Window.partitionBy(*month).orderBy(ts, *tie).rowsBetween(Window.unboundedPreceding, 0)
        rows = df.withColumn("_cum", F.sum(F.coalesce(c(x), F.lit(0.0))).over(w))
        rows = rows.withColumn("_dd", F.col("_cum") - F.max("_cum").over(w))
        ends = rows.groupBy(*month).agg(F.sum(F.coalesce(c(x), F.lit(0.0))).alias("_sum"), F.max("_cum").alias("_hi"), F.min("_cum").alias("_lo"), F.min("_dd").alias("_dd"))
        ends = ends.withColumn("_m", F.struct(*parts, "_month", "_sum", "_hi", "_lo", "_dd"))
        none = F.lit(None).cast("double")
        start = F.struct(F.lit(0.0).alias("cum"), none.alias("top"), none.alias("dd"))
        step = lambda s, m: F.struct((s["cum"] + m["_sum"]).alias("cum"), F.greatest(s["top"], s["cum"] + m["_hi"]).alias("top"), F.least(s["dd"], m["_dd"], s["cum"] + m["_lo"] - s["top"]).alias("dd"))
        one = by_scopes(ends, some, {"_months": F.array_sort(F.collect_list("_m"))})
        one = one.withColumn(name, F.aggregate("_months", start, step, lambda s: s["dd"])).drop("_months")
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
