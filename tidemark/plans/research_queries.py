"""Joins, aggregations, policy, backtest, folds, models, audits and gates."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import audits, backtest, features, joins, metrics, models, policy, ranks, replay, screens, splits, tail, validation, walkforward
from tidemark.plans.domain_queries import CAUSAL, FEATURES, LABELS, _feature_select, _numbers, FEATURE_SQL, base, feature_frame, labeled, minute_bars
from tidemark.plans.registry import BARS, CLOCK, COSTS, PREDS, clock_bars, costs, out, preds, q, query, tick_bars
from tidemark.sources.bars import events
from tidemark.sources.staging import stage

_c = F.col
_BP = f"with {BARS}, {PREDS}"

# joins


def definitions(spark) -> DataFrame:
    return spark.sql("select cast(id as int) as instrument_id, cast(t as timestamp_ntz) as ts_event, tick from values (100, '2024-01-02 03:00:00', 0.25), (100, '2024-01-05 00:00:00', 0.5), (101, '2024-01-11 00:00:00', 0.1), (102, '2024-01-25 12:00:00', 1.0) d(id, t, tick)")


_DEFS = "defs(instrument_id, ts_event, tick) as (values (100, timestamp '2024-01-02 03:00:00', 0.25::double), (100, timestamp '2024-01-05', 0.5), (101, timestamp '2024-01-11', 0.1), (102, timestamp '2024-01-25 12:00:00', 1.0))"


@query("join_asof_definition", f"with {CLOCK}, {_DEFS} select market, ts, {q('tick')} as tick from clock_bars asof left join defs on clock_bars.instrument_id = defs.instrument_id and clock_bars.ts >= defs.ts_event")
def join_asof(spark, sf_dir):
    df = joins.asof_backward(clock_bars(spark, sf_dir), definitions(spark), ["instrument_id"], "ts", "ts_event", ["tick"])
    return df.select(*out("market", "ts", tick=_c("tick")))


@query("join_left_exact_ts", f"with {CLOCK} select a.market, a.ts, {q('b.close')} as es_close from clock_bars a left join clock_bars b on b.ts = a.ts and b.market = 'ES'")
def join_exact(spark, sf_dir):
    bars = clock_bars(spark, sf_dir)
    es = bars.where("market = 'ES'").select("ts", _c("close").alias("es_close"))
    return bars.join(es, "ts", "left").select(*out("market", "ts", es_close=_c("es_close")))


_NK = "case when bar % 7 > 0 then bar % 11 end"


@query("join_left_keys_nullsafe", f"with {BARS}, l as (select market, bar, {_NK} as k from bars), r as (select market, {_NK} as k, sum(volume)::bigint as total from bars group by 1, 2) select l.market, bar, total from l left join r on l.market is not distinct from r.market and l.k is not distinct from r.k")
def join_nullsafe(spark, sf_dir):
    df = tick_bars(spark, sf_dir).withColumn("k", F.when(_c("bar") % 7 > 0, _c("bar") % 11))
    r = df.groupBy("market", "k").agg(F.sum("volume").cast("long").alias("total"))
    return joins.nullsafe_left(df.select("market", "bar", "k"), r, ["market", "k"]).select("market", "bar", "total")


@query("join_left_optional", f"with {BARS}, d as (select market, bar // 10 as k, arg_min(volume, bar) filter (where bar % 3 = 1) as first_volume from bars group by 1, 2) select market, bar, first_volume from bars left join d using (market) where d.k = bar // 10")
def join_optional(spark, sf_dir):
    df = tick_bars(spark, sf_dir).withColumn("k", F.floor(_c("bar") / 10))
    d = df.groupBy("market", "k").agg(F.min_by("volume", F.when(_c("bar") % 3 == 1, _c("bar"))).alias("first_volume"))
    return df.join(d, ["market", "k"], "left").select("market", "bar", "first_volume")


@query("join_left_features", f"{_BP} select market, bar, b.volume as volume_feature, b.market is not null as matched from preds p left join (select * from bars where bar % 2 = 0) b using (market, bar)")
def join_features(spark, sf_dir):
    b = tick_bars(spark, sf_dir).where("bar % 2 = 0").select("market", "bar", _c("volume").alias("volume_feature"), F.lit(True).alias("_m"))
    return preds(spark, sf_dir).join(b, ["market", "bar"], "left").select("market", "bar", "volume_feature", _c("_m").isNotNull().alias("matched"))


@query("join_left_ret_target", f"{_BP}, t as (select market, bar, fold_id, y_sign from preds where bar % 3 = 0) select p.market, p.bar, t.y_sign as actual from preds p left join t on p.market = t.market and p.bar = t.bar and p.fold_id = t.fold_id")
def join_target(spark, sf_dir):
    p = preds(spark, sf_dir)
    t = p.where("bar % 3 = 0").select("market", "bar", "fold_id", _c("y_sign").alias("actual"))
    return p.join(t, ["market", "bar", "fold_id"], "left").select("market", "bar", "actual")


@query("join_left_fold_stats", f"{_BP}, s as (select market, fold_id, count(*) as n from preds where y_sign = 1 group by 1, 2) select market, bar, n from preds left join s using (market, fold_id)")
def join_fold_stats(spark, sf_dir):
    p = preds(spark, sf_dir)
    s = p.where("y_sign = 1").groupBy("market", "fold_id").agg(F.count("*").alias("n"))
    return p.join(s, ["market", "fold_id"], "left").select("market", "bar", "n")


@query("join_map_lookup", f"with {BARS}, {COSTS} select market, bar, {q('close / tick_size')} as ticks from bars left join costs using (market)")
def join_lookup(spark, sf_dir):
    return joins.lookup(tick_bars(spark, sf_dir), costs(spark), "market").select(*out("market", "bar", ticks=_c("close") / _c("tick_size")))


@query("join_range_folds", f"with {BARS}, r as (select unnest(range(0, 12)) as f) select market, bar, cast(f as int) as fold from bars join r on bar between f * 50 and f * 50 + 119")
def join_range(spark, sf_dir):
    r = tick_bars(spark, sf_dir).select("market").distinct().crossJoin(spark.range(12).select(_c("id").cast("int").alias("fold")))
    r = r.withColumns({"from_bar": _c("fold") * 50, "to_bar": _c("fold") * 50 + 119})
    return joins.range_join(tick_bars(spark, sf_dir), r, "bar", "from_bar", "to_bar", ["market"], 64).select("market", "bar", "fold")


@query("join_adjacent_rows", f"with {BARS}, w as (select market, seg, min(bar) + 10 as a, min(bar) + 20 as b from bars group by 1, 2) select w.market, w.seg, max(case when x.bar < a then x.bar end) as before, min(case when x.bar > b then x.bar end) as after from w join (select * from bars where bar % 4 = 1) x using (market) group by 1, 2")
def join_adjacent(spark, sf_dir):
    b = tick_bars(spark, sf_dir)
    w = b.groupBy("market", "seg").agg((F.min("bar") + 10).alias("a"), (F.min("bar") + 20).alias("b"))
    rows = b.where("bar % 4 = 1").select("market", "bar", _c("bar").alias("found"))
    return joins.with_nearest(w, rows, ["market"], "a", "b", "bar", "found").select("market", "seg", "before", "after")


@query("join_semi_present", f"with {CLOCK}, c as (select market, count(*) as n, count(*) filter (where exists (select 1 from clock_bars e where e.market = 'ES' and e.ts = clock_bars.ts)) as present from clock_bars group by 1) select market, n - present as absent, present from c")
def join_semi(spark, sf_dir):
    b = clock_bars(spark, sf_dir)
    es = b.where("market = 'ES'").select("ts")
    present = b.join(es, "ts", "left_semi").groupBy("market").agg(F.count("*").alias("present"))
    absent = b.join(es, "ts", "left_anti").groupBy("market").agg(F.count("*").alias("absent"))
    return present.join(absent, "market", "left").select("market", F.coalesce("absent", F.lit(0)).alias("absent"), "present")


@query("join_anti_missing", f"with {CLOCK}, h as (select distinct ts from clock_bars), m as (select distinct market from clock_bars) select market, ts from m, h except select market, ts from clock_bars")
def join_anti(spark, sf_dir):
    b = clock_bars(spark, sf_dir)
    grid = joins.full_key_grid(b.select("ts").distinct(), b.select("market").distinct())
    return grid.join(b, ["market", "ts"], "left_anti").select("market", "ts")


@query("join_cross_tasks", "select m as market, cast(y as int) as year from (values ('ES'), ('CL')) a(m), (select unnest(range(2020, 2024)) as y)")
def join_cross(spark, sf_dir):
    return joins.full_key_grid(spark.createDataFrame([("ES",), ("CL",)], "market string"), spark.range(2020, 2024).select(_c("id").cast("int").alias("year")))


@query("join_index_align", f"with {BARS} select market, bar, {q('close - open')} as body, volume > 150 as big from bars")
def join_align(spark, sf_dir):
    return tick_bars(spark, sf_dir).select(*out("market", "bar", body=_c("close") - _c("open")), (_c("volume") > 150).alias("big"))


# the policy frame


POLICY = f"""{BARS}, {PREDS}, {COSTS},
pf0 as (select *, case when p_long - p_short >= 0.05 then 1 when p_long - p_short <= -0.05 then -1 else 0 end as base from preds),
pf1 as (select *, coalesce(case base when 1 then p_long when -1 then p_short end > p_flat, false) as flat_ok, coalesce(p_fade >= 0.5, false) as fade_ok, coalesce(p_trend >= 0.5, true) as trend_block from pf0),
pf2 as (select *, case when base <> 0 and flat_ok and fade_ok and not trend_block then base else 0 end as position,
    case when base <> 0 and not flat_ok then 'flat_probability_block' when base <> 0 and trend_block then 'trend_danger_block' when base <> 0 and not fade_ok then 'fade_filter_block' when base = 0 then 'no_direction_edge' else 'trade' end as reason from pf1),
pf3 as (select pf2.*, tick_size, tick_value, point_value, cost_ticks, slippage_ticks, position * (exit_price - entry_price) * point_value as gross, case when position <> 0 then cost_ticks * tick_value else 0.0 end as cost,
    least(case when position <> 0 then cost_ticks * tick_value else 0.0 end, case when position <> 0 then 2 * slippage_ticks * tick_value else 0.0 end) as slip,
    abs(position - lag(position, 1, 0) over (partition by market, fold_id order by ts)) as turnover from pf2 join costs using (market)),
pf as (select *, gross - cost as net, greatest(cost - slip, 0) as commission, case when position > 0 then 'long' when position < 0 then 'short' else 'flat' end as side from pf3)"""


def frame(spark, sf_dir) -> DataFrame:
    return audits.with_side(policy.frame(preds(spark, sf_dir), costs(spark)))


def _pol(name: str, sql: str, cols) -> None:
    @query(name, f"with {POLICY} select market, bar, {sql} from pf")
    def run(spark, sf_dir):
        return frame(spark, sf_dir).select("market", "bar", *cols())


_pol("pol_direction", "base", lambda: [_c("base_position").alias("base")])
_pol("pol_gates", "flat_ok, fade_ok, trend_block", lambda: ["flat_ok", "fade_ok", "trend_block"])
_pol("pol_reason", "reason, position", lambda: ["reason", "position"])
_pol("pol_costs", f"{q('cost')} as cost, {q('slip')} as slip, {q('commission')} as commission", lambda: [S.quantize("cost").alias("cost"), S.quantize("slippage_cost").alias("slip"), S.quantize("commission_cost").alias("commission")])
_pol("pol_pnl", f"{q('gross')} as gross, {q('net')} as net", lambda: [S.quantize("gross").alias("gross"), S.quantize("net").alias("net")])
_pol("pol_turnover", "turnover", lambda: ["turnover"])


@query("pol_pivot", f"{_BP} select market, bar, {q('expected_return')} as er, {q('p_long')} as p_long, {q('p_short')} as p_short, {q('p_flat')} as p_flat, {q('p_fade')} as p_fade, {q('p_trend')} as p_trend from preds")
def pol_pivot(spark, sf_dir):
    wide = policy.pivot(policy.to_long(preds(spark, sf_dir)), policy.KEYS)
    return wide.select(*out("market", "bar", er=_c("expected_return"), p_long=_c("p_long"), p_short=_c("p_short"), p_flat=_c("p_flat"), p_fade=_c("p_fade"), p_trend=_c("p_trend")))


_TRADES = "sum(cast(position <> 0 as int))"


def _long(condition: str) -> str:
    return f"cast(sum(cast({condition} as int)) as bigint)"


def _sharpe_sql(x: str) -> str:
    return f"case when stddev_pop({x}) > 1e-15 then avg({x}) / stddev_pop({x}) * sqrt(count(*)) end"


_SUMMARY_FLOATS = {
    "gross_sum": "sum(gross)",
    "cost_sum": "sum(cost)",
    "net_sum": "sum(net)",
    "gross_mean": "avg(gross)",
    "net_mean": "avg(net)",
    "net_per_trade": f"sum(net) / nullif({_TRADES}, 0)",
    "gross_sharpe": _sharpe_sql("gross"),
    "sharpe_like": _sharpe_sql("net"),
    "cost_drag": "case when abs(sum(gross)) > 1e-12 then sum(cost) / abs(sum(gross)) end",
    "position_changes": "sum(turnover)",
    "turnover_per_bar": "sum(turnover) / count(*)",
    "slippage_sum": "sum(slip)",
    "commission_sum": "sum(commission)",
    "round_turns_per_bar": f"{_TRADES} / count(*)",
    "win_rate": f"sum(cast(position <> 0 and net > 0 as int)) / nullif({_TRADES}, 0)",
}
_SUMMARY_COUNTS = {
    "trade_count": "position <> 0",
    "long_count": "position > 0",
    "short_count": "position < 0",
    "flat_count": "position = 0",
    "trend_blocks": "base <> 0 and trend_block",
    "fade_blocks": "base <> 0 and not fade_ok",
    "flat_blocks": "base <> 0 and not flat_ok",
    "no_direction": "base = 0",
}
_SUMMARY = ", ".join(["count(*) as n_rows", *[f"{_long(x)} as {n}" for n, x in _SUMMARY_COUNTS.items()], *[f"{q(x)} as {n}" for n, x in _SUMMARY_FLOATS.items()]])
_FLOATS = list(_SUMMARY_FLOATS)


def _quantized(df, names):
    return df.withColumns({n: S.quantize(n) for n in names})


def _scoped_sql(scopes: dict[str, list[str]]) -> str:
    """Summary and drawdown of every scope, each over its own grouping."""
    keys = sorted({k for cols in scopes.values() for k in cols})
    parts = []
    for name, cols in scopes.items():
        group = f"group by {', '.join(cols)}" if cols else ""
        by = f"partition by {', '.join(cols)} " if cols else ""
        w = f"over ({by}order by market, fold_id, ts rows between unbounded preceding and current row)"
        show = ", ".join(k if k in cols else f"null as {k}" for k in keys)
        same = " and ".join(f"a.{k} is not distinct from b.{k}" for k in cols) or "true"
        falls = f"select {', '.join([*cols, 'min(cum - top) as fall'])} from (select *, max(cum) {w} as top from (select *, sum(net) {w} as cum from pf)) {group}"
        parts.append(f"select a.*, {q('b.fall')} as max_drawdown from (select '{name}' as scope, {show + ', ' if keys else ''}{_SUMMARY} from pf {group}) a join ({falls}) b on {same}")
    return f"with {POLICY} " + " union all ".join(parts)


@query("agg_policy_summary", _scoped_sql({"overall": []}))
def agg_summary(spark, sf_dir):
    return _quantized(policy.metrics(frame(spark, sf_dir), {"overall": []}), [*_FLOATS, "max_drawdown"])


_SCOPED = _scoped_sql(policy.SCOPES)


@query("agg_multi_scope", _SCOPED)
def agg_scopes(spark, sf_dir):
    return _quantized(policy.metrics(frame(spark, sf_dir)), [*_FLOATS, "max_drawdown"])


@query("pol_metrics", _SCOPED)
def pol_metrics(spark, sf_dir):
    return agg_scopes(spark, sf_dir)


_TURN = f"with {POLICY} select market, fold_id, count(*) as n, count(*) filter (where position <> 0) as trades, cast(sum(turnover) as bigint) as turnover, {q('sum(turnover) / count(*)')} as per_bar, {q('avg(abs(position))')} as mean_position from pf group by 1, 2"


@query("agg_turnover", _TURN)
def agg_turnover(spark, sf_dir):
    g = frame(spark, sf_dir).groupBy("market", "fold_id").agg(F.count("*").alias("n"), F.count_if(_c("position") != 0).alias("trades"), F.sum("turnover").cast("long").alias("turnover"), (F.sum("turnover") / F.count("*")).alias("per_bar"), F.avg(F.abs("position")).alias("mean_position"))
    return _quantized(g, ["per_bar", "mean_position"])


@query("pol_turnover_report", _TURN)
def pol_turnover_report(spark, sf_dir):
    return agg_turnover(spark, sf_dir)


@query(
    "pol_promotion_gate",
    f"""with {POLICY}, o as (select sum(net) as net, count(*) filter (where position <> 0) as trades, case when abs(sum(gross)) > 1e-12 then sum(cost) / abs(sum(gross)) end as drag, sum(turnover) / count(*) as turn, case when stddev_pop(net) > 1e-15 then avg(net) end as sharpe from pf),
    m as (select count(*) filter (where n <= 0) as lm from (select sum(net) as n from pf group by market)), f as (select count(*) filter (where n <= 0) as lf from (select sum(net) as n from pf group by fold_id))
    select concat_ws('|', case when net <= 0 then 'net' end, case when coalesce(sharpe, -1) <= 0 then 'sharpe' end, case when coalesce(drag, 2) > 1 then 'cost_drag' end, case when turn > 0.1 then 'turnover' end, case when trades < 1 then 'trades' end, case when lm > 0 then 'market' end, case when lf > 0 then 'fold' end) as failed, lm as losing_markets, lf as losing_folds from o, m, f""",
)
def pol_gate(spark, sf_dir):
    return policy.promotion_gate(frame(spark, sf_dir)).select("failed", "losing_markets", "losing_folds")


@query("pol_holdout_block", f"{_BP} select count(*) filter (where fold_id = 4) as holdout_rows, count(*) filter (where fold_id = 4) = 0 as may_run from preds")
def pol_holdout(spark, sf_dir):
    n = F.count_if(_c("fold_id") == 4)
    return preds(spark, sf_dir).agg(n.alias("holdout_rows"), (n == 0).alias("may_run"))


# aggregations


@query("agg_group_generic", f"with {POLICY} select market, reason, count(*) as n, count(*) filter (where position <> 0) as trades, {q('sum(gross)')} as gross, {q('sum(cost)')} as cost, {q('sum(net)')} as net, {q('avg(case when position <> 0 then cast(net > 0 as double) end)')} as win_rate from pf group by 1, 2")
def agg_group(spark, sf_dir):
    return _slice(spark, sf_dir, ["market", "reason"])


def _slice(spark, sf_dir, keys, df=None):
    return _quantized(audits.slice_by(frame(spark, sf_dir) if df is None else df, keys), ["gross", "cost", "net", "win_rate"])


_SL = f"count(*) as n, count(*) filter (where position <> 0) as trades, {q('sum(gross)')} as gross, {q('sum(cost)')} as cost, {q('sum(net)')} as net, {q('avg(case when position <> 0 then cast(net > 0 as double) end)')} as win_rate"
_STAB = {"overall": [], "market": ["market"], "fold": ["fold_id"], "side": ["side"], "year": ["year"], "month": ["month"], "hour": ["hour"], "market_side": ["market", "side"], "market_fold": ["market", "fold_id"], "side_hour": ["side", "hour"], "market_month": ["market", "month"]}
_STAB_KEYS = sorted({k for v in _STAB.values() for k in v})
_TM_FLOATS = {"gross_sum": "sum(gross)", "slippage_sum": "sum(slip)", "commission_sum": "sum(commission)", "cost_sum": "sum(cost)", "net_sum": "sum(net)"}
_TM_FLOATS |= {f"{n}_mean": f"avg({x}) filter (where position <> 0)" for n, x in (("gross", "gross"), ("net", "net"), ("cost", "cost"), ("slippage", "slip"), ("commission", "commission"))}
_TM_FLOATS |= {f"{n}_median": f"quantile_cont({n}, 0.5) filter (where position <> 0)" for n in ("gross", "net")}
_TM_FLOATS |= {f"{n}_win_rate": f"avg(cast({n} > 0 as int)) filter (where position <> 0)" for n in ("gross", "net")}
_TM_FLOATS |= {"direction_accuracy": "avg(cast(position = y_sign as int)) filter (where position <> 0)"}
_TM = ", ".join(["count(*) as n_rows", *[f"{_long(_SUMMARY_COUNTS[n])} as {n}" for n in ("trade_count", "long_count", "short_count", "flat_count")], *[f"{q(x)} as {n}" for n, x in _TM_FLOATS.items()], "sum(gross) > 0 as gross_positive", "sum(net) > 0 as net_positive"])


@query("agg_stability_scopes", f"with {POLICY}, h as (select *, cast(hour(ts) as int) as hour, cast(year(ts) as int) as year, strftime(ts, '%Y-%m') as month from pf) " + " union all ".join(f"select '{n}' as scope, " + ", ".join(k if k in ks else f"null as {k}" for k in _STAB_KEYS) + f", {_TM} from h " + (f"group by {', '.join(ks)}" if ks else "") for n, ks in _STAB.items()))
def agg_stability(spark, sf_dir):
    df = frame(spark, sf_dir).withColumns({"hour": F.hour("ts"), "year": F.year("ts"), "month": F.date_format("ts", "yyyy-MM")})
    return _quantized(metrics.by_scopes(df, _STAB, metrics.trade_measures()), list(_TM_FLOATS))


@query("agg_scale_scopes", f"{_BP} select market, fold_id, case when grouping(market) = 1 and grouping(fold_id) = 1 then 'overall' when grouping(fold_id) = 1 then 'market' when grouping(market) = 1 then 'fold' else 'market_fold' end as scope, {q('stddev_pop(expected_return)')} as pred_std, {q('avg(abs(exit_price / entry_price - 1))')} as actual_abs from preds group by grouping sets ((), (market), (fold_id), (market, fold_id))")
def agg_scale(spark, sf_dir):
    scopes = {"overall": [], "market": ["market"], "fold": ["fold_id"], "market_fold": ["market", "fold_id"]}
    aggs = {"pred_std": F.stddev_pop("expected_return"), "actual_abs": F.avg(F.abs(_c("exit_price") / _c("entry_price") - 1))}
    return _quantized(metrics.by_scopes(preds(spark, sf_dir), scopes, aggs), ["pred_std", "actual_abs"])


_ARG = "case when p_short >= p_flat and p_short >= p_long then -1 when p_flat >= p_long then 0 else 1 end"
#: What the formulas' models predict, in SQL of both engines, and which column holds it, in the order of ``policy.LONG_TARGETS``.
_OUTCOMES = ["exit_price / entry_price - 1", "y_sign", "cast(y_sign <> 0 as int)", "cast(y_sign = 0 as int)"]
_SCORES = ["expected_return", "p_long - p_short", "p_fade", "p_trend"]
_RUNS = dict(zip(policy.LONG_TARGETS, walkforward.MODELS, strict=True))
_FROM_BAR = hashlib.sha256(b"bar").hexdigest()  # the bar is all that the formulas read


def _kind(m: walkforward.Model) -> str:
    return "classification_probability" if m.classifies else "regression"


def prediction_table(spark, sf_dir) -> DataFrame:
    """The formulas' predictions as a model runner writes them: a row per bar and model, with what came."""
    pick = lambda values: F.coalesce(*[F.when(_c("target") == t, v) for t, v in zip(_RUNS, values, strict=True)])
    long_ = policy.to_long(preds(spark, sf_dir)).withColumnRenamed("target_name", "target")
    texts = {n: pick([F.lit(f(m)) for m in _RUNS.values()]) for n, f in (("model_id", lambda m: m.model_id), ("model_family", lambda m: m.family), ("target_name", lambda m: m.target), ("prediction_type", _kind), ("model_config_hash", lambda m: m.config_hash))}
    return long_.select(
        "market", "fold_id", _c("ts").alias("timestamp"), *[x.alias(n) for n, x in texts.items()],
        pick([F.expr(x).cast("double") for x in _OUTCOMES]).alias("y_true"), pick([F.expr(x) for x in _SCORES]).alias("y_pred_calibrated"),
        "p_long", "p_short", "p_flat", _c("p_fade").alias("p_fade_success"), _c("p_trend").alias("p_trend_danger"),
        F.lit("no_calibration").alias("calibration_id"), F.lit(_FROM_BAR).alias("feature_config_hash"),
    )


_RUN_SQL = " union all ".join(
    f"select '{m.model_id}' as model_id, '{m.family}' as model_family, '{m.target}' as target_name, '{_kind(m)}' as prediction_type, '{m.config_hash}' as model_config_hash, market, fold_id, cast({y} as double) as y, {s} as s, p_long, p_short, p_flat from preds"
    for m, y, s in zip(walkforward.MODELS, _OUTCOMES, _SCORES, strict=True)
)
_COMPARED = {
    "prediction_mean": "avg(s)",
    "prediction_std": "stddev_pop(s)",
    "target_mean": "avg(y)",
    "target_std": "stddev_pop(y)",
    "mse": "avg((s - y) ** 2)",
    "mae": "avg(abs(s - y))",
    "brier_score": "case when min(cast(y in (0, 1) and s between 0 and 1 as int)) filter (where s - y is not null) = 1 then avg((s - y) ** 2) end",
    "direction_accuracy": f"case when target_name = '{walkforward.DIRECTION}' then avg(cast({_ARG} = y as int)) end",
}


@query("agg_model_comparison", f"{_BP}, runs as ({_RUN_SQL}) select model_id, model_family, target_name, market, fold_id, count(*) as row_count, prediction_type, model_config_hash, '{_FROM_BAR}' as feature_config_hash, 'no_calibration' as calibration_ids, {', '.join(f'{q(x)} as {n}' for n, x in _COMPARED.items())} from runs group by model_id, model_family, target_name, market, fold_id, prediction_type, model_config_hash")
def agg_models(spark, sf_dir):
    return _quantized(walkforward.comparison(prediction_table(spark, sf_dir)), list(_COMPARED))


@query("pol_model_comparison", f"{_BP} select market, count(distinct fold_id) as folds, {q('avg(p_long)')} as mean, {q('avg((p_long - cast(y_sign = 1 as int)) ** 2)')} as brier from preds group by 1")
def pol_models(spark, sf_dir):
    g = preds(spark, sf_dir).groupBy("market").agg(F.count_distinct("fold_id").alias("folds"), F.avg("p_long").alias("mean"), F.avg(F.pow(_c("p_long") - (_c("y_sign") == 1).cast("int"), 2)).alias("brier"))
    return _quantized(g, ["mean", "brier"])


@query("agg_model_target", f"{_BP}, l as (select 'long' as target, market, fold_id, p_long as p, cast(y_sign = 1 as int) as y from preds union all select 'short', market, fold_id, p_short, cast(y_sign = -1 as int) from preds) select target, count(distinct market) as markets, count(distinct fold_id) as folds, {q('avg(p)')} as mean, {q('avg((p - y) ** 2)')} as brier from l group by 1")
def agg_model_target(spark, sf_dir):
    rows = F.array(*[F.struct(F.lit(t).alias("target"), _c(p).alias("p"), (_c("y_sign") == k).cast("int").alias("y")) for t, p, k in (("long", "p_long", 1), ("short", "p_short", -1))])
    long_ = preds(spark, sf_dir).select("market", "fold_id", F.inline(rows))
    g = long_.groupBy("target").agg(F.count_distinct("market").alias("markets"), F.count_distinct("fold_id").alias("folds"), F.avg("p").alias("mean"), F.avg(F.pow(_c("p") - _c("y"), 2)).alias("brier"))
    return _quantized(g, ["mean", "brier"])


_CAL = f"{_BP} select market, fold_id, cast(greatest(1, least(10, ceil(p_fade * 10))) as int) as bin, count(*) as n, {q('avg(p_fade)')} as score, {q('avg(cast(y_sign = 1 as int))')} as observed from preds where p_fade is not null group by 1, 2, 3"


@query("agg_calibration_curve", _CAL)
def agg_calibration(spark, sf_dir):
    g = preds(spark, sf_dir).where(_c("p_fade").isNotNull()).groupBy("market", "fold_id", S.cut10("p_fade").alias("bin")).agg(F.count("*").alias("n"), F.avg("p_fade").alias("score"), F.avg((_c("y_sign") == 1).cast("int")).alias("observed"))
    return _quantized(g, ["score", "observed"])


@query("pol_calibration", _CAL)
def pol_calibration(spark, sf_dir):
    return agg_calibration(spark, sf_dir)


_CLS = f"{_BP} select cast({_ARG} as int) as predicted, cast(greatest(1, least(10, ceil(greatest(p_short, p_flat, p_long) * 10))) as int) as bin, count(*) as n, {q('avg(cast(y_sign = -1 as int))')} as short_rate, {q('avg(cast(y_sign = 0 as int))')} as flat_rate, {q('avg(cast(y_sign = 1 as int))')} as long_rate from preds group by 1, 2"


@query("agg_class_calibration", _CLS)
def agg_class(spark, sf_dir):
    return _quantized(audits.class_calibration(preds(spark, sf_dir)), ["short_rate", "flat_rate", "long_rate"])


_CONF = "case when abs(p_long - p_short) is null then 'missing' when abs(p_long - p_short) <= 0.05 then '<=0.05' when abs(p_long - p_short) <= 0.1 then '(0.05,0.1]' when abs(p_long - p_short) <= 0.25 then '(0.1,0.25]' when abs(p_long - p_short) <= 0.5 then '(0.25,0.5]' else '>0.5' end"


@query("agg_confidence_bins", f"{_BP} select {_CONF} as confidence, case when p_flat <= 0.25 then '<=0.25' when p_flat <= 0.5 then '(0.25,0.5]' else '>0.5' end as flat, cast({_ARG} as int) as predicted, count(*) as n from preds group by 1, 2, 3")
def agg_conf(spark, sf_dir):
    df = audits.with_confidence(preds(spark, sf_dir))
    return df.groupBy("confidence", S.cut("p_flat", [0.25, 0.5]).alias("flat"), S.argmax3("p_short", "p_flat", "p_long").alias("predicted")).agg(F.count("*").alias("n"))


@query("agg_first_non_null", f"{_BP} select market, fold_id, {q('arg_min(p_fade, bar) filter (where p_fade is not null)')} as first_fade from preds group by 1, 2")
def agg_first(spark, sf_dir):
    return _quantized(preds(spark, sf_dir).groupBy("market", "fold_id").agg(F.min_by("p_fade", F.when(_c("p_fade").isNotNull(), _c("bar"))).alias("first_fade")), ["first_fade"])


@query("agg_session_ohlc", f"with {BARS} select market, session_segment_id as session, {q('arg_min(open, ts)')} as open, {q('max(high)')} as high, {q('min(low)')} as low, {q('arg_max(close, ts)')} as close, {q('max(high) - min(low)')} as range from bars group by 1, 2")
def agg_ohlc(spark, sf_dir):
    g = tick_bars(spark, sf_dir).groupBy("market", _c("session_segment_id").alias("session")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), (F.max("high") - F.min("low")).alias("range"))
    return _quantized(g, ["open", "high", "low", "close", "range"])


@query("agg_any_transform", f"with {BARS} select market, bar, bool_or(is_synthetic) over (partition by market, session_segment_id) as any_synthetic from bars")
def agg_any(spark, sf_dir):
    return tick_bars(spark, sf_dir).select("market", "bar", F.bool_or("is_synthetic").over(Window.partitionBy("market", "session_segment_id")).alias("any_synthetic"))


@query("agg_distinct_count", "select event_type, count(distinct user_id) as users from events group by 1")
def agg_distinct(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query("agg_value_counts", "select user_id, count(*) as n from events group by 1 order by n desc, user_id limit 15")
def agg_counts(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(15)


@query("agg_gap_histogram", f"with {CAUSAL} select gap_size as size, count(*) as gaps from (select distinct market, gap_id, gap_size from cv where synth) group by 1")
def agg_gaps(spark, sf_dir):
    b = base(spark, sf_dir).where("is_synthetic").select("market", "synthetic_gap_id", _c("synthetic_gap_size_minutes").alias("size")).dropDuplicates()
    return b.groupBy("size").agg(F.count("*").alias("gaps"))


@query("agg_largest_gaps", f"with {CAUSAL} select market, gap_id, max(gap_size) as size, count(*) as rows, min(ts) as first_ts, max(ts) as last_ts from cv where synth group by 1, 2 order by size desc, market, first_ts limit 10")
def agg_largest(spark, sf_dir):
    return validation.largest_gaps(base(spark, sf_dir)).withColumnRenamed("synthetic_gap_id", "gap_id")


@query("agg_quantile", f"with {BARS} select market, {q('quantile_cont(close, 0.05)')} as q05, {q('quantile_cont(close, 0.95)')} as q95 from bars group by 1")
def agg_quantile(spark, sf_dir):
    found = ranks.quantiles(stage(tick_bars(spark, sf_dir).select("market", "close"), "closes"), ["close"], [0.05, 0.95], ["market"])
    return found.select(*out("market", q05=_c("q")[0], q95=_c("q")[1]))


@query("agg_median", f"with {BARS} select market, {q('median(volume)')} as v from bars group by 1")
def agg_median(spark, sf_dir):
    return ranks.quantiles(stage(tick_bars(spark, sf_dir).select("market", "volume"), "volumes"), ["volume"], [0.5], ["market"]).select(*out("market", v=_c("q")[0]))


@query("agg_cvar", f"with {POLICY}, e as (select market, quantile_cont(net, 0.05) as e from pf where position <> 0 group by 1) select market, {q('avg(net)')} as cvar from pf join e using (market) where position <> 0 and net <= e group by 1")
def agg_cvar(spark, sf_dir):
    return _quantized(metrics.cvar(frame(spark, sf_dir).where("position <> 0"), "net", ["market"], 0.95), ["cvar"])


@query("agg_std_pop", f"with {BARS} select market, seg, {q('stddev_pop(close)')} as v, {q('stddev_pop(case when bar % 150 = 0 then close end)')} as single from bars group by 1, 2")
def agg_std(spark, sf_dir):
    return _quantized(tick_bars(spark, sf_dir).groupBy("market", "seg").agg(F.stddev_pop("close").alias("v"), F.stddev_pop(F.when(_c("bar") % 150 == 0, _c("close"))).alias("single")), ["v", "single"])


@query("agg_sharpe_like", f"with {POLICY} select market, {q('case when stddev_pop(net) > 1e-15 then avg(net) / stddev_pop(net) * sqrt(count(*)) end')} as v from pf group by 1")
def agg_sharpe(spark, sf_dir):
    return _quantized(frame(spark, sf_dir).groupBy("market").agg(metrics.sharpe_like("net").alias("v")), ["v"])


@query("agg_max_drawdown", f"with {POLICY}, c as (select market, fold_id, ts, sum(net) over (partition by market order by fold_id, ts rows between unbounded preceding and current row) as cum from pf), d as (select market, cum - max(cum) over (partition by market order by fold_id, ts rows between unbounded preceding and current row) as dd from c) select market, {q('min(dd)')} as max_drawdown from d group by 1")
def agg_drawdown(spark, sf_dir):
    return _quantized(policy.max_drawdown(frame(spark, sf_dir), ["market"]), ["max_drawdown"])


@query("agg_losing_streak", f"with {POLICY}, t as (select *, sum(cast(not net < 0 as int)) over (partition by market order by ts rows between unbounded preceding and current row) as isle from pf where position <> 0), s as (select market, isle, count(*) filter (where net < 0) as n from t group by 1, 2) select market, max(n) as streak from s group by 1")
def agg_streak(spark, sf_dir):
    df = metrics.with_streak(frame(spark, sf_dir).where("position <> 0"), "net", ["market"], ["ts", "bar"])
    return df.groupBy("market").agg(F.max("streak").cast("long").alias("streak"))


@query("agg_corr_pearson", f"with {BARS} select market, {q('corr(close, volume)')} as v, cast(null as bigint) as constant from bars group by 1")
def agg_corr(spark, sf_dir):
    g = tick_bars(spark, sf_dir).withColumn("one", F.lit(1.0)).groupBy("market").agg(metrics.pearson("close", "volume").alias("v"), metrics.pearson("close", "one").alias("constant"))
    return _quantized(g, ["v", "constant"])


@query("agg_corr_spearman", f"with {BARS}, r as (select rank() over (order by close) + (count(*) over (partition by close) - 1) / 2.0::double as a, rank() over (order by volume) + (count(*) over (partition by volume) - 1) / 2.0::double as b from bars) select count(*) as n, {q('corr(a, b)')} as v from r")
def agg_spearman_all(spark, sf_dir):
    """Of ranks over the whole table, from counted values in range partitions."""
    return ranks.spearman(tick_bars(spark, sf_dir), "close", "volume").select("n", S.quantize("rho").alias("v"))


@query("agg_corr_spearman_by_market", f"with {BARS}, r as (select market, rank() over (partition by market order by close) + (count(*) over (partition by market, close) - 1) / 2.0::double as a, rank() over (partition by market order by volume) + (count(*) over (partition by market, volume) - 1) / 2.0::double as b from bars) select market, {q('corr(a, b)')} as v from r group by 1")
def agg_spearman(spark, sf_dir):
    df = metrics.average_rank(metrics.average_rank(tick_bars(spark, sf_dir), "close", "a", ["market"]), "volume", "b", ["market"])
    return _quantized(df.groupBy("market").agg(metrics.pearson("a", "b").alias("v")), ["v"])


_CM = ["open", "high", "low", "close", "volume"]


@query("agg_corr_matrix", f"with {BARS} " + " union all ".join(f"select '{a}' as a, '{b}' as b, {q(f'corr({a}, {b})')} as r from bars" for i, a in enumerate(_CM) for b in _CM[i + 1 :]))
def agg_matrix(spark, sf_dir):
    pairs = [(a, b) for i, a in enumerate(_CM) for b in _CM[i + 1 :]]
    one = tick_bars(spark, sf_dir).agg(*[metrics.pearson(a, b).alias(f"{a}|{b}") for a, b in pairs])
    stack = one.unpivot([], [f"`{a}|{b}`" for a, b in pairs], "k", "r")
    return stack.select(F.split("k", r"\|")[0].alias("a"), F.split("k", r"\|")[1].alias("b"), S.quantize("r").alias("r"))


ALL_FEATURES = [f"feature_{x}" for names in features.FAMILIES.values() for x in names]
#: the features whose SQL is one expression; twins hold them to the millionth, as the feature queries do
_SCREENED = [x for names in features.FAMILIES.values() for x in names if x in FEATURE_SQL]


def screened(spark, sf_dir) -> DataFrame:
    """Quantized features of minute bars."""
    return features.add_base(minute_bars(spark, sf_dir)).select("market", "bar", *_numbers(_SCREENED))


_SCREEN = f"{FEATURES}, sc as (select market, bar, {_feature_select(_SCREENED)} from f8), scl as (select * from (select market, bar, {', '.join(f'cast("{x}" as double) as "{x}"' for x in _SCREENED)} from sc) unpivot include nulls (x for feature in ({', '.join(f'"{x}"' for x in _SCREENED)})))"


@query("agg_corr_features")
def agg_corr_features(spark, sf_dir):
    df = feature_frame(spark, sf_dir).where("training_row_valid")
    return screens.correlations(df, ALL_FEATURES)


@query("agg_corr_high")
def agg_corr_high(spark, sf_dir):
    df = feature_frame(spark, sf_dir).where("training_row_valid")
    return screens.correlations(df, ALL_FEATURES, 0.98).select("feature_a", "feature_b", "corr")


@query("agg_null_rates", f"with {_SCREEN} select feature, count(*) as n, count(*) filter (where x is null) as nulls, {q('avg(cast(x is null as int))')} as rate, count(x) = 0 as unavailable from scl group by 1")
def agg_nulls(spark, sf_dir):
    return _quantized(screens.null_rates(screened(spark, sf_dir), _SCREENED), ["rate"])


_SHIFT = {"missing": "avg(cast(x is null as int))", "missing_traded": "avg(cast(x is null as int)) filter (where traded)", "mean": "avg(x / 1e6)", "mean_traded": "avg(x / 1e6) filter (where traded)", "std": "stddev_pop(x / 1e6)", "std_traded": "stddev_pop(x / 1e6) filter (where traded)"}


@query(
    "agg_feature_shift",
    f"""with {_SCREEN}, tr as (select s.feature, s.x, s.bar % 7 = 2 as traded from scl s), g as (select feature, count(*) as n, count(*) filter (where traded) as n_traded, {', '.join(f'{x} as {n}' for n, x in _SHIFT.items())} from tr group by 1),
    z as (select feature, avg(cast(coalesce(abs(x / 1e6 - mean) / std > 5, false) as int)) filter (where std > 1e-12) as far_rate, avg(cast(coalesce(abs(x / 1e6 - mean) / std > 5, false) as int)) filter (where traded and std > 1e-12) as far_rate_traded from tr join g using (feature) group by 1)
    select feature, n, n_traded, {', '.join(f'cast(round({x} * 1000) as bigint) as {x}' for x in _SHIFT)}, cast(round((missing_traded - missing) * 1000) as bigint) as missing_delta, case when std > 1e-12 then cast(round(abs(mean_traded - mean) / std * 1000) as bigint) end as shift, cast(round(far_rate * 1000) as bigint) as far_rate, cast(round(far_rate_traded * 1000) as bigint) as far_rate_traded from g join z using (feature)""",
)
def agg_shift(spark, sf_dir):
    df = screened(spark, sf_dir).select((_c("bar") % 7 == 2).alias("traded"), *[(_c(x) / 1e6).alias(x) for x in _SCREENED])
    g = screens.feature_shift(df, _SCREENED)
    return g.select("feature", "n", "n_traded", *[F.round(_c(x) * 1000).cast("long").alias(x) for x in (*_SHIFT, "missing_delta", "shift", "far_rate", "far_rate_traded")])


@query("agg_match_rate", f"{_BP} select market, {q('avg(cast(abs(p_fade - p_trend) <= 0.1 as double))')} as rate from preds where p_fade is not null and p_trend is not null group by 1")
def agg_match(spark, sf_dir):
    both = _c("p_fade").isNotNull() & _c("p_trend").isNotNull()
    return _quantized(preds(spark, sf_dir).groupBy("market").agg(F.avg(F.when(both, (F.abs(_c("p_fade") - _c("p_trend")) <= 0.1).cast("double"))).alias("rate")), ["rate"])


@query("agg_accuracy", f"with {POLICY} select market, {q('avg(cast(position = y_sign as int)) filter (where position <> 0)')} as v from pf group by 1")
def agg_accuracy(spark, sf_dir):
    return _quantized(frame(spark, sf_dir).groupBy("market").agg(F.avg(F.when(_c("position") != 0, (_c("position") == _c("y_sign")).cast("int"))).alias("v")), ["v"])


@query("agg_inverted_rate", f"with {POLICY} select market, {q('avg(cast(position = -y_sign as int)) filter (where position <> 0 and y_sign <> 0)')} as v from pf group by 1")
def agg_inverted(spark, sf_dir):
    on = (_c("position") != 0) & (_c("y_sign") != 0)
    return _quantized(frame(spark, sf_dir).groupBy("market").agg(F.avg(F.when(on, (_c("position") == -_c("y_sign")).cast("int"))).alias("v")), ["v"])


@query("agg_argmax_accuracy", f"{_BP} select market, {q(f'avg(cast({_ARG} = y_sign as int))')} as v from preds group by 1")
def agg_argmax(spark, sf_dir):
    return _quantized(preds(spark, sf_dir).groupBy("market").agg(F.avg((S.argmax3("p_short", "p_flat", "p_long") == _c("y_sign")).cast("int")).alias("v")), ["v"])


@query("agg_validation_counts", f"with {BARS} select market, count(*) as n, count(*) - count(distinct ts) as duplicates, count(*) filter (where volume > 200) as heavy, count(*) filter (where trim(session_segment_id) = '') as blank from bars group by 1")
def agg_validation(spark, sf_dir):
    return tick_bars(spark, sf_dir).groupBy("market").agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct("ts")).alias("duplicates"), F.count_if(_c("volume") > 200).alias("heavy"), F.count_if(S.blank("session_segment_id")).alias("blank"))


@query("agg_report_rollup", f"with {BARS}, f as (select market, seg, count(*) as rows, count(*) filter (where not causal_valid) as bad from bars group by 1, 2) select count(*) as files, cast(sum(rows) as bigint) as rows, cast(sum(bad) as bigint) as bad, count(*) filter (where bad > 3) as failing from f")
def agg_rollup(spark, sf_dir):
    f = tick_bars(spark, sf_dir).groupBy("market", "seg").agg(F.count("*").alias("rows"), F.count_if(~_c("causal_valid")).alias("bad"))
    return f.agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), F.sum("bad").alias("bad"), F.count_if(_c("bad") > 3).alias("failing"))


@query("agg_raw_summary", f"with {CLOCK} select market, min(ts) as first_ts, max(ts) as last_ts, string_agg(distinct cast(instrument_id as varchar), ',' order by cast(instrument_id as varchar)) as contracts from clock_bars group by 1")
def agg_raw(spark, sf_dir):
    return clock_bars(spark, sf_dir).groupBy("market").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.array_join(F.array_sort(F.collect_set(_c("instrument_id").cast("string"))), ",").alias("contracts"))


# backtest


BT = f"""{POLICY},
bt0 as (select market, bar, ts, session_id, close as mark, cast(y_sign as double) as signal, tick_size, tick_value, point_value, slippage_ticks from (select pf.*, exit_price as close from pf)),
bt1 as (select *, case when lead(ts) over (partition by market, session_id order by ts) is null then 0.0 else sign(signal) * 2 end as desired from bt0),
bt2 as (select *, lag(desired, 1, 0.0) over w as prev, lag(mark) over w as pm from bt1 window w as (partition by market order by ts)),
bt3 as (select *, desired - prev as qty, mark + sign(desired - prev) * slippage_ticks * tick_size as fill_price, abs(desired - prev) * 1.5 as commission, abs(desired - prev) * slippage_ticks * tick_value as slippage, coalesce(prev * (mark - pm) * point_value, 0) as gross from bt2),
bt as (select *, gross - commission - slippage as net from bt3)"""


def ran(spark, sf_dir) -> DataFrame:
    p = preds(spark, sf_dir).select("market", "bar", "ts", "session_id", _c("exit_price").alias("mark"), _c("y_sign").cast("double").alias("signal"))
    p = p.join(F.broadcast(costs(spark)), "market").withColumn("commission_per_contract", F.lit(1.5))
    return backtest.run(backtest.desired_positions(p, max_position=2))


@query("bt_desired_position", f"with {BT} select market, bar, cast(desired as int) as desired from bt")
def bt_desired(spark, sf_dir):
    return ran(spark, sf_dir).select("market", "bar", _c("desired").cast("int").alias("desired"))


@query("bt_fills", f"with {BT} select market, bar, cast(qty as int) as qty, {q('fill_price')} as fill_price, {q('commission')} as commission, {q('slippage')} as slippage from bt where qty <> 0")
def bt_fills(spark, sf_dir):
    f = backtest.fills(ran(spark, sf_dir))
    return f.select("market", "bar", _c("order_qty").cast("int").alias("qty"), *out(fill_price=_c("fill_price"), commission=_c("commission"), slippage=_c("slippage")))


@query("bt_mark_to_market", f"with {BT} select market, bar, {q('gross')} as gross, {q('net')} as net from bt")
def bt_mtm(spark, sf_dir):
    return ran(spark, sf_dir).select(*out("market", "bar", gross=_c("gross"), net=_c("net")))


_EQ = f"{BT}, eq as (select *, 100000 + sum(net) over (order by market, ts rows between unbounded preceding and current row) as equity from bt), dd as (select *, equity - max(equity) over (order by market, ts rows between unbounded preceding and current row) as drawdown from eq)"


@query("bt_equity", f"with {_EQ} select market, bar, cast(floor(equity * 1000 + 0.500123) as bigint) as equity, cast(floor(drawdown * 1000 + 0.500123) as bigint) as drawdown from dd")
def bt_equity(spark, sf_dir):
    e = backtest.running_equity(ran(spark, sf_dir), "net")
    return e.select("market", "bar", S.quantize("equity", 1000).alias("equity"), S.quantize("drawdown", 1000).alias("drawdown"))


@query("bt_metrics", f"with {_EQ} select count(*) as n_rows, cast(sum(cast(qty <> 0 as int)) as bigint) as n_fills, cast(sum(abs(qty)) as bigint) as turnover, cast(floor(sum(gross) * 1000 + 0.500123) as bigint) as gross, cast(floor(sum(net) * 1000 + 0.500123) as bigint) as net, cast(floor(min(drawdown) * 1000 + 0.500123) as bigint) as max_drawdown, cast(sum(cast(net > 0 as int)) as bigint) as winning_rows from dd")
def bt_metrics(spark, sf_dir):
    m = backtest.metrics(ran(spark, sf_dir))
    return m.select("n_rows", "n_fills", _c("turnover").cast("long").alias("turnover"), *[S.quantize(x, 1000).alias(x) for x in ("gross", "net", "max_drawdown")], "winning_rows")


# walk-forward


_W = splits.Windows(10, 3, 3)
FOLDS = f"""{BARS}, span as (select market, min(ts) as a, max(ts) as b from bars group by 1),
fs as (select market, n, a + to_days(cast(10 + 3 * n as int)) as test_start, b from span, (select unnest(range(0, 30)) as n)),
fo as (select market, n, test_start - interval 10 day as train_start, test_start, test_start + interval 3 day as test_end from fs where test_start + interval 3 day <= b),
rn as (select *, row_number() over (partition by market order by ts) as rn from bars),
bef as (select fo.market, fo.n, max(rn) filter (where ts < test_start and ts >= train_start) as last_rn from fo join rn using (market) group by 1, 2),
asg as (select rn.*, fo.n, fo.train_start, fo.test_start, fo.test_end, case when ts >= test_start then 'test' when rn > last_rn - 16 then 'purged' else 'train' end as role from fo join bef using (market, n) join rn on rn.market = fo.market and ts >= train_start and ts < test_end),
plan0 as (select market, n, train_start, test_start, test_end, count(*) filter (where role = 'train' and causal_valid) as n_train, count(*) filter (where role = 'purged') as n_purged, count(*) filter (where role = 'test' and causal_valid) as n_test, max(ts) filter (where role = 'train') as purged_train_end from asg group by 1, 2, 3, 4, 5),
plan as (select *, cast(row_number() over (partition by market order by n) as int) as fold from plan0 where n_train > 0 and n_test > 0)"""


def fold_rows(spark, sf_dir) -> DataFrame:
    return tick_bars(spark, sf_dir).withColumn("eligible", _c("causal_valid"))


@query("wf_folds", f"with {FOLDS} select market, fold, train_start, test_start, test_end, n_train, n_purged, n_test, purged_train_end from plan")
def wf_folds(spark, sf_dir):
    return splits.plan(fold_rows(spark, sf_dir), _W, ["bar"]).select("market", "fold", "train_start", "test_start", "test_end", "n_train", "n_purged", "n_test", "purged_train_end")


@query("wf_masks", f"with {FOLDS} select market, bar, cast(n as int) as n, role from asg")
def wf_masks(spark, sf_dir):
    return splits.assign(fold_rows(spark, sf_dir), _W, ["bar"]).select("market", "bar", "n", "role")


@query("wf_overlap_guard", f"with {FOLDS}, e as (select market, n, max(ts) filter (where role = 'train') as a, min(ts) filter (where role = 'test') as b from asg group by 1, 2) select count(*) filter (where a >= b) as overlapping, count(*) as folds from e")
def wf_overlap(spark, sf_dir):
    a = splits.assign(fold_rows(spark, sf_dir), _W, ["bar"])
    return splits.overlap_guard(a).agg(F.count("*").alias("overlapping")).crossJoin(a.select("market", "n").distinct().agg(F.count("*").alias("folds")))


@query("wf_row_eligibility", f"with {LABELS} select market, count(*) filter (where valid) as eligible from lab group by 1")
def wf_eligible(spark, sf_dir):
    return splits.eligible(labeled(spark, sf_dir).select("market", "target_valid")).groupBy("market").agg(F.count_if("eligible").alias("eligible"))


@query("wf_fold_validate", f"with {FOLDS} select count(*) as n, count(*) filter (where not (train_start < purged_train_end and purged_train_end < test_start and test_start < test_end)) as disordered from plan")
def wf_validate(spark, sf_dir):
    ok = (_c("train_start") < _c("purged_train_end")) & (_c("purged_train_end") < _c("test_start")) & (_c("test_start") < _c("test_end"))
    return splits.plan(fold_rows(spark, sf_dir), _W, ["bar"]).agg(F.count("*").alias("n"), F.count_if(~ok).alias("disordered"))


@query("wf_fold_select", f"with {FOLDS} select market, fold from plan where market in ('ES', 'CL') and fold <= 3")
def wf_select(spark, sf_dir):
    return splits.plan(fold_rows(spark, sf_dir), _W, ["bar"]).where(_c("market").isin("ES", "CL") & (_c("fold") <= 3)).select("market", "fold")


@query("wf_combine_shards", f"with {FOLDS} select market, fold from plan where fold % 2 = 0")
def wf_combine(spark, sf_dir):
    p = splits.plan(fold_rows(spark, sf_dir), _W, ["bar"]).select("market", "fold")
    return splits.missing_folds(p, p.where("fold % 2 = 1"))


@query("wf_policy", "select * from (values (0, ''), (1, 'random_splits,purge_bars')) t(i, problems)")
def wf_policy(spark, sf_dir):
    cases = [{"purge_bars": 16, "entry_lag_bars": 1, "target_horizon_bars": 15}, {"random_splits": True, "purge_bars": 3, "entry_lag_bars": 1, "target_horizon_bars": 15}]
    return spark.createDataFrame([(i, ",".join(splits.policy_problems(c))) for i, c in enumerate(cases)], "i int, problems string")


@query("wf_split_group", "select * from (values (2024, 'research'), (2025, 'final_holdout'), (2026, 'forward'), (2027, 'invalid')) t(year, split)")
def wf_group(spark, sf_dir):
    return spark.createDataFrame([(y, splits.split_group(y, {2025, 2027}, {2026, 2027})) for y in range(2024, 2028)], "year int, split string")


@query("wf_window_config", "select * from (values ('smoke', 90, 15, 15), ('recent', 365, 30, 30), ('long', 730, 30, 30)) t(profile, train_days, test_days, step_days)")
def wf_config(spark, sf_dir):
    return spark.createDataFrame([(k, w.train_days, w.test_days, w.step_days) for k, w in splits.PROFILES.items()], "profile string, train_days int, test_days int, step_days int")


@query("wf_skip_unavailable", "select m as market, cast(y as int) as year from (values ('RTY', 2017), ('SR3', 2018), ('ES', 2010)) a(m, since), (select unnest(range(2016, 2020)) as y) where y >= since")
def wf_skip(spark, sf_dir):
    grid = joins.full_key_grid(spark.createDataFrame([("RTY", 2017), ("SR3", 2018), ("ES", 2010)], "market string, since int"), spark.range(2016, 2020).select(_c("id").cast("int").alias("year")))
    return grid.where("year >= since").select("market", "year")


# models: a feature frame of past returns per fold


_X = f"""{FOLDS}, x0 as (select market, bar, ts, close / lag(close, 1) over w - 1 as x1, close / lag(close, 5) over w - 1 as x2, volume::double as x3, lead(close, 1) over w / close - 1 as y from bars window w as (partition by market order by ts)),
x as (select market, bar, x1, x2, x3, y from x0 where y is not null), xt as (select asg.market || '_' || asg.n as key, asg.market, asg.n, asg.bar, role, x1, x2, x3, y from asg join x using (market, bar))"""
_XS = ["x1", "x2", "x3"]


def model_rows(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("market").orderBy("ts", "bar")
    past = lambda k: _c("close") / F.lag("close", k).over(w) - 1
    df = fold_rows(spark, sf_dir).withColumns({"x1": past(1), "x2": past(5), "x3": _c("volume").cast("double"), "y": F.lead("close", 1).over(w) / _c("close") - 1})
    a = splits.assign(df, _W, ["bar"]).where(_c("y").isNotNull())
    return a.withColumn("key", F.concat_ws("_", "market", _c("n").cast("string")))


@query("ml_imputer_median", f"with {_X} select key, {q('coalesce(quantile_cont(x1, 0.5), 0)')} as x1, {q('coalesce(quantile_cont(x2, 0.5), 0)')} as x2, {q('coalesce(quantile_cont(x3, 0.5), 0)')} as x3 from xt where role = 'train' group by 1")
def ml_imputer(spark, sf_dir):
    s = models.scaling(stage(model_rows(spark, sf_dir).where("role = 'train'").select("key", *_XS), "train-rows"), _XS, ["key"])
    return s.select(*out("key", x1=_c("x1__med"), x2=_c("x2__med"), x3=_c("x3__med")))


@query("ml_standard_scaler", f"with {_X}, m as (select key, coalesce(quantile_cont(x2, 0.5), 0) as m2 from xt where role = 'train' group by 1) select key, {q('avg(coalesce(x2, m2))')} as mean, {q('case when stddev_pop(coalesce(x2, m2)) > 1e-12 then stddev_pop(coalesce(x2, m2)) else 1 end')} as std from xt join m using (key) where role = 'train' group by 1")
def ml_scaler(spark, sf_dir):
    s = models.scaling(stage(model_rows(spark, sf_dir).where("role = 'train'").select("key", *_XS), "train-rows"), _XS, ["key"])
    return s.select(*out("key", mean=_c("x2__mean"), std=_c("x2__std")))


@query("ml_ridge_1d", f"with {_X}, s as (select key, count(*) as n, avg(x3) as mx, stddev_pop(x3) as sx, avg(y) as my, avg(x3 * y) as mxy from xt where role = 'train' group by 1) select key, {q('n * (mxy - mx * my) / sx / (n + 1)')} as slope, {q('my')} as intercept from s")
def ml_ridge_1d(spark, sf_dir):
    r = models.ridge_1d(model_rows(spark, sf_dir).where("role = 'train'"), "x3", "y", ["key"])
    return r.select(*out("key", slope=_c("slope"), intercept=_c("intercept")))


def _fitted(spark, sf_dir):
    """Scaled rows of every fold, written once: each step of a fit reads them again."""
    rows = stage(model_rows(spark, sf_dir).select("key", "market", "n", "bar", "role", *_XS, "y"), "model-rows")
    stats = models.scaling(rows.where("role = 'train'"), _XS, ["key"])
    return stage(models.scaled(rows, stats, _XS, ["key"]), "scaled-rows")


#: the normal equations of three scaled features by Cramer's rule; scaled training features have mean 0, so the intercept is the mean of y
_RIDGE = f"""{_X}, rm as (select key, {', '.join(f'coalesce(quantile_cont({x}, 0.5), 0) as m{i}' for i, x in enumerate(_XS, 1))} from xt where role = 'train' group by 1),
rf as (select key, market, n, bar, role, y, {', '.join(f'coalesce({x}, m{i}) as f{i}' for i, x in enumerate(_XS, 1))} from xt join rm using (key)),
rs as (select key, {', '.join(f'avg(f{i}) as a{i}, case when stddev_pop(f{i}) > 1e-12 then stddev_pop(f{i}) else 1 end as s{i}' for i in (1, 2, 3))} from rf where role = 'train' group by 1),
rz as (select key, market, n, bar, role, y, {', '.join(f'(f{i} - a{i}) / s{i} as z{i}' for i in (1, 2, 3))} from rf join rs using (key)),
rg as (select key, avg(y) as ym, {', '.join(f'sum(z{i} * y) as b{i}, sum(z{i} * z{i}) + 1 as g{i}{i}' for i in (1, 2, 3))}, sum(z1 * z2) as g12, sum(z1 * z3) as g13, sum(z2 * z3) as g23 from rz where role = 'train' group by 1),
rd as (select *, g11 * (g22 * g33 - g23 * g23) - g12 * (g12 * g33 - g23 * g13) + g13 * (g12 * g23 - g22 * g13) as det from rg),
rw as (select key, ym, (b1 * (g22 * g33 - g23 * g23) - g12 * (b2 * g33 - g23 * b3) + g13 * (b2 * g23 - g22 * b3)) / det as w1, (g11 * (b2 * g33 - g23 * b3) - b1 * (g12 * g33 - g23 * g13) + g13 * (g12 * b3 - b2 * g13)) / det as w2,
    (g11 * (g22 * b3 - b2 * g23) - g12 * (g12 * b3 - b2 * g13) + b1 * (g12 * g23 - g22 * g13)) / det as w3 from rd)"""


@query("ml_ridge", f"with {_RIDGE} select market, cast(n as int) as n, bar, {q('ym + w1 * z1 + w2 * z2 + w3 * z3')} as y_pred from rz join rw using (key) where role = 'test'")
def ml_ridge(spark, sf_dir):
    rows = _fitted(spark, sf_dir)
    w = models.ridge(rows.where("role = 'train'"), len(_XS))
    return models.predict(rows.where("role = 'test'"), w).select("market", "n", "bar", S.quantize("y_pred").alias("y_pred"))


@query("ml_softmax")
def ml_softmax(spark, sf_dir):
    rows = _fitted(spark, sf_dir).withColumn("y", F.when(F.abs("y") <= 0.001, 0).otherwise(F.signum("y")).cast("double"))
    w, _ = models.classifier(rows.where("role = 'train'"), len(_XS))
    return models.predict_classes(rows.where("role = 'test'"), w).select("market", "n", "bar", "p_short", "p_flat", "p_long")


#: features of the registered fits; a fit takes any of the 122
FIT_FEATURES = [f"feature_{x}" for x in ("ret_1", "ret_5", "range_norm", "volume_z_20", "session_vwap_dist", "efficiency_ratio_15")]


def fitted_predictions(spark, sf_dir, hours: int = 1) -> DataFrame:
    """Features and labels of minute bars, some hours of the fold clock for each bar so that folds of days fit."""
    df = feature_frame(spark, sf_dir).withColumn("ts", F.timestamp_add("HOUR", _c("bar") * hours, F.lit("2024-01-01").cast("timestamp_ntz")))
    return walkforward.predictions(splits.assign(walkforward.used(df, FIT_FEATURES), _W), FIT_FEATURES)


@query("ml_fitted_frame")
def ml_fitted_frame(spark, sf_dir):
    return fitted_predictions(spark, sf_dir)


@query("wf_fitted_policy")
def wf_fitted_policy(spark, sf_dir):
    wide = walkforward.to_policy(fitted_predictions(spark, sf_dir))
    return policy.metrics(policy.frame(wide, costs(spark)))


@query("ml_logistic")
def ml_logistic(spark, sf_dir):
    rows = _fitted(spark, sf_dir).withColumn("y", (_c("y") > 0).cast("double"))
    w, _ = models.logistic(rows.where("role = 'train'"), len(_XS))
    return models.predict(rows.where("role = 'test'"), w, logit=True).select("market", "n", "bar", _c("y_pred").alias("p_long"))


@query("ml_convergence_guard", f"with {_X} select true as converged, count(distinct key) as folds from xt")
def ml_convergence(spark, sf_dir):
    rows = _fitted(spark, sf_dir).withColumn("y", (_c("y") > 0).cast("double"))
    w, ok = models.logistic(rows.where("role = 'train'"), len(_XS))
    return w.agg(F.lit(ok).alias("converged"), F.count("*").alias("folds"))


@query("ml_dummy_prior", f"with {_X} select key, {q('avg(cast(sign(y) = -1 as int))')} as p_short, {q('avg(cast(sign(y) = 0 as int))')} as p_flat, {q('avg(cast(sign(y) = 1 as int))')} as p_long from xt where role = 'train' group by 1")
def ml_prior(spark, sf_dir):
    p = models.class_priors(model_rows(spark, sf_dir).where("role = 'train'").withColumn("s", F.signum("y").cast("int")), "s", ["key"])
    return _quantized(p.drop("n_classes"), ["p_short", "p_flat", "p_long"])


@query("ml_proba_columns", f"{_BP} select market, bar, {q('p_long')} as a, {q('p_short')} as b, {q('p_flat')} as c from preds")
def ml_proba(spark, sf_dir):
    probs = preds(spark, sf_dir).withColumn("probability", F.array("p_short", "p_flat", "p_long"))
    return probs.select(*out("market", "bar", a=_c("probability")[2], b=_c("probability")[0], c=_c("probability")[1]))


@query("ml_collapse_guard", f"{_BP} select market, fold_id, coalesce(stddev_pop(case when fold_id = 2 then 0.5 else p_long end) <= 1e-9, true) as collapsed from preds group by 1, 2")
def ml_collapse(spark, sf_dir):
    p = preds(spark, sf_dir).withColumn("p", F.when(_c("fold_id") == 2, 0.5).otherwise(_c("p_long")))
    return models.collapsed(p, "p", ["market", "fold_id"]).select("market", "fold_id", "collapsed")


@query("ml_registry", "select * from (values ('direction_logistic', 'logistic', true), ('return_ridge', 'ridge', true), ('fade_logistic', 'logistic', true), ('trend_logistic', 'logistic', true)) t(model_id, family, enabled)")
def ml_registry(spark, sf_dir):
    found = [("return_ridge", "ridge", True), ("direction_logistic", "logistic", True), ("fade_logistic", "logistic", True), ("trend_logistic", "logistic", True), ("boosted", "gbm", False)]
    return spark.createDataFrame([r for r in found if r[2] and r[1] in ("ridge", "logistic")], "model_id string, family string, enabled boolean")


@query("ml_prediction_frame", f"{_BP}, t(target) as (values ('return'), ('direction'), ('fade'), ('trend')) select market, bar, target, {q('''case target when 'return' then expected_return when 'direction' then p_long when 'fade' then p_fade else p_trend end''')} as raw from preds, t")
def ml_frame(spark, sf_dir):
    long_ = policy.to_long(preds(spark, sf_dir))
    raw = F.coalesce("expected_return", "p_long", "p_fade", "p_trend")
    return long_.select("market", "bar", _c("target_name").alias("target"), S.quantize(raw).alias("raw"))


@query("ml_dup_check", f"{_BP}, d as (select market, bar, fold_id from preds union all select market, bar, fold_id from preds where bar % 100 = 0) select count(*) - count(distinct (market, bar, fold_id)) as duplicates from d")
def ml_dups(spark, sf_dir):
    p = preds(spark, sf_dir).select("market", "bar", "fold_id")
    both = p.unionByName(p.where("bar % 100 = 0"))
    return both.agg((F.count("*") - F.count_distinct(F.struct("market", "bar", "fold_id"))).alias("duplicates"))


@query("ml_manifest_evidence", f"{_BP} select count(*) as prediction_count, 0 as failure_count, count(*) > 0 as ready from preds")
def ml_manifest(spark, sf_dir):
    return preds(spark, sf_dir).agg(F.count("*").alias("prediction_count"), F.lit(0).alias("failure_count"), (F.count("*") > 0).alias("ready"))


_HY = f"""{_BP}, r as (select *, exit_price / entry_price - 1 as act, row_number() over (partition by market, fold_id order by abs(expected_return) desc, bar) as rk, count(*) over (partition by market, fold_id) as c from preds),
    f as (select market, fold_id, {{0}} from r group by 1, 2)"""


@query("hy_fold_metrics", _HY.format(f"{q('avg(cast(sign(expected_return) = sign(act) as int))')} as signed_accuracy, {q('sum(sign(expected_return) * act)')} as all_gross, {q('sum(case when rk <= ceil(0.2 * c) then sign(expected_return) * act end)')} as top_gross") + " select * from f")
def hy_metrics(spark, sf_dir):
    return _quantized(_hypothesis(spark, sf_dir), ["signed_accuracy", "all_gross", "top_gross"])


def _hypothesis(spark, sf_dir):
    p = preds(spark, sf_dir).withColumn("act", _c("exit_price") / _c("entry_price") - 1)
    w = Window.partitionBy("market", "fold_id")
    p = p.withColumns({"rk": F.row_number().over(w.orderBy(F.abs("expected_return").desc(), "bar")), "c": F.count("*").over(w)})
    gain = F.signum("expected_return") * _c("act")
    return p.groupBy("market", "fold_id").agg(
        F.avg((F.signum("expected_return") == F.signum("act")).cast("int")).alias("signed_accuracy"), F.sum(gain).alias("all_gross"), F.sum(F.when(_c("rk") <= F.ceil(0.2 * _c("c")), gain)).alias("top_gross")
    )


@query("hy_harness", _HY.format("sum(case when rk <= ceil(0.2 * c) then sign(expected_return) * act end) as g") + f" select market, {q('sum(g) filter (where fold_id < 2)')} as discovery, {q('sum(g) filter (where fold_id >= 2)')} as confirmation, coalesce(sum(g) filter (where fold_id < 2) > 0 and sum(g) filter (where fold_id >= 2) > 0, false) as graduates from f group by 1")
def hy_harness(spark, sf_dir):
    a, b = (F.sum(F.when(cond, _c("top_gross"))) for cond in (_c("fold_id") < 2, _c("fold_id") >= 2))
    g = _hypothesis(spark, sf_dir).groupBy("market").agg(a.alias("discovery"), b.alias("confirmation"), F.coalesce((a > 0) & (b > 0), F.lit(False)).alias("graduates"))
    return _quantized(g, ["discovery", "confirmation"])


# audits


def _aud(name: str, keys: list[str], sql_keys: str | None = None, prepare=None, where: str | None = None) -> None:
    cols = sql_keys or ", ".join(keys)

    @query(name, f"with {POLICY} select {cols}, {_SL} from pf {'where ' + where if where else ''} group by {', '.join(str(i + 1) for i in range(len(keys)))}")
    def run(spark, sf_dir):
        df = frame(spark, sf_dir)
        df = df.where(where) if where else df
        return _slice(spark, sf_dir, keys, prepare(df) if prepare else df)


_aud("aud_policy_slices", ["market", "fold_id", "position", "reason"])
_aud("aud_trade_slices", ["market", "side", "hour"], "market, side, cast(hour(ts) as int) as hour", lambda d: d.withColumn("hour", F.hour("ts")), "position <> 0")
_aud("aud_signal_slices", ["market", "side", "confidence"], f"market, side, {_CONF} as confidence", audits.with_confidence, "position <> 0")
_aud("aud_long_failure", ["market", "fold_id", "confidence"], f"market, fold_id, {_CONF} as confidence", audits.with_confidence, "position > 0")
_aud("aud_threshold_slices", ["fold_id", "side"])


@query("aud_cost_counterfactuals", f"with {POLICY}, s(scenario, a, b) as (values " + ", ".join(f"('{n}', {a}::double, {b}::double)" for n, a, b in audits.COST_SCENARIOS) + f") select market, scenario, {q('sum(gross - a * commission - b * slip)')} as net from pf, s group by 1, 2")
def aud_costs(spark, sf_dir):
    return _quantized(audits.cost_counterfactuals(frame(spark, sf_dir)), ["net"])


@query("aud_blocked_opportunity", f"with {POLICY}, b as (select *, base * (exit_price - entry_price) * point_value - cost_ticks * tick_value as missed from pf where position = 0 and base <> 0) select market, reason, count(*) as n, {q('sum(missed)')} as missed_net, {q('avg(cast(missed > 0 as int))')} as would_win from b group by 1, 2")
def aud_blocked(spark, sf_dir):
    return _quantized(audits.blocked(frame(spark, sf_dir)), ["missed_net", "would_win"])


_G = ([0.0, 0.05, 0.1, 0.2, 0.4], [0.3, 0.4, 0.5, 0.6, 0.7], [0.3, 0.5, 0.7, 0.9])


@query("aud_threshold_grid", f"with {POLICY}, g as (select * from " + ", ".join(f"(values {', '.join(f'({v}::double)' for v in vs)}) t{i}({n})" for i, (n, vs) in enumerate(zip(("margin", "fade", "trend"), _G, strict=True))) + f"), x as (select *, case when p_long - p_short >= 0 then 1 else -1 end * (exit_price - entry_price) * point_value - cost_ticks * tick_value as pnl from pf) select {q('margin')} as margin, {q('fade')} as fade, {q('trend')} as trend, count(*) as trades, {q('sum(pnl)')} as net from x, g where abs(p_long - p_short) >= margin and p_fade >= fade and p_trend < trend group by margin, fade, trend")
def aud_grid(spark, sf_dir):
    return _quantized(audits.threshold_grid(frame(spark, sf_dir), *_G), ["margin", "fade", "trend", "net"])


@query("aud_block_counts", f"with {POLICY} select market, case when base = 0 then 'no_direction' when not flat_ok then 'flat' when not fade_ok then 'fade' when trend_block then 'trend' else 'trade' end as category, count(*) as n from pf group by 1, 2")
def aud_blocks(spark, sf_dir):
    df = frame(spark, sf_dir)
    return df.groupBy("market", audits.block_category(df).alias("category")).agg(F.count("*").alias("n"))


_PS = "stddev_pop(expected_return) as ps, stddev_pop(exit_price / entry_price - 1) as sa, avg(cast(sign(expected_return) = sign(exit_price / entry_price - 1) as int)) as agree, corr(expected_return, exit_price / entry_price - 1) as r"


def _scale_sql(keys: str) -> str:
    return f"with {POLICY}, s as (select {keys}, {_PS} from pf group by {keys}) select {keys}, {q('ps')} as pred_std, {q('sa')} as actual_std, {q('ps / sa')} as ratio, {q('agree')} as sign_agreement, {q('r')} as corr, case when ps / sa > 100 then 'too_large' when ps / sa < 0.01 then 'too_small' end as warning from s"


def _scale(spark, sf_dir, keys):
    df = frame(spark, sf_dir).withColumn("act", _c("exit_price") / _c("entry_price") - 1)
    return _quantized(audits.prediction_scale(df, keys, "expected_return", "act"), ["pred_std", "actual_std", "ratio", "sign_agreement", "corr"])


@query("aud_return_scale", _scale_sql("market"))
def aud_scale(spark, sf_dir):
    return _scale(spark, sf_dir, ["market"])


@query("aud_return_outliers", _scale_sql("market, fold_id"))
def aud_outliers(spark, sf_dir):
    return _scale(spark, sf_dir, ["market", "fold_id"])


@query("aud_outlier_replay", f"with {_X}, s as (select key, avg(x3) as m, stddev_pop(x3) as sd, min(x3) as lo, max(x3) as hi, avg(y) as my, avg(x3 * y) as mxy, count(*) as n from xt where role = 'train' group by 1), p as (select xt.market, xt.n as fold, bar, s.n * (mxy - m * my) / sd / (s.n + 1) * (x3 - m) / sd as contribution, x3 < lo or x3 > hi as outside from xt join s using (key) where role = 'test') select market, cast(fold as int) as fold, bar, {q('contribution')} as contribution, outside from p")
def aud_replay(spark, sf_dir):
    rows = model_rows(spark, sf_dir)
    train = rows.where("role = 'train'")
    fit = models.ridge_1d(train, "x3", "y", ["key"])
    stats = train.groupBy("key").agg(F.avg("x3").alias("m"), F.stddev_pop("x3").alias("sd"), F.min("x3").alias("lo"), F.max("x3").alias("hi"))
    df = rows.where("role = 'test'").join(fit, "key").join(stats, "key")
    part = _c("slope") * (_c("x3") - _c("m")) / _c("sd")
    return df.select("market", _c("n").alias("fold"), "bar", S.quantize(part).alias("contribution"), ((_c("x3") < _c("lo")) | (_c("x3") > _c("hi"))).alias("outside"))


@query("aud_label_feature", f"with {POLICY} select market, y_sign, count(*) as n, {q('avg(p_fade)')} as fade_mean, {q('avg(cast(position = y_sign as int))')} as aligned from pf group by 1, 2")
def aud_labels(spark, sf_dir):
    g = frame(spark, sf_dir).groupBy("market", "y_sign").agg(F.count("*").alias("n"), F.avg("p_fade").alias("fade_mean"), F.avg((_c("position") == _c("y_sign")).cast("int")).alias("aligned"))
    return _quantized(g, ["fade_mean", "aligned"])


def _cut_sql(x: str, edges: list[float]) -> str:
    inner = "".join(f" when {x} <= {b} then '({a:g},{b:g}]'" for a, b in zip(edges, edges[1:]))  # noqa: B905
    return f"case when {x} is null then 'missing' when {x} <= {edges[0]} then '<={edges[0]:g}'{inner} else '>{edges[-1]:g}' end"


_TOP = "case when p_short >= p_flat and p_short >= p_long then -1 when p_flat >= p_long then 0 else 1 end"
_AL = f"""{POLICY}, al0 as (select *, abs(p_long - p_short) as margin, cast(sign(exit_price - entry_price) as int) as came, {_TOP} as top from pf),
al as (select *, {', '.join(f'{_cut_sql(x, e)} as {x}_bucket' for x, e in audits.SIGNAL_BUCKETS.items())}, case when base <> 0 and trend_block then 'trend_danger_block' when base <> 0 and not fade_ok then 'fade_filter_block' when base = 0 then 'no_direction' when position <> 0 then 'traded' else 'other' end as gate,
    case when base > 0 then 'long' when base < 0 then 'short' else 'flat' end as base_side, base * (exit_price - entry_price) * point_value as base_gross, base * (exit_price - entry_price) * point_value - case when base <> 0 then cost_ticks * tick_value else 0 end as base_net,
    -position * (exit_price - entry_price) * point_value as inverted_gross, case when position <> 0 then -position * (exit_price - entry_price) * point_value - cost_ticks * tick_value else 0 end as inverted_net from al0)"""
_AL_COUNTS = {"n_rows": "true", "base_signals": "base <> 0", "trades": "position <> 0", "blocked": "base <> 0 and position = 0", "longs": "position = 1", "shorts": "position = -1", "mismatches": "position <> 0 and position <> base"}
_AL_FLOATS = {"gross": "sum(gross)", "cost": "sum(cost)", "net": "sum(net)", "base_gross": "sum(base_gross)", "base_net": "sum(base_net)", "gate_delta": "sum(net) - sum(base_net)", "trade_rate": "count(*) filter (where position <> 0) / nullif(count(*) filter (where base <> 0), 0)"}
_AL_FLOATS |= {
    n: f"avg(cast({hit} as int)) filter (where {where})"
    for n, hit, where in (
        ("target_accuracy", "position = y_sign", "position <> 0"),
        ("realized_accuracy", "position = came", "position <> 0"),
        ("target_inverted", "position = -y_sign", "position <> 0 and y_sign <> 0"),
        ("realized_inverted", "position = -came", "position <> 0 and came <> 0"),
        ("base_accuracy", "base = y_sign", "base <> 0"),
        ("blocked_accuracy", "base = y_sign", "base <> 0 and position = 0"),
        ("top_accuracy_traded", "top = y_sign", "position <> 0"),
        ("top_accuracy", "top = y_sign", "true"),
    )
}
_AL_FLOATS |= {f"mean_{x}": f"avg({x}) filter (where position <> 0)" for x in ("margin", "p_long", "p_short", "p_fade", "p_trend")}
_AL_SCOPES = {"overall": [], "market": ["market"], "market_side": ["market", "side"], "market_fold": ["market", "fold_id"]} | {f"{x}_bucket": [f"{x}_bucket", "side"] for x in audits.SIGNAL_BUCKETS} | {"gate": ["gate", "base_side"]}
_AL_KEYS = sorted({k for v in _AL_SCOPES.values() for k in v})
_AL_SELECT = ", ".join([*[f"count(*) filter (where {x}) as n_{n}" if n != "n_rows" else "count(*) as n_rows" for n, x in _AL_COUNTS.items()], *[f"{q(x)} as {n}" for n, x in _AL_FLOATS.items()]])


@query("aud_signal_alignment", f"with {_AL} " + " union all ".join(f"select '{n}' as scope, " + ", ".join(k if k in ks else f"null as {k}" for k in _AL_KEYS) + f", {_AL_SELECT} from al " + (f"group by {', '.join(ks)}" if ks else "") for n, ks in _AL_SCOPES.items()))
def aud_alignment(spark, sf_dir):
    out_ = metrics.by_scopes(audits.with_alignment(frame(spark, sf_dir)), _AL_SCOPES, audits.alignment_measures())
    return _quantized(out_, list(_AL_FLOATS)).withColumnsRenamed({n: f"n_{n}" for n in _AL_COUNTS if n != "n_rows"})


@query("aud_signal_inversion", f"with {_AL} select count(*) as trades, {q('sum(gross)')} as gross, {q('sum(net)')} as net, {q('sum(inverted_gross)')} as inverted_gross, {q('sum(inverted_net)')} as inverted_net, {q('sum(inverted_net) - sum(net)')} as delta, {q('avg(cast(position = y_sign as int))')} as target_accuracy, {q('avg(cast(-position = y_sign as int))')} as target_accuracy_inverted, {q('avg(cast(position = came as int))')} as realized_accuracy, {q('avg(cast(-position = came as int))')} as realized_accuracy_inverted from al where position <> 0")
def aud_inversion(spark, sf_dir):
    one = audits.inversion(audits.with_alignment(frame(spark, sf_dir)))
    return _quantized(one, [x for x in one.columns if x != "trades"])


_ED_FLOATS = {"gross": "sum(pos * pnl)", "cost": "sum(cost_ticks * tick_value)", "net": "sum(pos * pnl - cost_ticks * tick_value)"}
_ED_MEANS = {"target_accuracy": "avg(cast(pos = y_sign as int))", "realized_accuracy": "avg(cast(pos = came as int))", "mean_flat": "avg(p_flat)", "mean_margin": "avg(abs(d))", "mean_lead": "avg(greatest(p_long, p_short) - p_flat)"}
_ED = f"""{POLICY}, sp(mode, margin, flat_margin, max_flat) as (values {', '.join(f"('{m}', {a}::double, {'null' if f is None else f}::double, {'null' if x is None else x}::double)" for m, a, f, x in audits.EDGE_SCENARIOS)}),
ex as (select *, p_long - p_short as d, {_TOP} as top, cast(sign(exit_price - entry_price) as int) as came, (exit_price - entry_price) * point_value as pnl from pf where fade_ok and not trend_block),
ep0 as (select *, case mode when 'current_margin' then case when d >= margin then 1 when d <= -margin then -1 end
    when 'direction_beats_flat' then case when d >= margin and p_long - p_flat >= flat_margin then 1 when p_short - p_long >= margin and p_short - p_flat >= flat_margin then -1 end
    else case when top = 1 and d >= margin then 1 when top = -1 and d <= -margin then -1 end end as pos from ex, sp),
ep as (select * from ep0 where pos is not null and (max_flat is null or p_flat <= max_flat)),
es as (select sp.mode, sp.margin, sp.flat_margin, sp.max_flat, count(pos) as trades, count(*) filter (where pos = 1) as longs, count(*) filter (where pos = -1) as shorts, {', '.join(f'coalesce({x}, 0) as {n}' for n, x in _ED_FLOATS.items())}, {', '.join(f'{x} as {n}' for n, x in _ED_MEANS.items())}
    from sp left join ep on sp.mode = ep.mode and sp.margin = ep.margin and sp.flat_margin is not distinct from ep.flat_margin and sp.max_flat is not distinct from ep.max_flat group by 1, 2, 3, 4)"""
_ED_ALL = ["margin", "flat_margin", "max_flat", *_ED_FLOATS, *_ED_MEANS]


@query("aud_direction_calibration", f"with {_ED} select mode, trades, longs, shorts, {', '.join(f'{q(x)} as {x}' for x in _ED_ALL)} from es")
def aud_direction(spark, sf_dir):
    return _quantized(audits.edge_scenarios(frame(spark, sf_dir)), _ED_ALL)


@query("aud_decisions", f"with {_ED} select mode, {q('margin')} as margin, trades from es where trades >= 100 and net > 0 order by net desc, mode, es.margin, flat_margin nulls first, max_flat nulls first limit 1")
def aud_decisions(spark, sf_dir):
    best = audits.decision(audits.edge_scenarios(frame(spark, sf_dir)).select("mode", "margin", "flat_margin", "max_flat", "trades", "net"))
    return best.select("mode", S.quantize("margin").alias("margin"), "trades")


_MR = f"{POLICY}, mr0 as (select *, base * expected_return * entry_price * point_value as edge from pf), mr1 as (select *, case when base = 0 then 0 when coalesce(p_trend >= 0.5, true) then 0 when edge >= cost_ticks * tick_value then base else 0 end as op from mr0), mr as (select *, op * (exit_price - entry_price) * point_value - case when op <> 0 then cost_ticks * tick_value else 0 end as onet from mr1)"


@query("aud_mr_tail", f"with {_MR}, e as (select market, quantile_cont(onet, 0.05) as e5, quantile_cont(onet, 0.01) as e1 from mr where op <> 0 group by 1) select market, count(*) as trades, {q('sum(onet)')} as net, {q('avg(onet) filter (where onet <= e5)')} as cvar95, {q('avg(onet) filter (where onet <= e1)')} as cvar99 from mr join e using (market) where op <> 0 group by 1")
def aud_tail(spark, sf_dir):
    t = audits.tail_overlay(frame(spark, sf_dir)).where("overlay_position <> 0")
    g = t.groupBy("market").agg(F.count("*").alias("trades"), F.sum("overlay_net").alias("net"))
    for level, name in ((0.95, "cvar95"), (0.99, "cvar99")):
        g = g.join(metrics.cvar(t, "overlay_net", ["market"], level, name), "market")
    return _quantized(g, ["net", "cvar95", "cvar99"])


def _replayed(spark, sf_dir) -> DataFrame:
    """The five most extreme test rows of each fold, by feature."""
    raw = stage(model_rows(spark, sf_dir).select("key", "market", "n", "bar", "role", *_XS, "y"), "replay-rows")
    train = raw.where("role = 'train'")
    # raw features stay beside the scaled ones
    rows = stage(models.scaled(raw, models.scaling(train, _XS, ["key"]), _XS, ["key"]), "replay-scaled")
    w = models.ridge(rows.where("role = 'train'"), len(_XS))
    extreme = replay.outliers(models.predict(rows.where("role = 'test'"), w), 5)
    return replay.contributions(extreme, w, replay.training_ranges(train, _XS), _XS)


_REPLAY = f"""{_RIDGE}, ox_r as (select key, {', '.join(f'min({x}) as lo{i}, max({x}) as hi{i}' for i, x in enumerate(_XS, 1))} from xt where role = 'train' group by 1),
ox_p as (select rz.*, w1, w2, w3, ym, ym + w1 * z1 + w2 * z2 + w3 * z3 as y_pred from rz join rw using (key) where role = 'test'),
ox_n as (select *, row_number() over (partition by key order by abs(y_pred) desc, bar) as nth from ox_p),
ox as (select ox_n.*, {', '.join(f'xt.x{i} as v{i}, lo{i}, hi{i}' for i in (1, 2, 3))}, abs(w1 * z1) + abs(w2 * z2) + abs(w3 * z3) as size from ox_n join ox_r using (key) join xt on xt.key = ox_n.key and xt.bar = ox_n.bar and xt.role = 'test' where nth <= 5)"""


@query(
    "aud_outlier_contributions",
    f"with {_REPLAY} " + " union all ".join(f"select market, cast(n as int) as n, bar, cast(nth as int) as nth, 'x{i}' as feature, {q(f'v{i}')} as value, {q(f'z{i}')} as scaled, {q(f'w{i} * z{i} * 1000')} as added, {q(f'abs(w{i} * z{i}) / nullif(size, 0)')} as share, coalesce(v{i} < lo{i} or v{i} > hi{i}, false) as outside, {q('y_pred * 1000')} as y_pred from ox" for i in (1, 2, 3)),
)
def aud_contributions(spark, sf_dir):
    return _replayed(spark, sf_dir).select("market", "n", "bar", "nth", "feature", *[S.quantize(c).alias(c) for c in ("value", "scaled", "share")], S.quantize(_c("added") * 1000).alias("added"), "outside", S.quantize(_c("y_pred") * 1000).alias("y_pred"))


@query("aud_outlier_reconciliation", f"with {_REPLAY} select market, cast(n as int) as n, count(*) as n_rows, true as agree, cast(sum(cast(coalesce(v1 < lo1 or v1 > hi1, false) or coalesce(v2 < lo2 or v2 > hi2, false) or coalesce(v3 < lo3 or v3 > hi3, false) as int)) as bigint) as n_outside from ox group by 1, 2")
def aud_reconciliation(spark, sf_dir):
    """Whether contributions add up to the predictions, and how many extreme rows lie beyond the training range of any feature."""
    parts = stage(_replayed(spark, sf_dir), "replay-parts")
    whole = replay.reconciled(parts, by=("market", "n", "bar"))
    beyond = parts.groupBy("market", "n", "bar").agg(F.max("outside").alias("outside"))
    return whole.join(beyond, ["market", "n", "bar"]).groupBy("market", "n").agg(F.count("*").alias("n_rows"), F.min("agrees").alias("agree"), F.count_if("outside").alias("n_outside"))


# the whole tail audit: a buffer of 5 dollars, and an escape for blocked trades with 50 more

_GATES = tail.Gates(buffer=5.0, escape=True, escape_edge=50.0)
_TAIL = f"""{POLICY},
ta0 as (select pf.*, base * expected_return * entry_price * point_value as edge, cost_ticks * tick_value + 5 as hurdle, row_number() over (order by market, fold_id, ts) as place from pf),
ta1 as (select *, coalesce(edge > hurdle, false) as clears, coalesce(p_fade >= 0.5, false) as fade_gate, coalesce(p_trend >= 0.5, true) as trend_gate,
    case when p_trend is null then 'missing' else 'd' || lpad(cast(cast(ceil(10.0 * row_number() over (partition by p_trend is null order by p_trend, place) / count(p_trend) over ()) as int) as varchar), 2, '0') end as trend_danger_decile,
    case when p_fade is null then 'missing' else 'd' || lpad(cast(cast(ceil(10.0 * row_number() over (partition by p_fade is null order by p_fade, place) / count(p_fade) over ()) as int) as varchar), 2, '0') end as fade_success_decile,
    market || '|' || session_id as session, cast(hour(ts) as int) as hour from ta0),
ta2 as (select *, case when fade_gate and clears then base else 0 end as free_position from ta1),
ta3 as (select *, free_position <> 0 and trend_gate as blocked, free_position <> 0 and trend_gate and edge > hurdle + 50 as escaped from ta2),
ta4 as (select *, case when not blocked or escaped then free_position else 0 end as overlay_position from ta3),
sc as (select *, 'mr_tail_overlay' as scenario, overlay_position as pos from ta4 union all select *, 'no_trend_danger_block' as scenario, free_position as pos from ta4),
sm as (select *, pos <> 0 as traded, pos * (exit_price - entry_price) * point_value as tgross, case when pos <> 0 then cost_ticks * tick_value else 0.0 end as tcost, case when pos <> 0 then 2 * slippage_ticks * tick_value else 0.0 end as tslip,
    abs(pos - lag(pos, 1, 0) over (partition by scenario, market, fold_id order by ts)) as tturn from sc),
tn as (select *, tgross - tcost as tnet, greatest(tcost - tslip, 0) as tcomm from sm)"""


def _tail_sql(by: list[str], where: str = "true", tail_: str = "") -> str:
    """Groups of ``tn``; a streak is the longest isle of losing trades, numbered by the count of the others."""
    keys = ", ".join(by)
    same = " and ".join(f"a.{k} is not distinct from b.{k}" for k in by)
    return f"""with {_TAIL}, tw as (select * from tn where {where}),
    te as (select {keys}, quantile_cont(tnet, 0.05) as e5, quantile_cont(tnet, 0.01) as e1 from tw where traded group by {keys}),
    tc as (select {', '.join(f'a.{k}' for k in by)}, avg(tnet) filter (where tnet <= e5) as c5, avg(tnet) filter (where tnet <= e1) as c1 from tw a join te b on {same} where traded group by all),
    ti as (select {keys}, cast(tnet < 0 as int) as lost, sum(cast(tnet >= 0 as int)) over (partition by {keys} order by place) as isle from tw where traded),
    ts_ as (select {keys}, max(run) as streak from (select {keys}, isle, sum(lost) as run from ti group by {keys}, isle) group by {keys}),
    ta as (select {keys}, count(*) as n_rows, count(*) filter (where base <> 0) as candidates, count(*) filter (where traded) as trade_count, count(*) filter (where blocked) as blocked, count(*) filter (where escaped) as escaped,
        sum(tgross) as g, sum(tslip) as sl, sum(tcomm) as cm, sum(tcost) as co, sum(tnet) as ne, cast(sum(tturn) as double) as tu, sum(tturn) / count(*) as tr, sum(tcost) / nullif(count(*) filter (where traded), 0) as cp, avg(tnet) filter (where traded) as np from tw group by {keys})
    select {', '.join(f'a.{k}' for k in by)}, n_rows, candidates, trade_count, blocked, escaped, {q('g')} as gross_sum, {q('sl')} as slippage_sum, {q('cm')} as commission_sum, {q('co')} as cost_sum, {q('ne')} as net_sum, {q('tu')} as turnover,
        {q('tr')} as turnover_per_row, {q('cp')} as cost_per_trade, {q('np')} as net_per_trade, {q('b.c5')} as cvar_95, {q('b.c1')} as cvar_99, cast(coalesce(streak, 0) as bigint) as max_losing_streak
    from ta a left join tc b on {same} left join ts_ c on {same.replace('b.', 'c.')} {tail_}"""


_TAIL_FLOATS = ["gross_sum", "slippage_sum", "commission_sum", "cost_sum", "net_sum", "turnover", "turnover_per_row", "cost_per_trade", "net_per_trade", "cvar_95", "cvar_99"]


def tail_frame(spark, sf_dir) -> DataFrame:
    return stage(tail.overlay(policy.frame(preds(spark, sf_dir), costs(spark)), _GATES), "tail-frame")


@query("aud_mr_tail_policies", _tail_sql(["scenario"]))
def aud_tail_policies(spark, sf_dir):
    """Both scenarios over the whole frame: what the trend gate changes."""
    df = tail_frame(spark, sf_dir)
    out_ = None
    for name in tail.POSITIONS:
        one = tail.summary(tail.scenario(df, name).withColumn("scenario", F.lit(name)), ["scenario"])
        out_ = one if out_ is None else out_.unionByName(one)
    return _quantized(out_, _TAIL_FLOATS)


@query("aud_mr_tail_buckets", _tail_sql(["trend_danger_decile", "fade_success_decile", "market", "hour"], "scenario = 'mr_tail_overlay'"))
def aud_tail_buckets(spark, sf_dir):
    df = tail.scenario(tail.with_deciles(tail_frame(spark, sf_dir)), "mr_tail_overlay").withColumn("hour", F.hour("ts"))
    return _quantized(tail.summary(df, ["trend_danger_decile", "fade_success_decile", "market", "hour"]), _TAIL_FLOATS)


@query("aud_mr_tail_worst_sessions", _tail_sql(["session"], "scenario = 'mr_tail_overlay'", "order by ne, a.session limit 20"))
def aud_tail_sessions(spark, sf_dir):
    return _quantized(tail.worst_sessions(tail.scenario(tail_frame(spark, sf_dir), "mr_tail_overlay")), _TAIL_FLOATS)


@query("aud_mr_tail_streaks", _tail_sql(["market"], "scenario = 'mr_tail_overlay'"))
def aud_tail_streaks(spark, sf_dir):
    return _quantized(tail.summary(tail.scenario(tail_frame(spark, sf_dir), "mr_tail_overlay"), ["market"]), _TAIL_FLOATS)


@query("aud_mr_tail_blocked", _tail_sql(["trend_danger_decile", "fade_success_decile", "market", "hour"], "scenario = 'no_trend_danger_block' and blocked"))
def aud_tail_blocked(spark, sf_dir):
    """What the trend gate blocks would have earned."""
    df = tail.scenario(tail.with_deciles(tail_frame(spark, sf_dir)), "no_trend_danger_block").where("blocked").withColumn("hour", F.hour("ts"))
    return _quantized(tail.summary(df, ["trend_danger_decile", "fade_success_decile", "market", "hour"]), _TAIL_FLOATS)


@query("aud_mae_mfe", f"with {POLICY}, m as (select market, bar, position, (low_ - entry_price) / tick_size as mae, (high_ - entry_price) / tick_size as mfe from (select pf.*, bars.low as low_, bars.high as high_ from pf join bars using (market, bar))) select market, count(*) as n, {q('avg(case when position > 0 then mae else -mfe end)')} as adverse, {q('avg(case when position > 0 then mfe else -mae end)')} as favourable from m where position <> 0 group by 1")
def aud_mae(spark, sf_dir):
    b = tick_bars(spark, sf_dir).select("market", "bar", "low", "high")
    df = frame(spark, sf_dir).join(b, ["market", "bar"]).withColumns({"mae_ticks": (_c("low") - _c("entry_price")) / _c("tick_size"), "mfe_ticks": (_c("high") - _c("entry_price")) / _c("tick_size")})
    g = audits.side_adjusted(df).where("position <> 0").groupBy("market").agg(F.count("*").alias("n"), F.avg("adverse_ticks").alias("adverse"), F.avg("favourable_ticks").alias("favourable"))
    return _quantized(g, ["adverse", "favourable"])


# validation and gates


@query("val_raw_gap_buckets", f"with {CAUSAL} select market, case when not inside then 'outside' when since_ < 120 then 'open' when until_ <= 120 then 'close' else 'middle' end as bucket, count(*) as n, count(distinct gap_id) as gaps from cv where synth group by 1, 2")
def val_gaps(spark, sf_dir):
    return validation.gap_buckets(base(spark, sf_dir))


_GW = f"{CAUSAL}, gw as (select market, gap_id, max(gap_size) as size, min(ts) as first_ts, max(ts) as last_ts from cv where synth group by 1, 2 order by size desc, market, first_ts limit 10)"


@query("val_tick_gap_plan", f"with {_GW}, b as (select gw.market, gw.gap_id, arg_max(c.instrument_id, c.ts) filter (where c.ts <= first_ts) as bi, arg_min(c.instrument_id, c.ts) filter (where c.ts >= last_ts) as ai from gw join clock_bars c using (market) group by 1, 2) select market, gap_id, first_ts - interval 5 minute as query_start, last_ts + interval 6 minute as query_end, case when bi = ai then bi end as instrument_id from gw join b using (market, gap_id)")
def val_plan(spark, sf_dir):
    df = base(spark, sf_dir)
    w = validation.gap_windows(validation.largest_gaps(df), df, 5)
    return w.select("market", _c("synthetic_gap_id").alias("gap_id"), "query_start", "query_end", "instrument_id")


@query("val_tick_gap_activity", f"with {_GW}, t as (select market, ts from clock_ticks) select gw.market, gap_id, count(t.ts) as n_ticks from gw left join t on t.market = gw.market and t.ts >= first_ts - interval 1 hour and t.ts < last_ts + interval 1 minute group by 1, 2")
def val_activity(spark, sf_dir):
    from tidemark.sources.bars import market_of

    g = validation.largest_gaps(base(spark, sf_dir)).select("market", "synthetic_gap_id", F.timestamp_add("HOUR", F.lit(-1), _c("first_ts")).alias("first_ts"), F.timestamp_add("MINUTE", F.lit(1), _c("last_ts")).alias("end_ts"))
    ticks = events(spark, sf_dir).select(market_of().alias("market"), "ts")
    return validation.gap_activity(g, ticks).select("market", _c("synthetic_gap_id").alias("gap_id"), "n_ticks")


@query("val_gap_cost_plan", f"with {_GW} select market, count(*) as requests, cast(sum(datediff('minute', first_ts, last_ts) + 1) as bigint) as minutes from gw group by 1")
def val_cost(spark, sf_dir):
    g = validation.largest_gaps(base(spark, sf_dir))
    return g.groupBy("market").agg(F.count("*").alias("requests"), F.sum(S.minutes_between("last_ts", "first_ts") + 1).cast("long").alias("minutes"))


@query("val_coverage_days", f"with {CLOCK}, e as (select m as market, d::date as day from (values ('ES'), ('CL'), ('XX')) a(m), (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-05', interval 1 day)) as d)), f as (select distinct market, cast(ts as date) as day from clock_bars where ts < timestamp '2024-01-04' and market in ('ES', 'CL', 'ZN')) select coalesce(e.market, f.market) as market, coalesce(e.day, f.day) as day, case when e.market is null then 'extra' when f.market is not null then 'present' when e.market = 'XX' then 'unavailable' else 'missing' end as status from e full join f on e.market = f.market and e.day = f.day")
def val_coverage(spark, sf_dir):
    days = spark.sql("select explode(sequence(date'2024-01-01', date'2024-01-05')) as day")
    e = joins.full_key_grid(spark.createDataFrame([("ES",), ("CL",), ("XX",)], "market string"), days)
    f = clock_bars(spark, sf_dir).where((_c("ts") < F.lit("2024-01-04").cast("timestamp_ntz")) & _c("market").isin("ES", "CL", "ZN")).select("market", F.to_date("ts").alias("day"))
    return validation.coverage(e, f, e.where("market = 'XX'"), ["market", "day"])


@query("val_feature_coverage", f"with {BARS}, l as (select distinct market, seg from bars), f as (select distinct market, seg from bars where seg % 2 = 0 or market = 'ES') select market, cast(seg as int) as seg, case when f.market is null then 'missing' else 'present' end as status from l left join f using (market, seg)")
def val_features(spark, sf_dir):
    b = tick_bars(spark, sf_dir).select("market", "seg")
    f = b.where("seg % 2 = 0 or market = 'ES'")
    return validation.coverage(b, f, b.limit(0), ["market", "seg"])


@query("val_feature_missing_build", f"with {BARS} select market, seg, count(*) as n from bars where not (seg % 2 = 0 or market = 'ES') group by 1, 2")
def val_missing(spark, sf_dir):
    b = tick_bars(spark, sf_dir)
    have = b.where("seg % 2 = 0 or market = 'ES'").select("market", "seg").distinct()
    return b.join(have, ["market", "seg"], "left_anti").groupBy("market", "seg").agg(F.count("*").alias("n"))


@query("val_costs", f"with {COSTS} select market, case when market = 'CL' then 'tick_value' else '' end as problems from costs")
def val_costs(spark, sf_dir):
    return validation.cost_problems(costs(spark).withColumn("tick_value", F.when(_c("market") != "CL", _c("tick_value"))))


@query("val_sessions", "select * from (values ('ES', ''), ('CL', 'zone|close')) t(market, problems)")
def val_sessions(spark, sf_dir):
    return validation.session_problems(spark.createDataFrame([("ES", "globex", "America/Chicago", 1020, 960), ("CL", "globex", " ", 1020, 2000)], "market string, template string, zone string, open_minute int, close_minute int"))


@query("val_profile", "select * from (values ('smoke', true), ('tier_9', false)) t(profile, known)")
def val_profile(spark, sf_dir):
    from tidemark.plans.basic_queries import _PROFILES

    return spark.createDataFrame([(p, p in _PROFILES) for p in ("smoke", "tier_9")], "profile string, known boolean")


@query("val_live_readiness", f"with {COSTS} select market, concat_ws('|', case when market = 'RTY' then 'provisional_costs' end, case when slippage_ticks > 0.5 then 'wide_slippage' end) as blocking from costs")
def val_live(spark, sf_dir):
    return costs(spark).select("market", S.reasons((_c("market") == "RTY", "provisional_costs"), (_c("slippage_ticks") > 0.5, "wide_slippage")).alias("blocking"))


@query("val_prediction_counts", f"{_BP} select market, count(*) as predictions, count(*) filter (where p_fade is null) = 0 as complete from preds group by 1")
def val_manifests(spark, sf_dir):
    return preds(spark, sf_dir).groupBy("market").agg(F.count("*").alias("predictions"), (F.count_if(_c("p_fade").isNull()) == 0).alias("complete"))


_ROB = f"""{POLICY}, t as (select sum(net) as net, sum(gross - 1.5 * cost) as n15, sum(gross - 2 * cost) as n20, sum(turnover) / count(*) as turn from pf), m as (select max(n) as best, sum(greatest(n, 0)) as gain from (select sum(net) as n from pf group by market)),
    f as (select avg(cast(n > 0 as int)) as rate from (select sum(net) as n from pf group by market, fold_id)),
    r as (select *, case when gain > 0 then best / gain end as share from t, m, f)"""
_ROBF = "concat_ws('|', case when net <= 0 then 'net' end, case when n15 <= 0 then 'net_15' end, case when n20 <= 0 then 'net_20' end, case when turn > 0.1 then 'turnover' end, case when coalesce(share, 1) > 0.5 then 'single_market_share' end, case when rate < 1 then 'fold_pass_rate' end)"


@query("gov_robustness_frame", f"with {_ROB} select {q('net')} as net, {q('n15')} as net_15, {q('n20')} as net_20, {q('turn')} as turnover, {q('rate')} as fold_pass_rate, {q('share')} as top_share, {_ROBF} as failed from r")
def gov_robustness(spark, sf_dir):
    return _quantized(validation.robustness(frame(spark, sf_dir)), ["net", "net_15", "net_20", "turnover", "fold_pass_rate", "top_share"])


@query("gov_ledger_frame", f"with {_ROB} select 'baseline' as experiment, {_ROBF} = '' as passed, {_ROBF} as failed, cast(2 as bigint) as records from r")
def gov_ledger(spark, sf_dir):
    from tidemark.sources.staging import shared_path
    from tidemark.sources.tables import append_jsonl

    path = shared_path(spark, "ledger")
    record = validation.ledger_record(validation.robustness(frame(spark, sf_dir)), "baseline").select("experiment", "passed", "failed")
    for _ in range(2):
        append_jsonl(record, path)
    back = spark.read.schema("experiment string, passed boolean, failed string").json(path)
    return back.groupBy("experiment", "passed", "failed").agg(F.count("*").alias("records"))


@query("gov_anti_overfit_frame", f"with {_ROB} select 'baseline' as experiment, {_ROBF} = '' as passed, {_ROBF} as failed from r")
def gov_overfit(spark, sf_dir):
    return validation.ledger_record(validation.robustness(frame(spark, sf_dir)), "baseline").select("experiment", "passed", "failed")


@query("gov_holdout_guard", "select 'calibration,policy' as refused")
def gov_holdout(spark, sf_dir):
    return spark.createDataFrame([(",".join(validation.holdout_guard({"policy", "calibration", "report"})),)], "refused string")
