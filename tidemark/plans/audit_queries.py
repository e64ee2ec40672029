"""Audits of the policy frame over all their scopes, with twins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import drilldown, policy, ranks
from tidemark.plans.registry import preds, q, query, tick_bars
from tidemark.plans.research_queries import _FLOATS, POLICY, _quantized, _scoped_sql, frame

_c = F.col
_EDGES = [0.05, 0.10, 0.20, 0.40]
_M = "abs(p_long - p_short)"
_CONFIDENCE = f"case when {_M} is null then 'missing' when {_M} <= 0.05 then '<=0.05' when {_M} <= 0.1 then '(0.05,0.1]' when {_M} <= 0.2 then '(0.1,0.2]' when {_M} <= 0.4 then '(0.2,0.4]' else '>0.4' end"


def _on(what: str) -> str:
    return f"{what} filter (where position <> 0)"


_SUMS = {
    **{n: f"count(*) filter (where {w})" for n, w in (("trade_count", "position <> 0"), ("block_count", "position = 0"), ("long_count", "position = 1"), ("short_count", "position = -1"), ("flat_count", "position = 0"))},
    "row_count": "count(*)",
}
_MONEY = {
    "gross": "sum(gross)", "slippage": "sum(slip)", "commission": "sum(commission)", "cost": "sum(cost)", "net": "sum(net)",
    "mean_gross": _on("avg(gross)"), "mean_net": _on("avg(net)"), "median_gross": _on("median(gross)"), "median_net": _on("median(net)"),
    "gross_win_rate": _on("avg(cast(gross > 0 as int))"), "net_win_rate": _on("avg(cast(net > 0 as int))"),
    **{n: f"sum({c}) / nullif({_on('count(*)')}, 0)" for n, c in (("avg_slippage", "slip"), ("avg_commission", "commission"), ("avg_cost", "cost"))},
    "cost_drag": "sum(cost) / nullif(abs(sum(gross)), 0)",
}
_CHANCE = {"opportunity_gross": "sum(chance)", "opportunity_cost": "sum(case when base <> 0 then round_turn else 0 end)", "opportunity_net": "sum(chance - case when base <> 0 then round_turn else 0 end)"}
_HITS = {n: f"avg(cast({c} = y_sign as int)) filter (where {c} <> 0 and y_sign in (-1, 0, 1))" for n, c in (("traded_accuracy", "position"), ("base_accuracy", "base"))}
_QUALITY = {"avg_margin": _on(f"avg({_M})"), "median_margin": _on(f"median({_M})"), **_HITS, **{f"avg_{p}": _on(f"avg({p})") for p in ("p_long", "p_short", "p_fade", "p_trend")}}


def _sql(ctes: str, source: str, scopes: Mapping[str, tuple[Sequence[str], str | None]], counts: Mapping[str, str], money: Mapping[str, str]) -> str:
    """Each scope by a grouping of its own."""
    shown = ", ".join([*[f"{v} as {k}" for k, v in counts.items()], *[f"{q(v)} as {k}" for k, v in money.items()]])
    parts = []
    for name, (cols, where) in scopes.items():
        bucket = " || '|' || ".join(f"'{k}=' || coalesce(cast({k} as varchar), 'null')" for k in cols) or "''"
        parts.append(f"select '{name}' as scope, {bucket} as bucket, {shown} from {source} {'where ' + where if where else ''} group by 1, 2")
    return f"with {ctes} " + " union all ".join(parts)


_WHERE = {"long": "position = 1", "traded": "position <> 0"}
_DRILL_SCOPES = drilldown.drilldown_scopes()
_STOP = {"trend_danger": "when base <> 0 and trend_block then 'trend_danger'", "fade_filter": "when base <> 0 and not fade_ok then 'fade_filter'"}


def _category(*first: str) -> str:
    return f"case when position <> 0 then 'traded' when base <> 0 and not flat_ok then 'flat_probability' {' '.join(_STOP[n] for n in first)} when base = 0 then 'no_direction' else 'other' end as category"


_DRILL = f"""{POLICY}, r as (select pf.*, bars.high - bars.low as spread from pf join bars using (market, bar)),
e as (select list_distinct([quantile_cont(spread, 0.25), quantile_cont(spread, 0.5), quantile_cont(spread, 0.75)]) as edges from r),
x as (select *, cast(hour(ts) as int) as hour, {_CONFIDENCE} as confidence, reason as regime, 'q' || (1 + len(list_filter(edges, lambda v: spread > v))) as volatility, {_category('trend_danger', 'fade_filter')},
    base * (exit_price - entry_price) * point_value as chance, cost_ticks * tick_value as round_turn from r, e)"""


def _drill_frame(spark, sf_dir) -> DataFrame:
    """The frame with side, hour, confidence, regime, and quarters of the range of its bars."""
    b = tick_bars(spark, sf_dir).select("market", "bar", (_c("high") - _c("low")).alias("spread"))
    df = frame(spark, sf_dir).join(b, ["market", "bar"])
    df = ranks.with_qcut(df, "spread", 4, "_quarter")
    return df.withColumns({"hour": F.hour("ts"), "confidence": S.cut(F.abs(_c("p_long") - _c("p_short")), _EDGES), "regime": _c("reason"), "volatility": F.concat(F.lit("q"), _c("_quarter").cast("string"))})


_COUNTS = _SUMS | {"base_signal_count": "count(*) filter (where base <> 0)"}
_DRILLED = _sql(_DRILL, "x", _DRILL_SCOPES, _COUNTS, _MONEY | _CHANCE)


@query("aud_trade_drilldown", _DRILLED)
def aud_drilldown(spark, sf_dir):
    return _quantized(drilldown.trades(_drill_frame(spark, sf_dir)), [*_MONEY, *_CHANCE])


_RAW = ", ".join(f"{v} as {k}" for k, v in {**_COUNTS, **{k: _MONEY[k] for k in ("gross", "cost", "net", "cost_drag")}}.items())


def _raw_sql() -> str:
    parts = []
    for name, (cols, where) in _DRILL_SCOPES.items():
        bucket = " || '|' || ".join(f"'{k}=' || coalesce(cast({k} as varchar), 'null')" for k in cols) or "''"
        parts.append(f"select '{name}' as scope, {bucket} as bucket, {_RAW} from x {'where ' + where if where else ''} group by 1, 2")
    return f"{_DRILL}, d as ({' union all '.join(parts)})"


_GAIN = "gross > 0 and net > 0 and scope in (" + ", ".join(f"'{s}'" for s in drilldown.POSITIVE) + ")"
_PLACE = "list_position([" + ", ".join(f"'{s}'" for s in drilldown.POSITIVE) + "], scope)"


@query("aud_drilldown_positive", f"with {_raw_sql()}, t as (select * from d where {_GAIN} order by {_PLACE}, net, bucket limit 5) select scope, bucket, {q('gross')} as gross, {q('net')} as net, trade_count from t")
def aud_positive(spark, sf_dir):
    """The first groups that gain before and after costs."""
    df = drilldown.positive_examples(drilldown.trades(_drill_frame(spark, sf_dir)))
    return _quantized(df.select("scope", "bucket", "gross", "net", "trade_count"), ["gross", "net"])


@query(
    "aud_drilldown_findings",
    f"""with {_raw_sql()}, o as (select * from d where scope = 'overall'), m as (select bucket, net from d where scope = 'market' order by net, bucket limit 1), s as (select bucket, net from d where scope = 'side' and bucket in ('side=long', 'side=short') order by net, bucket limit 1),
    k as (select coalesce(max(row_count) filter (where bucket = 'category=traded'), 0) as traded, coalesce(max(row_count) filter (where bucket = 'category=trend_danger'), 0) as trend from d where scope = 'category')
    select {q('o.gross')} as gross, {q('o.cost')} as cost, {q('o.net')} as net, {q('o.cost_drag')} as cost_drag, {q('o.gross')} as net_without_costs, traded as traded_rows, trend as trend_rows, exists (select 1 from d where {_GAIN}) as any_positive,
    m.bucket as worst_market, {q('m.net')} as worst_market_net, s.bucket as worst_side, {q('s.net')} as worst_side_net from o, m, s, k""",
)
def aud_findings(spark, sf_dir):
    df = drilldown.findings(drilldown.trades(_drill_frame(spark, sf_dir)))
    return _quantized(df, ["gross", "cost", "net", "cost_drag", "net_without_costs", "worst_market_net", "worst_side_net"])


_SIGNAL_SCOPES = {
    "overall": ((), None),
    "traded_market_side": (("market", "side"), _WHERE["traded"]),
    "traded_fold_side": (("fold_id", "side"), _WHERE["traded"]),
    "traded_confidence_side": (("confidence", "side"), _WHERE["traded"]),
    "long_market_fold_confidence": (("market", "fold_id", "confidence"), _WHERE["long"]),
    "category": (("category",), None),
}


@query("aud_signal_quality", _sql(f"{POLICY}, x as (select *, {_CONFIDENCE} as confidence, {_category('fade_filter', 'trend_danger')} from pf)", "x", _SIGNAL_SCOPES, _SUMS, _MONEY | _QUALITY))
def aud_signals(spark, sf_dir):
    df = frame(spark, sf_dir).withColumn("confidence", S.cut(F.abs(_c("p_long") - _c("p_short")), _EDGES))
    return _quantized(drilldown.signals(df), [*_MONEY, *_QUALITY])


_LIMITS = (0.15, 0.60, 0.40)
_RE = f"""{POLICY}, p0 as (select market, fold_id, ts, y_sign, exit_price - entry_price as move, point_value, cost_ticks * tick_value as round_turn, 2.0 * slippage_ticks * tick_value as row_slip,
    case when p_fade >= {_LIMITS[1]} and p_trend < {_LIMITS[2]} then case when p_long - p_short >= {_LIMITS[0]} then 1 when p_long - p_short <= -{_LIMITS[0]} then -1 else 0 end else 0 end as position from pf),
x as (select *, case position when 1 then 'long' when -1 then 'short' else 'flat' end as side, position * move * point_value as gross, case when position <> 0 then row_slip else 0 end as slip, case when position <> 0 then greatest(round_turn - row_slip, 0) else 0 end as commission,
    case when position <> 0 then round_turn else 0 end as cost, position * move * point_value - case when position <> 0 then round_turn else 0 end as net, cast(year(ts) as int) as year, strftime(ts, '%Y-%m') as month, cast(hour(ts) as int) as hour from p0)"""


@query("aud_threshold_sanity", _sql(_RE, "x", {n: (cols, None) for n, cols in drilldown.STABILITY.items()}, _SUMS, _MONEY | {"accuracy": _HITS["traded_accuracy"]}))
def aud_stability(spark, sf_dir):
    """Eleven scopes under other thresholds."""
    return _quantized(drilldown.stability(frame(spark, sf_dir), *_LIMITS), [*_MONEY, "accuracy"])


@query(
    "aud_threshold_decision",
    f"""with {_RE}, o as (select count(*) filter (where position <> 0) as trades, sum(net) as net, sum(gross) as gross from x), m as (select count(*) as markets, count(*) filter (where n > 0) as positive_markets from (select sum(net) as n from x group by market)),
    f as (select count(*) as folds, count(*) filter (where n > 0) as positive_folds from (select sum(net) as n from x group by fold_id)), d as (select *, concat_ws('; ', case when trades < 50 then 'only ' || trades || ' trades below minimum 50' end, case when positive_markets < 3 then 'only ' || positive_markets || ' net-positive markets below minimum 3' end,
    case when positive_folds < 4 then 'only ' || positive_folds || ' net-positive folds below minimum 4' end, case when net <= 0 then 'overall net is not positive' end, case when gross <= 0 then 'overall gross is not positive' end) as reasons from o, m, f)
    select trades, {q('net')} as net, {q('gross')} as gross, markets, positive_markets, folds, positive_folds, reasons = '' as stable, reasons from d""",
)
def aud_decision(spark, sf_dir):
    """Whether those thresholds hold across markets and folds."""
    return _quantized(drilldown.decision(drilldown.stability(frame(spark, sf_dir), *_LIMITS), 50, 3, 4), ["net", "gross"])


_FAILURE = {"overall": [], "market": ["market"], "fold": ["fold_id"], "market_fold": ["market", "fold_id"], "final_position": ["position"], "policy_reason": ["reason"]}


@query("aud_policy_failure", _scoped_sql(_FAILURE))
def aud_failure(spark, sf_dir):
    """The whole summary with drawdown by market, fold, position and reason."""
    return _quantized(policy.metrics(frame(spark, sf_dir), _FAILURE), [*_FLOATS, "max_drawdown"])


@query("aud_cost_components", f"with {POLICY} select {q('sum(gross)')} as gross, {q('sum(slip)')} as slippage_cost, {q('sum(commission)')} as commission_cost, {q('sum(cost)')} as cost, {q('sum(net)')} as net, {q('sum(cost) / nullif(abs(sum(gross)), 0)')} as cost_drag, {q('sum(slip) / nullif(sum(cost), 0)')} as slippage_share, {q('sum(commission) / nullif(sum(cost), 0)')} as commission_share from pf")
def aud_components(spark, sf_dir):
    return _quantized(drilldown.cost_components(frame(spark, sf_dir)), ["gross", "slippage_cost", "commission_cost", "cost", "net", "cost_drag", "slippage_share", "commission_share"])


_TRUTH = {"return": "exit_price / entry_price - 1", "direction": "cast(y_sign = 1 as int)", "fade": "cast(y_sign <> 0 as int)", "trend": "cast(y_sign = 0 as int)"}
_SCORE = {"return": "expected_return", "direction": "p_long", "fade": "p_fade", "trend": "p_trend"}


@query(
    "aud_model_targets",
    "with " + POLICY.split(",\npf0")[0] + ", l as (" + " union all ".join(f"select '{t}' as target_name, market, fold_id, {_SCORE[t]} as s, cast({_TRUTH[t]} as double) as y from preds" for t in _SCORE)
    + f") select target_name, count(*) as row_count, count(distinct market) as markets, count(distinct fold_id) as folds, {q('avg(s)')} as prediction_mean, {q('stddev_pop(s)')} as prediction_std, {q('avg(y)')} as target_mean, {q('stddev_pop(y)')} as target_std, {q('avg((s - y) ** 2)')} as mse, {q('avg(abs(s - y))')} as mae, case when target_name <> 'return' then {q('avg((s - y) ** 2)')} end as brier from l group by 1",
)
def aud_targets(spark, sf_dir):
    """Predictions of every target against what came, from the long form that a model runner writes."""
    truth = {t: F.expr(x) for t, x in _TRUTH.items()}
    df = drilldown.model_targets(policy.to_long(preds(spark, sf_dir)), _SCORE, truth, ["direction", "fade", "trend"])
    return _quantized(df, ["prediction_mean", "prediction_std", "target_mean", "target_std", "mse", "mae", "brier"])
