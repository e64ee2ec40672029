"""Window functions, each over all bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import windows as W
from tidemark.functions.blocks import carried, numbered, over_blocks
from tidemark.functions.windows import SEG
from tidemark.operators import ranks
from tidemark.plans.registry import BARS, CLOCK, PREDS, clock_bars, out, preds, q, query, tick_bars
from tidemark.sources.staging import stage

_SEG = "partition by market, session_segment_id order by ts"
_MKT = "partition by market order by ts"
_V = "(select *, case when causal_valid then close end as vc, case when causal_valid then high end as vh, case when causal_valid then volume end as vv, lag(close) over (%s) as pc from bars) b" % _SEG


def _vc():
    return F.when(F.col("causal_valid"), F.col("close"))



def _frame(n: int) -> str:
    return f"({_SEG} rows between {n - 1} preceding and current row)"


def _full(x: str, n: int, agg: str) -> str:
    return f"case when count({x}) over {_frame(n)} = {n} then {agg}({x}) over {_frame(n)} end"


def _mask(n: int) -> str:
    return f"(sum(cast(causal_valid as int)) over {_frame(n)} = {n})"


def _simple(name: str, spark_expr, sql_expr: str) -> None:
    """One expression over bars, quantized."""

    @query(name, f"with {BARS} select market, bar, {q(sql_expr)} as v from {_V}")
    def run(spark, sf_dir):
        return tick_bars(spark, sf_dir).select(*out("market", "bar", v=spark_expr()))


def _blocks(name: str, back: int, ahead: int, spark_expr, sql_expr: str) -> None:
    """One expression over a market's bars, in blocks with halos."""

    @query(name, f"with {BARS} select market, bar, {q(sql_expr)} as v from {_V}")
    def run(spark, sf_dir):
        return over_blocks(tick_bars(spark, sf_dir), lambda df, b: df.withColumn("v", spark_expr(b)), back, ahead).select(*out("market", "bar", v=F.col("v")))


_simple("win_lag", lambda: SEG.lag("close", 3), f"lag(close, 3) over ({_SEG})")
_blocks("win_lead_ungrouped", 0, 16, lambda b: b.lead("open", 16), f"lead(open, 16) over ({_MKT})")
for _name, _agg, _sql in (("sum", F.sum, "sum"), ("mean", F.avg, "avg"), ("std", F.stddev_pop, "stddev_pop"), ("max", F.max, "max"), ("min", F.min, "min")):
    _simple(f"win_rolling_{_name}", lambda a=_agg: SEG.full(_vc(), 20, a), _full("vc", 20, _sql))
_simple("win_valid_mask", lambda: SEG.mask("causal_valid", 15).cast("int"), f"cast({_mask(15)} as int)")
_simple("win_sum_full_valid", lambda: SEG.full_valid("volume", "causal_valid", 15, F.sum), f"case when {_mask(15)} then {_full('vv', 15, 'sum')} end")
_simple("win_mean_full_valid", lambda: SEG.full_valid("close", "causal_valid", 30, F.avg), f"case when {_mask(30)} then {_full('vc', 30, 'avg')} end")
_simple("win_ret_over", lambda: SEG.ret_over("close", "causal_valid", 5), f"case when {_mask(6)} then close / lag(close, 5) over ({_SEG}) - 1 end")
_simple("win_cummax", lambda: SEG.running(_vc(), F.max), f"case when vc is not null then max(vc) over ({_SEG} rows between unbounded preceding and current row) end")
_simple("win_cummin", lambda: SEG.running(_vc(), F.min), f"case when vc is not null then min(vc) over ({_SEG} rows between unbounded preceding and current row) end")
_simple("win_cumsum", lambda: SEG.running(_vc() * F.col("volume"), F.sum), f"case when vc is not null then sum(vc * volume) over ({_SEG} rows between unbounded preceding and current row) end")
_simple("win_cumsum_dropna_false", lambda: F.sum(F.coalesce(F.when(F.col("causal_valid"), F.col("volume")), F.lit(0))).over(SEG.run), f"sum(coalesce(vv, 0)) over ({_SEG} rows between unbounded preceding and current row)")
_simple("win_first_in_segment", lambda: SEG.first(F.when(F.col("causal_valid") & (F.col("bar") % 150 > 1), F.col("open"))), "first_value(case when causal_valid and bar % 150 > 1 then open end ignore nulls) over (partition by market, session_segment_id order by ts rows between unbounded preceding and unbounded following)")
_blocks("win_future_extreme", 0, 16, lambda b: b.future("high", 16, F.max) - b.future("low", 16, F.min), f"max(high) over ({_MKT} rows between 1 following and 16 following) - min(low) over ({_MKT} rows between 1 following and 16 following)")
_blocks("win_future_any", 0, 16, lambda b: b.future_any("is_synthetic", 16).cast("int"), f"max(cast(is_synthetic as int)) over ({_MKT} rows between current row and 16 following)")
_blocks("win_future_same_segment", 0, 16, lambda b: b.future_same("session_segment_id", 16).cast("int"), f"cast(coalesce(count(session_segment_id) over ({_MKT} rows between 1 following and 16 following) = 16 and min(session_segment_id) over ({_MKT} rows between 1 following and 16 following) = session_segment_id and max(session_segment_id) over ({_MKT} rows between 1 following and 16 following) = session_segment_id, false) as int)")


@query("win_true_count_full_valid", f"with {BARS} select market, bar, {q(_full('u', 30, 'sum'))} as v from (select *, case when causal_valid then cast(close > pc as double) end as u from {_V})")
def win_true_count(spark, sf_dir):
    df = tick_bars(spark, sf_dir).withColumn("pc", SEG.lag("close"))
    return df.select(*out("market", "bar", v=SEG.true_count(F.col("close") > F.col("pc"), "causal_valid", 30)))


@query(
    "win_rolling_corr",
    f"""with {BARS}, x as (select market, bar, session_segment_id, ts, close as a, cast(volume as double) as b from bars where true),
    s as (select *, count(*) over w as n, avg(a) over w as ma, avg(b) over w as mb, avg(a * b) over w as mab, stddev_pop(a) over w as sa, stddev_pop(b) over w as sb from x
          window w as ({_SEG} rows between 59 preceding and current row))
    select market, bar, {q('case when n = 60 and sa > 1e-12 and sb > 1e-12 then (mab - ma * mb) / (sa * sb) end')} as v from s""",
)
def win_rolling_corr(spark, sf_dir):
    return tick_bars(spark, sf_dir).select(*out("market", "bar", v=SEG.rolling_corr("close", "volume", 60)))


@query(
    "win_ewm_std",
    f"""with recursive {BARS},
    x as (select market, session_segment_id, bar, close / lag(close) over ({_SEG}) - 1 as r, row_number() over ({_SEG}) as rn from bars),
    y as (select market, session_segment_id, bar, rn, case when bar % 41 <> 17 then r end as r from x),
    o as (select *, row_number() over (partition by market, session_segment_id order by rn) as k, rn - lag(rn) over (partition by market, session_segment_id order by rn) as gap from y where r is not null),
    e as (
        select market, session_segment_id, bar, k, r as mean, 0.0::double as var, 1.0::double as w2 from o where k = 1
        union all
        select o.market, o.session_segment_id, o.bar, o.k, d * e.mean + a * o.r, d * (e.var + (e.mean - (d * e.mean + a * o.r)) ** 2) + a * (o.r - (d * e.mean + a * o.r)) ** 2, d * d * e.w2 + a * a
        from e join (select *, ((1 - 2.0 / 21) ** gap) / ((1 - 2.0 / 21) ** gap + 2.0 / 21) as d, (2.0 / 21) / ((1 - 2.0 / 21) ** gap + 2.0 / 21) as a from o where k > 1) o
          on o.market = e.market and o.session_segment_id = e.session_segment_id and o.k = e.k + 1)
    select y.market, y.bar, {q('case when e.k >= 20 then sqrt(e.var / (1 - e.w2)) end')} as v from y left join e using (market, session_segment_id, bar) where y.r is not null""",
)
def win_ewm_std(spark, sf_dir):
    df = tick_bars(spark, sf_dir).withColumn("r", F.when(F.col("bar") % 41 != 17, F.col("close") / SEG.lag("close") - 1))
    return W.with_ewm_std(df, "r", 20, "e").where(F.col("r").isNotNull()).select(*out("market", "bar", v=F.col("e")))


@query(
    "win_bars_since",
    f"""with {BARS}, f as (select *, causal_valid and bar % 17 = 3 as flag from bars),
    s as (select *, sum(cast(causal_valid as int)) over ({_SEG} rows between unbounded preceding and current row) as seen from f)
    select market, bar, cast(case when causal_valid then seen - max(case when flag then seen end) over ({_SEG} rows between unbounded preceding and current row) end as bigint) as v from s""",
)
def win_bars_since(spark, sf_dir):
    return W.with_bars_since(tick_bars(spark, sf_dir), F.col("bar") % 17 == 3, "causal_valid", "v").select("market", "bar", F.col("v").cast("long").alias("v"))


@query(
    "win_consecutive",
    f"""with {BARS}, f as (select *, coalesce(close > lag(close) over ({_SEG}), false) and causal_valid as up, row_number() over ({_SEG}) as rn from bars)
    select market, bar, cast(rn - coalesce(max(case when not up then rn end) over ({_SEG} rows between unbounded preceding and current row), 0) as bigint) as v from f""",
)
def win_consecutive(spark, sf_dir):
    df = tick_bars(spark, sf_dir).withColumn("up", F.col("close") > SEG.lag("close"))
    return W.with_consecutive(df, F.col("up"), "causal_valid", "v").select("market", "bar", F.col("v").cast("long").alias("v"))


@query(
    "win_first_n_stats",
    f"""with {BARS}, f as (select *, bar not in (5, 170) as ok, row_number() over ({_SEG}) as rn from bars),
    s as (select market, session_segment_id, sum(cast(ok as int)) as n_ok, max(high) as hi, min(low) as lo, arg_min(open, rn) as op, arg_max(close, rn) as cl from f where rn <= 30 group by 1, 2)
    select market, bar, coalesce(n_ok = 30 and rn >= 30, false) as ready, {q('case when n_ok = 30 and rn >= 30 then hi end')} as hi, {q('case when n_ok = 30 and rn >= 30 then lo end')} as lo,
           {q('case when n_ok = 30 and rn >= 30 then cl - op end')} as drive
    from f join s using (market, session_segment_id)""",
)
def win_first_n(spark, sf_dir):
    df = W.with_first_n(tick_bars(spark, sf_dir).withColumn("ok", ~F.col("bar").isin(5, 170)), 30, "ok", "or")
    return df.select("market", "bar", F.col("or_ready").alias("ready"), *out(hi=F.col("or_high"), lo=F.col("or_low"), drive=F.col("or_close") - F.col("or_open")))


@query(
    "win_prior_session",
    f"""with {BARS}, s as (select market, session_segment_id, min(ts) as t, max(high) as h, min(low) as l, arg_max(close, ts) as c from bars group by 1, 2),
    p as (select market, session_segment_id, lag(h) over w as ph, lag(l) over w as pl, lag(c) over w as pc from s window w as (partition by market order by t))
    select market, bar, {q('ph')} as high, {q('pl')} as low, {q('pc')} as close, {q('ph - pl')} as range from bars join p using (market, session_segment_id)""",
)
def win_prior_session(spark, sf_dir):
    df = W.with_prior_segment(tick_bars(spark, sf_dir))
    return df.select(*out("market", "bar", high=F.col("prior_high"), low=F.col("prior_low"), close=F.col("prior_close"), range=F.col("prior_range")))


def shocked(df):
    """Bars with prev_close, tr and a shock flag."""
    df = df.withColumn("prev_close", SEG.lag("close"))
    df = df.withColumn("tr", W.true_range("prev_close"))
    mean, std = (F.when(SEG.mask("causal_valid", 20), a("tr").over(SEG.back(20))) for a in (F.avg, F.stddev_pop))
    return df.withColumn("shock", F.col("causal_valid") & F.coalesce(F.col("tr") > mean + 1.5 * std, F.lit(False)))


_SHOCK = f"""p as (select *, lag(close) over ({_SEG}) as pc from bars),
    t as (select *, greatest(high - low, abs(high - pc), abs(low - pc)) as tr from p),
    k as (select *, causal_valid and coalesce(tr > avg(tr) over w + 1.5 * stddev_pop(tr) over w, false) and {_mask(20)} as shock from t window w as ({_SEG} rows between 19 preceding and current row))"""


@query(
    "win_shock_state",
    f"""with {BARS}, {_SHOCK},
    i as (select *, sum(cast(not causal_valid as int)) over ({_SEG} rows between unbounded preceding and current row) as run, sum(cast(shock as int)) over ({_SEG} rows between unbounded preceding and current row) as sid from k),
    b as (select *, max(cast(shock as int)) over (partition by market, session_segment_id, run, sid) = 1 and causal_valid as live,
          first_value(close) over w as sc, first_value(high) over w as sh, first_value(low) over w as sl, first_value(tr) over w as st, first_value(sign(close - pc)) over w as sd,
          avg(tr) over (partition by market, session_segment_id, run, sid order by ts rows between 4 preceding and current row) as decay
          from i window w as (partition by market, session_segment_id, run, sid order by ts)),
    m as (select *, case when sd > 0 then sc - sl else sh - sc end as move from b),
    d as (select *, case when move >= greatest(1e-12, st * 0.01) then move else st end as denom from m)
    select market, bar, {q('case when live and sd <> 0 and denom > 1e-12 then greatest(0, (sc - close) * sd) / denom end')} as retrace,
           {q('case when live and sd <> 0 and denom > 1e-12 then greatest(0, case when sd > 0 then high - sh else sl - low end) / denom end')} as continuation,
           {q('case when live and sd <> 0 and st > 1e-12 then decay / st end')} as decay from d""",
)
def win_shock_state(spark, sf_dir):
    df = W.with_shock_state(shocked(tick_bars(spark, sf_dir)), "shock", "causal_valid")
    return df.select(*out("market", "bar", retrace=F.col("post_shock_retrace_pct"), continuation=F.col("post_shock_continuation_pct"), decay=F.col("post_shock_range_decay")))


@query("win_true_range", f"with {BARS} select market, bar, {q('greatest(high - low, abs(high - pc), abs(low - pc))')} as v from {_V}")
def win_true_range(spark, sf_dir):
    df = tick_bars(spark, sf_dir).withColumn("pc", SEG.lag("close"))
    return df.select(*out("market", "bar", v=W.true_range("pc")))


@query("win_atr_60", f"with {BARS}, p as (select *, lag(close) over ({_MKT}) as pc from bars) select market, bar, {q(f'avg(greatest(high - low, abs(high - pc), abs(low - pc))) over ({_MKT} rows between 59 preceding and current row)')} as v from p")
def win_atr(spark, sf_dir):
    ranges = lambda df, b: df.withColumn("pc", b.lag("close")).withColumn("tr", W.true_range("pc")).withColumn("v", F.avg("tr").over(b.back(60)))
    return over_blocks(tick_bars(spark, sf_dir), ranges, 60, 0).select(*out("market", "bar", v=F.col("v")))


@query(
    "win_first_hit",
    f"""with {BARS}, r as (select *, row_number() over ({_MKT}) as rn from bars)
    select a.market, a.bar, cast(min(case when b.high >= a.close + 5 then b.rn - a.rn end) as int) as up, cast(min(case when b.low <= a.close - 5 then b.rn - a.rn end) as int) as down
    from r a left join r b on b.market = a.market and b.rn between a.rn + 1 and a.rn + 16 group by 1, 2""",
)
def win_first_hit(spark, sf_dir):
    hits = lambda df, b: df.withColumns({"up": b.first_hit("high", F.col("close") + 5, 16).cast("int"), "down": b.first_hit("low", F.col("close") - 5, 16, up=False).cast("int")})
    return over_blocks(tick_bars(spark, sf_dir), hits, 0, 16).select("market", "bar", "up", "down")


@query(
    "win_roll_distance",
    f"""with {BARS}, r as (select *, row_number() over ({_MKT}) as rn from bars)
    select market, bar, cast(rn - max(case when roll_boundary_flag then rn end) over ({_MKT} rows between unbounded preceding and current row) as bigint) as since,
           cast(min(case when roll_boundary_flag then rn end) over ({_MKT} rows between current row and unbounded following) - rn as bigint) as until from r""",
)
def win_roll_distance(spark, sf_dir):
    # each step reads its rows twice
    bars = stage(tick_bars(spark, sf_dir).select("market", "bar", "ts", "roll_boundary_flag"), "roll-bars")
    df = stage(numbered(bars, name="rn"), "roll-places")
    at = F.when(F.col("roll_boundary_flag"), F.col("rn"))
    df = carried(df, {"before": ("last", at), "behind": ("next", at)})
    return df.select("market", "bar", (F.col("rn") - F.col("before")).alias("since"), (F.col("behind") - F.col("rn")).alias("until"))


@query("win_segment_number", f"with {BARS} select market, bar, cast(sum(cast(roll_boundary_flag as int)) over (partition by market order by ts rows between unbounded preceding and current row) as bigint) as v from bars")
def win_segment_number(spark, sf_dir):
    return carried(tick_bars(spark, sf_dir), {"v": ("sum", F.col("roll_boundary_flag").cast("int"))}).select("market", "bar", "v")


@query("win_edge_flags", f"with {BARS} select market, bar, ts = min(ts) over (partition by market, session_segment_id) as is_open, ts = max(ts) over (partition by market, session_segment_id) as is_close from bars")
def win_edge_flags(spark, sf_dir):
    whole = Window.partitionBy("market", "session_segment_id")
    return tick_bars(spark, sf_dir).select("market", "bar", (F.col("ts") == F.min("ts").over(whole)).alias("is_open"), (F.col("ts") == F.max("ts").over(whole)).alias("is_close"))


@query("win_position_delta", f"with {BARS}, {PREDS} select market, bar, cast(abs(y_sign - lag(y_sign, 1, 0) over (partition by market, fold_id order by ts)) as int) as v from preds")
def win_position_delta(spark, sf_dir):
    df = carried(preds(spark, sf_dir), {"before": ("lag", F.col("y_sign"))}, ("market", "fold_id"))
    return df.select("market", "bar", F.abs(F.col("y_sign") - F.coalesce("before", F.lit(0))).cast("int").alias("v"))


@query(
    "win_cum_equity",
    f"""with {BARS}, {PREDS}, p as (select market, bar, ts, y_sign * (exit_price - entry_price) as pnl from preds),
    e as (select *, 100000 + sum(pnl) over (order by market, ts rows between unbounded preceding and current row) as equity from p)
    select market, bar, {q('equity')} as equity, {q('equity - max(equity) over (order by market, ts rows between unbounded preceding and current row)')} as drawdown from e""",
)
def win_cum_equity(spark, sf_dir):
    from tidemark.operators.backtest import running_equity

    df = preds(spark, sf_dir).select("market", "bar", "ts", (F.col("y_sign") * (F.col("exit_price") - F.col("entry_price"))).alias("pnl"))
    return running_equity(df, "pnl", 100_000.0).select(*out("market", "bar", equity=F.col("equity"), drawdown=F.col("drawdown")))


@query("win_rank_pct_decile", f"with {BARS} select market, bar, 'd' || lpad(cast(cast(ceil(10.0 * row_number() over (order by volume, ts) / count(*) over ()) as int) as varchar), 2, '0') as decile from bars")
def win_rank_decile_all(spark, sf_dir):
    """Over the whole table, in range partitions; bars of equal volume in order of time."""
    return ranks.with_decile(tick_bars(spark, sf_dir), "volume", "decile", "ts").select("market", "bar", "decile")


@query("win_qcut", f"with {BARS}, e as (select quantile_cont(volume, 0.25) as e1, quantile_cont(volume, 0.5) as e2, quantile_cont(volume, 0.75) as e3 from bars) select market, bar, cast(case when volume <= e1 then 1 when volume <= e2 then 2 when volume <= e3 then 3 else 4 end as int) as bucket from bars, e")
def win_qcut_all(spark, sf_dir):
    return ranks.with_qcut(tick_bars(spark, sf_dir), "volume", 4, "bucket").select("market", "bar", "bucket")


@query(
    "win_rank_decile_by_market",
    f"""with {BARS} select market, bar, 'd' || lpad(cast(cast(ceil(10.0 * row_number() over (partition by market order by volume, bar) / count(*) over (partition by market)) as int) as varchar), 2, '0') as decile from bars""",
)
def win_rank_decile(spark, sf_dir):
    from tidemark.operators.metrics import with_decile

    return with_decile(tick_bars(spark, sf_dir), "volume", "decile", ("market",), ("bar",)).select("market", "bar", "decile")


@query(
    "win_qcut_by_market",
    f"""with {BARS}, e as (select market, quantile_cont(volume, 0.25) as e1, quantile_cont(volume, 0.5) as e2, quantile_cont(volume, 0.75) as e3 from bars group by 1)
    select market, bar, cast(case when volume <= e1 then 1 when volume <= e2 then 2 when volume <= e3 then 3 else 4 end as int) as bucket from bars join e using (market)""",
)
def win_qcut(spark, sf_dir):
    from tidemark.operators.metrics import with_qcut

    return with_qcut(tick_bars(spark, sf_dir), "volume", 4, "bucket", ("market",)).select("market", "bar", "bucket")


@query("win_tail_per_group", f"with {BARS} select market, bar, lead(bar) over ({_SEG}) is null as is_last from bars")
def win_tail(spark, sf_dir):
    return tick_bars(spark, sf_dir).select("market", "bar", SEG.lead("bar").isNull().alias("is_last"))


@query(
    "win_gap_detect",
    f"""with {CLOCK} select market, ts, cast((epoch(lead(ts) over (partition by market, cast(ts as date) order by ts)) - epoch(ts)) // 60 as bigint) as gap from clock_bars""",
)
def win_gap_detect(spark, sf_dir):
    from tidemark.functions.scalars import minutes_between

    by = Window.partitionBy("market", F.to_date("ts")).orderBy("ts")
    return clock_bars(spark, sf_dir).select("market", "ts", minutes_between(F.lead("ts").over(by), "ts").alias("gap"))


@query("win_dedupe_last", f"with {BARS} select market, bar, volume from (select *, bar // 4 as k, row_number() over (partition by market, bar // 4 order by bar desc) as n from bars) where n = 1")
def win_dedupe_last(spark, sf_dir):
    from tidemark.operators.joins import dedupe_last

    df = tick_bars(spark, sf_dir).withColumn("k", F.floor(F.col("bar") / 4))
    return dedupe_last(df, ["market", "k"], "bar").select("market", "bar", "volume")
