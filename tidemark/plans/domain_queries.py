"""Causal base, labels and features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import causal, features, labels
from tidemark.plans.registry import BARS, CLOCK, COSTS, clock_bars, costs, out, q, query, tick_bars
from tidemark.sources.staging import stage

# the causal base over hourly bars


CAL = causal.Calendar(closed=("2024-01-15",), early={"2024-01-09": 720})


def raw_clock(spark, sf_dir) -> DataFrame:
    return clock_bars(spark, sf_dir).withColumn("data_quality_degraded", (F.dayofmonth("ts") == 11) & (F.hour("ts") == 5))


def base(spark, sf_dir) -> DataFrame:
    return causal.build(raw_clock(spark, sf_dir), CAL, step_minutes=60, most_minutes=240, roll_bars=5)


_SESSION = """
    select *, case when mod_ < 960 then cast(local as date) else cast(cast(local as date) + 1 as date) end as day_ from (
        select *, cast(hour(local) * 60 + minute(local) as int) as mod_ from (select *, ts at time zone 'UTC' at time zone 'America/Chicago' as local from %s))"""
_SESSIONED = """
    select *, cast((epoch(ts) - epoch(open_at)) // 60 as bigint) as since_, cast((epoch(close_at) - epoch(ts)) // 60 as bigint) as until_,
           ts >= open_at and ts < close_at and isodow(day_) <= 5 and day_ <> date '2024-01-15' as inside from (
        select *, (cast(day_ - 1 as timestamp) + interval 1020 minute) at time zone 'America/Chicago' at time zone 'UTC' as open_at,
               (cast(day_ as timestamp) + case when day_ = date '2024-01-09' then interval 720 minute else interval 960 minute end) at time zone 'America/Chicago' at time zone 'UTC' as close_at from (%s))"""
CAUSAL = f"""{CLOCK},
s0 as ({_SESSIONED % (_SESSION % '(select *, day(ts) = 11 and hour(ts) = 5 as dq from clock_bars)')}),
g0 as (select *, case when inside and close is not null and coalesce(lead(instrument_id) over w = instrument_id, true) then cast((epoch(lead(ts) over w) - epoch(ts)) // 60 as bigint) end as gap
       from s0 window w as (partition by market, case when inside then day_ end order by ts)),
g1 as (select *, coalesce(gap > 60 and gap <= 240, false) as hole from g0),
g2 as (select *, sum(cast(hole as int)) over (partition by market order by ts rows between unbounded preceding and current row) as gid from g1),
filled as (
    select market, ts, open, high, low, close, volume, instrument_id, dq, false as synth, cast(null as bigint) as gap_id, cast(null as bigint) as gap_size from g2
    union all
    select market, ts + to_minutes(cast(60 * k as bigint)), close, close, close, close, 0, instrument_id, dq, true, cast(gid as bigint), gap from (select *, unnest(range(1, cast(ceil(gap / 60.0) as bigint))) as k from g2 where hole)),
s1 as ({_SESSIONED % (_SESSION % 'filled')}),
r0 as (select *, 'session_' || strftime(day_, '%Y-%m-%d') as sid, coalesce(inside and lag(inside, 1, false) over w and instrument_id <> lag(instrument_id) over w, false) as roll, row_number() over w as rn from s1 window w as (partition by market order by ts)),
r1 as (select *, rn - max(case when roll then rn end) over (partition by market order by ts rows between unbounded preceding and current row) as since_roll,
              min(case when roll then rn end) over (partition by market order by ts rows between current row and unbounded following) - rn as until_roll,
              sum(cast(roll as int)) over (partition by market, case when inside then sid end order by ts rows between unbounded preceding and current row) as segno from r0),
r2 as (select *, coalesce(since_roll <= 5, false) or coalesce(until_roll <= 5, false) as roll_window, case when inside then sid || '_seg' || cast(cast(segno as bigint) as varchar) end as seg_id from r1),
ends as (select market, arg_min(seg_id, ts) as first_seg, arg_max(seg_id, ts) as last_seg from r2 where seg_id is not null group by 1),
cb as (select r2.*, coalesce(seg_id in (first_seg, last_seg), false) as boundary, inside and coalesce(max(cast(dq as int)) over (partition by market, case when inside then sid end), 0) = 1 as degraded,
              seg_id is not null and ts = min(ts) over (partition by market, seg_id) as is_open, seg_id is not null and ts = max(ts) over (partition by market, seg_id) as is_close,
              high >= low and low <= open and open <= high and low <= close and close <= high and volume >= 0 as ok from r2 join ends using (market)),
cv as (select *, concat_ws('|', case when synth then 'raw_row_missing' end, case when synth then 'synthetic' end, case when not ok then 'invalid_ohlcv' end, case when not inside then 'outside_session' end,
                                 case when degraded then 'degraded_session' end, case when roll_window then 'roll_window' end, case when boundary then 'boundary_session' end) as why from cb)"""


def _causal(name: str, sql: str, cols) -> None:
    @query(name, f"with {CAUSAL} select market, ts, {sql} from cv")
    def run(spark, sf_dir):
        return base(spark, sf_dir).select("market", "ts", *cols())


_c = F.col
_causal(
    "cb_session_metadata",
    f"inside, case when inside then day_ end as day, case when inside then sid end as session_id, case when inside then since_ end as since, case when inside then until_ end as until, {q('case when inside then since_ / (since_ + until_) end')} as progress, mod_ as minute, cast(isodow(cast(local as date)) - 1 as int) as dow",
    lambda: [_c("inside_session").alias("inside"), _c("session_date").alias("day"), "session_id", _c("minutes_since_session_open").alias("since"), _c("minutes_until_session_close").alias("until"), S.quantize("session_progress").alias("progress"), _c("minute_of_day").alias("minute"), _c("day_of_week").alias("dow")],
)
_causal("cb_gap_fill", f"synth, gap_id, gap_size, {q('close')} as close, volume", lambda: [_c("is_synthetic").alias("synth"), _c("synthetic_gap_id").alias("gap_id"), _c("synthetic_gap_size_minutes").alias("gap_size"), S.quantize("close").alias("close"), "volume"])
_causal("cb_roll_flags", "roll", lambda: [_c("roll_boundary_flag").alias("roll")])
_causal("cb_roll_window", "cast(since_roll as bigint) as since, cast(until_roll as bigint) as until, roll_window", lambda: [_c("bars_since_roll").cast("long").alias("since"), _c("bars_until_roll").cast("long").alias("until"), _c("roll_window_flag").alias("roll_window")])
_causal("cb_segment_id", "seg_id", lambda: [_c("session_segment_id").alias("seg_id")])
_causal("cb_edge_flags", "is_open, is_close", lambda: [_c("is_session_open").alias("is_open"), _c("is_session_close").alias("is_close")])
_causal("cb_boundary_session", "boundary", lambda: [_c("boundary_session_flag").alias("boundary")])
_causal("cb_session_degraded", "degraded", lambda: [_c("session_data_quality_degraded").alias("degraded")])
_causal("cb_causal_valid", "why = '' as valid", lambda: [_c("causal_valid").alias("valid")])
_causal("cb_invalid_reason", "why", lambda: [_c("causal_invalid_reason").alias("why")])


@query("cb_year_bleed", f"with {CAUSAL} select market, count(*) as n, count(*) filter (where why = '') as valid from cv where year(ts) = 2024 group by 1")
def cb_year(spark, sf_dir):
    return causal.trim_year(base(spark, sf_dir), 2024).groupBy("market").agg(F.count("*").alias("n"), F.count_if("causal_valid").alias("valid"))


@query("cb_thresholds", f"with {CAUSAL}, p as (select market, avg(cast(synth as int)) * 100 as a, avg(cast(degraded as int)) * 100 as b, avg(cast(roll_window as int)) * 100 as c from cv group by 1) select market, {q('a')} as synthetic_pct, {q('b')} as degraded_pct, {q('c')} as roll_pct, concat_ws('|', case when a > 2 then 'synthetic' end, case when b > 1 then 'degraded' end, case when c > 1 then 'roll' end) as warnings from p")
def cb_thresholds(spark, sf_dir):
    t = causal.thresholds(base(spark, sf_dir))
    return t.select(*out("market", synthetic_pct=_c("synthetic_pct"), degraded_pct=_c("degraded_pct"), roll_pct=_c("roll_pct")), "warnings")


@query("cb_raw_validate", f"with {BARS}, r as (select *, case when bar % 97 <> 5 then ts end as t, case when bar % 50 = 1 then -1 else volume end as v, case when bar % 10 = 9 then bar - 5 else bar end as src from bars), l as (select *, coalesce(t < lag(t) over (partition by market order by src, bar), false) as back from r) select market, count(*) as n_rows, count(*) filter (where t is null) as null_ts, count(t) - count(distinct t) as duplicate_ts, count(*) filter (where back) as not_monotonic, count(*) filter (where v < 0) as bad_ohlcv, count(*) filter (where v < 0) as negative_volume from l group by 1")
def cb_validate(spark, sf_dir):
    df = tick_bars(spark, sf_dir)
    src = F.when(_c("bar") % 10 == 9, _c("bar") - 5).otherwise(_c("bar"))
    df = df.withColumns({"source_row": F.struct(src, "bar"), "ts": F.when(_c("bar") % 97 != 5, _c("ts")), "volume": F.when(_c("bar") % 50 == 1, -1).otherwise(_c("volume"))})
    return causal.raw_rules(df)


@query("cb_schema_variant", "select * from (values (0, 'full'), (1, 'metadata_no_ts_event'), (2, 'ohlcv_only')) t(i, variant)")
def cb_variant(spark, sf_dir):
    cases = [["rtype", "publisher_id", "instrument_id", "symbol", "ts_event"], ["instrument_id", "symbol"], ["open"]]
    return spark.createDataFrame([(i, causal.schema_variant(c)) for i, c in enumerate(cases)], "i int, variant string")


@query("cb_calendar_load", "select * from (values (date '2024-01-15', true, 960), (date '2024-01-09', false, 720)) t(day, closed, close_minute)")
def cb_calendar(spark, sf_dir):
    return CAL.days(spark).select(_c("_day").alias("day"), _c("_closed").alias("closed"), _c("_close").alias("close_minute"))


@query("cb_config_precedence", "select * from (values ('max_gap', 60), ('roll', 15), ('x', 3)) t(k, v)")
def cb_precedence(spark, sf_dir):
    return spark.createDataFrame(list(causal.settled({"max_gap": 60, "roll": None}, {"roll": 15, "max_gap": 90}, {"x": 3}).items()), "k string, v int")


# labels and features over bars that share their minutes


def minute_bars(spark, sf_dir) -> DataFrame:
    """Tick bars as minutes of one calendar, with session fields and market terms."""
    b = stage(tick_bars(spark, sf_dir), "minute-bars")  # blocks and joins by time read them again
    bar = _c("bar")
    ts = F.timestamp_add("MINUTE", bar, F.lit("2024-01-01").cast("timestamp_ntz"))
    b = b.withColumns(
        {
            "ts": ts, "causal_valid": bar % 331 != 17, "valid_ohlcv": bar % 307 != 11, "is_synthetic": bar % 409 == 7,
            "minutes_since_session_open": bar % 150, "minutes_until_session_close": 149 - bar % 150, "session_progress": (bar % 150) / 149.0,
            "minute_of_day": (bar * 7) % 1440, "day_of_week": F.floor(bar / 150).cast("int") % 5,
        }
    )
    return b.join(F.broadcast(costs(spark)), "market")


MINUTES = f"""{BARS}, {COSTS},
mb as (select market, bar, timestamp '2024-01-01' + to_minutes(cast(bar as bigint)) as ts, open, high, low, close, volume, session_segment_id as seg, bar % 331 <> 17 as cv, bar % 307 <> 11 as ok, bar % 409 = 7 as syn,
              roll_boundary_flag as rb, roll_window_flag as rw, boundary_session_flag as bd, bar % 150 as m_open, 149 - bar % 150 as m_close, (bar % 150) / 149.0::double as prog, (bar * 7) % 1440 as mod_, bar // 150 % 5 as dow,
              tick_size as tick, tick_value as tv, cost_ticks as cost, min_profit_ticks as mp, min_stop_ticks as ms from bars join costs using (market))"""
_M, _S = "partition by market order by ts", "partition by market, seg order by ts"
_RUN = f"({_S} rows between unbounded preceding and current row)"
LABELS = f"""{MINUTES},
l0 as (select *, lag(close) over ({_M}) as pc, row_number() over ({_M}) as rn from mb),
l1 as (select *, greatest(high - low, abs(high - pc), abs(low - pc)) as tr, lead(ts, 1) over ({_M}) as e_ts, lead(ts, 16) over ({_M}) as x_ts, lead(open, 1) over ({_M}) as e, lead(open, 16) over ({_M}) as x,
    max(high) over f16 as hi15, min(low) over f16 as lo15, max(high) over f31 as hi30, min(low) over f31 as lo30,
    not (count(seg) over f16 = 16 and min(seg) over f16 = seg and max(seg) over f16 = seg) as cross15, not (count(seg) over f31 = 31 and min(seg) over f31 = seg and max(seg) over f31 = seg) as cross30,
    bool_or(syn) over c16 as syn15, bool_or(not ok) over c16 as inv15, bool_or(bd) over c16 as bd15, bool_or(rb or rw) over c16 as roll15,
    bool_or(syn) over c31 as syn30, bool_or(not ok) over c31 as inv30, bool_or(bd) over c31 as bd30, bool_or(rb or rw) over c31 as roll30,
    sum((high + low + close) / 3 * volume) over {_RUN} / sum(volume) over {_RUN} as vwap, (max(high) over {_RUN} + min(low) over {_RUN}) / 2 as mid
  from l0 window f16 as ({_M} rows between 1 following and 16 following), f31 as ({_M} rows between 1 following and 31 following),
                 c16 as ({_M} rows between current row and 16 following), c31 as ({_M} rows between current row and 31 following)),
l2 as (select *, avg(tr) over ({_M} rows between 59 preceding and current row) / tick as atr, (x - e) / tick as g from l1),
l3 as (select *, case when not cv then 'current_causal_valid_false' when e_ts is null then 'entry_missing' when x_ts is null then 'exit_missing' when cross15 then 'session_segment_cross' when syn15 then 'synthetic_path'
    when inv15 then 'invalid_ohlcv_path' when bd15 then 'boundary_session_path' when roll15 then 'roll_path' when not (e > 0) or not (x > 0) then 'entry_exit_price_invalid' end as why,
    coalesce(cv and e_ts is not null and e > 0 and not cross30 and not syn30 and not inv30 and not bd30 and not roll30, false) as ok30,
    greatest(mp, atr * 0.5) * tick as profit, greatest(ms, atr) * tick as adverse, greatest(ms, atr * 1.5) as danger from l2),
h as (select a.market, a.bar, min(case when b.high >= a.e + a.profit then b.rn - a.rn end) as lp, min(case when b.low <= a.e - a.adverse then b.rn - a.rn end) as la,
             min(case when b.low <= a.e - a.profit then b.rn - a.rn end) as sp, min(case when b.high >= a.e + a.adverse then b.rn - a.rn end) as sa
      from l3 a join l0 b on a.market = b.market and b.rn between a.rn + 1 and a.rn + 16 group by 1, 2),
lab as (select l3.*, why is null as valid, coalesce(why is null and lp < coalesce(la, 99), false) as fl, coalesce(why is null and sp < coalesce(sa, 99), false) as fs,
             sign(g) * greatest(abs(g) - cost, 0) as net, coalesce(ok30 and (hi30 - e) / tick >= danger, false) as up, coalesce(ok30 and (e - lo30) / tick >= danger, false) as down
        from l3 left join h using (market, bar))"""


def labeled(spark, sf_dir) -> DataFrame:
    return labels.add_labels(minute_bars(spark, sf_dir))


def _label(name: str, sql: str, cols) -> None:
    @query(name, f"with {LABELS} select market, bar, {sql} from lab")
    def run(spark, sf_dir):
        return labeled(spark, sf_dir).select("market", "bar", *cols())


def _on(x: str) -> str:
    return q(f"case when valid then {x} end")


_label("target_valid", "valid", lambda: [_c("target_valid").alias("valid")])
_label("target_invalid_reason", "why", lambda: [_c("target_invalid_reason").alias("why")])
_label("target_entry_exit_ts", "case when valid then e_ts end as entry_ts, case when valid then x_ts end as exit_ts", lambda: [_c("target_entry_ts").alias("entry_ts"), _c("target_exit_ts").alias("exit_ts")])
_label("target_entry_exit_price", f"{_on('e')} as entry, {_on('x')} as exit", lambda: [S.quantize("target_entry_price").alias("entry"), S.quantize("target_exit_price").alias("exit")])
_label("target_horizon_bars", "case when valid then 15 end as bars", lambda: [_c("target_horizon_bars").alias("bars")])
_label("target_ret_15m", f"{_on('x / e - 1')} as v", lambda: [S.quantize("target_ret_15m").alias("v")])
_label("target_ret_ticks_dollars", f"{_on('g')} as ticks, {_on('g * tv')} as dollars", lambda: [S.quantize("target_ret_ticks_15m").alias("ticks"), S.quantize("target_gross_dollars_15m").alias("dollars")])
_label("target_estimated_cost", f"{_on('cost')} as ticks, {_on('cost * tv')} as dollars", lambda: [S.quantize("target_estimated_cost_ticks").alias("ticks"), S.quantize("target_estimated_cost_dollars").alias("dollars")])
_label("lb_target_net", f"{_on('net')} as ticks, {_on('net * tv')} as dollars", lambda: [S.quantize("target_net_ticks_after_est_cost").alias("ticks"), S.quantize("target_net_dollars_after_est_cost").alias("dollars")])
_label("target_sign_15m", "cast(coalesce(case when valid then sign(g) end, 0) as int) as v", lambda: [_c("target_sign_15m").alias("v")])
_label("target_sign_with_deadzone", "cast(coalesce(case when valid and abs(g) > cost + mp then sign(g) end, 0) as int) as v", lambda: [_c("target_sign_with_deadzone").alias("v")])
_label("target_tradeable_after_cost", "coalesce(valid and abs(g) > cost, false) as v", lambda: [_c("target_tradeable_after_cost").alias("v")])
_label("mae_mfe_ticks_15m", f"{_on('(lo15 - e) / tick')} as mae, {_on('(hi15 - e) / tick')} as mfe", lambda: [S.quantize("mae_ticks_15m").alias("mae"), S.quantize("mfe_ticks_15m").alias("mfe")])
_label("lb_fade_success", "fl as fade_long, fs as fade_short, fl or fs as fade_any", lambda: [_c("fade_long_success_15m").alias("fade_long"), _c("fade_short_success_15m").alias("fade_short"), _c("target_fade_success_15m").alias("fade_any")])
_label("lb_trend_danger", "up, down, up as long_side, up or down as any_side", lambda: [_c("trend_danger_up_30m").alias("up"), _c("trend_danger_down_30m").alias("down"), _c("target_trend_danger_long_30m").alias("long_side"), _c("target_trend_danger_30m").alias("any_side")])
_label("lb_revert_vwap", "coalesce(ok30 and ((e >= vwap and lo30 <= vwap) or (e < vwap and hi30 >= vwap)), false) as to_vwap, coalesce(ok30 and ((e >= mid and lo30 <= mid) or (e < mid and hi30 >= mid)), false) as to_mid", lambda: [_c("revert_to_vwap_30m").alias("to_vwap"), _c("revert_to_session_mid_30m").alias("to_mid")])
_label("label_semantics", f"'{labels.SEMANTICS}' as semantics, 'settings' as source, false as provisional", lambda: [_c("label_semantics").alias("semantics"), _c("cost_source").alias("source"), _c("cost_provisional").alias("provisional")])


@query("lb_path_checks_15m", f"with {LABELS} select market, count(*) filter (where cross15) as crossed, count(*) filter (where syn15) as synthetic, count(*) filter (where inv15) as invalid, count(*) filter (where bd15) as boundary, count(*) filter (where roll15) as roll from lab group by 1")
def lb_path15(spark, sf_dir):
    return _paths(spark, sf_dir, labels.EXIT)


@query("lb_path_checks_30m", f"with {LABELS} select market, count(*) filter (where cross30) as crossed, count(*) filter (where syn30) as synthetic, count(*) filter (where inv30) as invalid, count(*) filter (where bd30) as boundary, count(*) filter (where roll30) as roll from lab group by 1")
def lb_path30(spark, sf_dir):
    return _paths(spark, sf_dir, labels.REGIME)


def _paths(spark, sf_dir, h):
    from tidemark.functions.blocks import over_blocks

    df = over_blocks(minute_bars(spark, sf_dir), lambda rows, b: rows.withColumns({f"_{k}": v for k, v in labels.path_checks(b, h).items()}), 0, h)
    return df.groupBy("market").agg(*[F.count_if(f"_{k}").alias(n) for k, n in (("cross", "crossed"), ("synthetic", "synthetic"), ("invalid", "invalid"), ("boundary", "boundary"), ("roll", "roll"))])


_CFGS = [{"round_turn_cost_ticks": 2.5}, {"cost_dollars": 25.0, "tick_value": 12.5}, {"slippage_ticks_per_side": 0.5, "commission_per_contract_dollars": 1.25, "tick_value": 12.5}, {}]


@query("lb_cost_resolution", f"select i, {q('v')} as ticks from (values (0, 2.5), (1, 2.0), (2, 1.2), (3, 2.0)) t(i, v)")
def lb_cost(spark, sf_dir):
    return spark.createDataFrame([(i, labels.resolve_cost(c)) for i, c in enumerate(_CFGS)], "i int, v double").select(*out("i", ticks=_c("v")))


@query("gov_label_contract", f"with {LABELS} select count(*) as n, count(*) filter (where valid and e_ts is null) as missing_entry, count(*) filter (where valid = (why is not null)) as contradictory, 1 as semantics from lab")
def label_contract(spark, sf_dir):
    df = labeled(spark, sf_dir)
    return df.agg(
        F.count("*").alias("n"),
        F.count_if(_c("target_valid") & _c("target_entry_ts").isNull()).alias("missing_entry"),
        F.count_if(_c("target_valid") == _c("target_invalid_reason").isNotNull()).alias("contradictory"),
        F.count_distinct("label_semantics").cast("int").alias("semantics"),
    )


# features


def _w(n: int) -> str:
    return f"({_S} rows between {n - 1} preceding and current row)"


def _full(x: str, n: int, agg: str) -> str:
    return f"case when count({x}) over {_w(n)} = {n} then {agg}({x}) over {_w(n)} end"


def _mask(n: int, v: str = "v") -> str:
    return f"(sum(cast({v} as int)) over {_w(n)} = {n})"


def _fv(x: str, n: int, agg: str) -> str:
    return f"case when {_mask(n)} then {_full(x, n, agg)} end"


def _div(a: str, b: str) -> str:
    return f"case when abs({b}) > 1e-12 then ({a}) / ({b}) end"


def _ret(k: int) -> str:
    return f"case when {_mask(k + 1)} then close / lag(close, {k}) over ({_S}) - 1 end"


def _since(flag: str, name: str) -> str:
    return f"seen - max(case when ({flag}) and v then seen end) over {_RUN} as {name}"


def _consec(cond: str, name: str) -> str:
    return f"rn - coalesce(max(case when not (coalesce({cond}, false) and v) then rn end) over {_RUN}, 0) as {name}"


FEATURES = f"""{MINUTES},
f0 as (select *, cv and ok_f and not syn and not rw and not bd as v, row_number() over ({_S}) as rn from (select *, ok as ok_f from mb)),
f1 as (select *, case when v then open end as o, case when v then high end as h, case when v then low end as l, case when v then close end as c, case when v then volume::double end as vol,
       sum(cast(v as int)) over {_RUN} as seen, sum(cast(not v as int)) over {_RUN} as run,
       {', '.join(f'{_ret(k)} as r{k}' for k in (1, 5, 10, 15, 20, 30, 60))} from f0),
f2 as (select *, lag(c) over ({_S}) as pc, lag(h) over ({_S}) as ph, lag(l) over ({_S}) as pl, {', '.join(f'lag(c, {k}) over ({_S}) as c{k}' for k in (15, 30, 60))} from f1),
f3 as (select *, greatest(h - l, abs(h - pc), abs(l - pc)) as tr, sign(c - pc) as dir, abs(c - pc) as step,
       case when ph is not null and pl is not null then cast(coalesce(h <= ph and l >= pl, false) as double) end as inside,
       {_div('greatest(least(h, ph) - greatest(l, pl), 0)', '(greatest(h, ph) - least(l, pl))')} as overlap from f2),
f4 as (select *, lag(dir) over ({_S}) as pdir, first_value(o ignore nulls) over ({_S} rows between unbounded preceding and unbounded following) as so,
       case when h is not null then max(h) over {_RUN} end as sh, case when l is not null then min(l) over {_RUN} end as sl,
       case when c is not null then sum(c * vol) over {_RUN} end as pv, case when c is not null then sum(vol) over {_RUN} end as cvol,
       {_full('tr', 60, 'avg')} as trm, {_full('tr', 60, 'stddev_pop')} as trs, {_full('vol', 60, 'avg')} as vm, {_full('vol', 60, 'stddev_pop')} as vs,
       {_full('h', 20, 'max')} as hi20, {_full('l', 20, 'min')} as lo20, {_mask(20)} as m20, {_mask(60)} as m60, {_mask(120)} as m120,
       {_full('r1', 15, 'stddev_pop')} as rv15, {_full('r1', 60, 'stddev_pop')} as rv60, {_full('tr', 30, 'sum')} as trsum, {_full('vol', 30, 'sum')} as vsum,
       case when {_mask(30)} then {_full('h', 30, 'max')} - {_full('l', 30, 'min')} end as rr30, case when {_mask(60)} then {_full('h', 60, 'max')} - {_full('l', 60, 'min')} end as rr60,
       {_full('h', 120, 'max')} - {_full('l', 120, 'min')} as rr120, {', '.join(f"abs(c - c{k}) as mv{k}, {_full('step', k, 'sum')} as path{k}" for k in (15, 30, 60))},
       {_full('vol', 20, 'avg')} as vm20, {_full('vol', 20, 'stddev_pop')} as vs20, {_full('overlap', 20, 'avg')} as ov20, {_fv('inside', 20, 'sum')} as in20,
       {_consec('c > pc', 'nup')}, {_consec('c < pc', 'ndown')} from f3),
pr0 as (select market, seg, min(ts) as t, max(high) as h, min(low) as l, arg_max(close, ts) as c from mb group by 1, 2),
pr as (select market, seg, lag(h) over w as p_high, lag(l) over w as p_low, lag(c) over w as p_close from pr0 window w as (partition by market order by t)),
orr as (select market, seg, sum(cast(v as int)) as n, max(high) as oh, min(low) as ol, arg_min(open, rn) as oo, arg_max(close, rn) as oc from f0 where rn <= 30 group by 1, 2),
f5 as (select f4.*, p_high, p_low, p_close, p_high - p_low as p_range, n = 30 and rn >= 30 as ready, oh, ol, oo, oc,
       case when pdir is not null then cast(coalesce(dir = pdir, false) as double) end as same, lag(hi20) over ({_S}) as ph20, lag(lo20) over ({_S}) as pl20, coalesce(lag(m20) over ({_S}), false) as ready20,
       (sh + sl) / 2 as mid, sh - sl as sr, {_div('pv', 'cvol')} as vwap, coalesce(tr > trm + 3 * trs and m60, false) as shock,
       case when v and trm is not null and trs is not null then cast(coalesce(tr > trm + 2 * trs, false) as double) end as large,
       {_div('vol - vm', 'vs')} as vz60, {_div('tr - trm', 'trs')} as rz, lag(sh) over ({_S}) as psh, lag(sl) over ({_S}) as psl,
       {', '.join(f"{_div(f'mv{k}', f'path{k}')} as er{k}" for k in (15, 30, 60))}, {_div('vol - vm20', 'vs20')} as vz20
       from f4 join pr using (market, seg) left join orr using (market, seg)),
f6 as (select *, coalesce(vz60 > 3, false) and v as climax, case when shock then dir else 0.0 end as sdir, case when v then cast(coalesce(c > vwap, false) as double) end as above, case when v then cast(coalesce(c < vwap, false) as double) end as below,
       case when v then cast(coalesce(c > mid, false) as double) end as amid, case when v then cast(coalesce(c < mid, false) as double) end as bmid,
       sum(cast(shock as int)) over {_RUN} as sid, abs(c - so) as reach, greatest(sr, tick) as room, mv30 as prog30, {_div('mv30', 'trsum')} as effort, {_div('vsum', 'trsum')} as per_range,
       abs(oc - oo) / greatest(oh - ol, tick) >= 0.65 as drive from f5),
f7 as (select *, {_since('shock', 'bs')}, {_since('climax', 'bsc')}, {_since('shock and sdir > 0', 'bsu')}, {_since('shock and sdir < 0', 'bsd')},
       max(cast(shock and v as int)) over (partition by market, seg, run, sid) = 1 and v as live, first_value(close) over isle as sc, first_value(high) over isle as sxh, first_value(low) over isle as sxl, first_value(tr) over isle as st,
       first_value(sign(close - pc)) over isle as sd, avg(tr) over (partition by market, seg, run, sid order by ts rows between 4 preceding and current row) as decay
       from f6 window isle as (partition by market, seg, run, sid order by ts)),
f8 as (select *, case when (case when sd > 0 then sc - sxl else sxh - sc end) >= greatest(1e-12, st * 0.01) then (case when sd > 0 then sc - sxl else sxh - sc end) else st end as denom from f7)"""
_EFF = "least(greatest(effort, 0), 1)"
#: feature: (SQL over f8, whether it is a flag)
FEATURE_SQL: dict[str, str] = {
    "ret_1": "r1", "ret_5": "r5", "ret_10": "r10", "ret_20": "r20", "log_ret_1": "ln(1 + r1)", "range_norm": _div("h - l", "c"), "true_range": "tr", "volume_z_20": "vz20",
    "close_position_in_range": _div("c - l", "(h - l)"), "body_to_range": _div("abs(c - o)", "(h - l)"), "upper_wick_ratio": _div("h - greatest(o, c)", "(h - l)"), "lower_wick_ratio": _div("least(o, c) - l", "(h - l)"),
    "minutes_since_session_open": "m_open", "minutes_until_session_close": "m_close", "session_progress": "prog", "minute_of_day_sin": "sin(2 * pi() * mod_ / 1440)", "minute_of_day_cos": "cos(2 * pi() * mod_ / 1440)", "day_of_week": "dow",
    "efficiency_ratio_15": "er15", "efficiency_ratio_30": "er30", "efficiency_ratio_60": "er60", "directional_bar_ratio_15": _fv("same", 15, "avg"), "directional_bar_ratio_30": _fv("same", 30, "avg"),
    "consecutive_up_bars": "nup", "consecutive_down_bars": "ndown", "trend_persistence_30": "er30", "signed_trend_persistence_30": "er30 * sign(c - c30)",
    "prior_high_20_dist": "case when ready20 then (c - ph20) / tick end", "prior_low_20_dist": "case when ready20 then (c - pl20) / tick end",
    "breakout_above_20": "?h > ph20 and ready20", "breakout_below_20": "?l < pl20 and ready20", "failed_breakout_above_20": "?h > ph20 and ready20 and c <= ph20", "failed_breakout_below_20": "?l < pl20 and ready20 and c >= pl20",
    "close_back_inside_range_20": "?c <= ph20 and c >= pl20 and ready20", "upper_wick_rejection": f"?({_div('h - greatest(o, c)', '(h - l)')}) > 0.5", "lower_wick_rejection": f"?({_div('least(o, c) - l', '(h - l)')}) > 0.5",
    "realized_range_30": "rr30", "realized_range_60": "rr60", "range_compression_30_vs_120": f"case when m120 then {_div('rr30', 'rr120')} end", "chop_ratio_30": _div("trsum", "prog30"), "inside_bar_count_20": "in20", "overlap_ratio_20": "ov20",
    "session_open_dist": "(c - so) / tick", "session_high_dist": "(c - sh) / tick", "session_low_dist": "(c - sl) / tick", "session_mid_dist": "(c - mid) / tick", "session_vwap_dist": "(c - vwap) / tick",
    "session_range_percentile": _div("sr", "p_range"), "opening_range_30_ready": "?ready", "opening_range_30_high_dist": "case when ready then (c - oh) / tick end", "opening_range_30_low_dist": "case when ready then (c - ol) / tick end",
    "opening_range_30_breakout_up": "?c > oh and ready", "opening_range_30_breakout_down": "?c < ol and ready",
    "realized_vol_15": "rv15", "realized_vol_60": "rv60", "vol_expansion_15_vs_60": _div("rv15", "rv60"), "large_bar_count_30": _fv("large", 30, "sum"), "shock_bar_flag": "?shock", "bars_since_shock": "bs", "volume_z_60": "vz60",
    "volume_surge_with_range": "?vz60 > 2 and rz > 1", "volume_surge_without_progress": "?vz60 > 2 and er30 < 0.2", "range_per_volume": _div("tr", "vol"), "volume_climax_flag": "?climax", "bars_since_volume_climax": "bsc",
    "5m_ret_3": "r15", "15m_ret_4": "r60", "60m_trend_slope": "case when m60 then (c - c60) / 60 end", "daily_open_dist": "(c - so) / tick", "prior_session_high_dist": "(c - p_high) / tick", "prior_session_low_dist": "(c - p_low) / tick",
    "prior_session_close_dist": "(c - p_close) / tick", "prior_session_range_pct": _div("sr", "p_range"), "overnight_gap_ticks": "(so - p_close) / tick",
    "time_bucket_globex_open": "?mod_ between 1020 and 1139", "time_bucket_europe": "?mod_ between 120 and 479", "time_bucket_us_open": "?mod_ between 480 and 569", "time_bucket_midday": "?mod_ between 660 and 839", "time_bucket_power_hour": "?mod_ between 900 and 959",
    "first_30m_flag": "?m_open between 0 and 29", "last_30m_flag": "?m_close between 0 and 29",
    "effort_result_30": "effort", "absorption_proxy_30": f"case when effort is not null then per_range * (1 - {_EFF}) end", "exhaustion_proxy_30": f"case when effort is not null then per_range * er30 * (1 - {_EFF}) end",
    "volume_per_tick_progress_30": "case when prog30 is not null then vsum / greatest(prog30 / tick, 1) end", "range_without_close_progress_30": "case when prog30 is not null then trsum / greatest(prog30, tick) end",
    "open_drive_up": "?drive and oc > oo and ready", "open_drive_down": "?drive and oc < oo and ready", "open_drive_strength_30": "case when ready then reach / room end", "session_one_wayness": "reach / room",
    "vwap_side_persistence": f"greatest({_fv('above', 30, 'sum')}, {_fv('below', 30, 'sum')}) / 30", "bars_above_vwap_30": _fv("above", 30, "sum"), "bars_below_vwap_30": _fv("below", 30, "sum"),
    "pullback_shallowness_30": "1 - (case when c >= so then sh - c else c - sl end) / greatest(reach, tick)",
    "session_range_extension_up": "case when p_high is not null then greatest(c - p_high, 0) / tick end", "session_range_extension_down": "case when p_low is not null then greatest(p_low - c, 0) / tick end",
    "session_acceptance_above_mid": _fv("amid", 30, "avg"), "session_acceptance_below_mid": _fv("bmid", 30, "avg"), "failed_retest_session_high": "?h > psh and c < psh", "failed_retest_session_low": "?l < psl and c > psl",
    "shock_direction": "sdir", "bars_since_up_shock": "bsu", "bars_since_down_shock": "bsd",
    "post_shock_retrace_pct": "case when live and sd <> 0 and denom > 1e-12 then greatest(0, (sc - close) * sd) / denom end",
    "post_shock_continuation_pct": "case when live and sd <> 0 and denom > 1e-12 then greatest(0, case when sd > 0 then high - sxh else sxl - low end) / denom end",
    "post_shock_range_decay": "case when live and sd <> 0 and st > 1e-12 then decay / st end",
}


def _feature_select(names: list[str]) -> str:
    cols = []
    for n in names:
        x = FEATURE_SQL[n]
        value = f"cast(coalesce(({x[1:]}) and v, false) as int)" if x.startswith("?") else f"case when v then {x} end"
        cols.append(f'{q(value)} as "{n}"')
    return ", ".join(cols)


def feature_frame(spark, sf_dir) -> DataFrame:
    return features.build(labeled(spark, sf_dir))


def _numbers(names):
    def one(n):
        x = _c(f"feature_{n}")
        return S.quantize(x.cast("int") if n in _FLAGS else x).alias(n)

    return [one(n) for n in names]


_FLAGS = {n for n, x in FEATURE_SQL.items() if x.startswith("?")}


def _family(family: str) -> None:
    names = [n for n in features.FAMILIES[family] if n in FEATURE_SQL]

    @query(f"ft_{family}", f"with {FEATURES} select market, bar, {_feature_select(names)} from f8")
    def run(spark, sf_dir):
        return features.add_base(minute_bars(spark, sf_dir)).select("market", "bar", *_numbers(names))


for _name in features.FAMILIES:
    if not _name.startswith("tier1"):
        _family(_name)


@query(
    "ft_ewma_vol_20",
    f"""with recursive {FEATURES}, ob as (select market, seg, bar, r1, row_number() over (partition by market, seg order by rn) as k, rn - lag(rn) over (partition by market, seg order by rn) as gap from f8 where r1 is not null),
    e as (select market, seg, bar, k, r1 as mean, 0.0::double as var, 1.0::double as w2 from ob where k = 1
          union all
          select n.market, n.seg, n.bar, n.k, d * e.mean + a * n.r1, d * (e.var + (e.mean - (d * e.mean + a * n.r1)) ** 2) + a * (n.r1 - (d * e.mean + a * n.r1)) ** 2, d * d * e.w2 + a * a
          from e join (select *, ((1 - 2.0 / 21) ** gap) / ((1 - 2.0 / 21) ** gap + 2.0 / 21) as d, (2.0 / 21) / ((1 - 2.0 / 21) ** gap + 2.0 / 21) as a from ob where k > 1) n on n.market = e.market and n.seg = e.seg and n.k = e.k + 1)
    select market, bar, {q('case when k >= 20 then sqrt(var / (1 - w2)) end')} as v from e""",
)
def ft_ewma(spark, sf_dir):
    df = features.add_base(minute_bars(spark, sf_dir)).where(_c("feature_ret_1").isNotNull())
    return df.select(*out("market", "bar", v=_c("feature_ewma_vol_20")))


_T1 = features.TIER1
_INTER = f"""{FEATURES},
t1 as (select ts, {', '.join(f"max(case when market = '{m}' and v then r{k} end) as m{i}_{k}" for i, m in enumerate(_T1) for k in (1,))}, {', '.join(f"max(case when market = '{m}' then r{k} end) as m{i}_{k}" for i, m in enumerate(_T1) for k in (15, 30))} from f8 where market in ('ES', 'ZN', 'CL', '6E') group by 1),
x0 as (select f8.*, {', '.join(f"case when market <> '{m}' then m{i}_{k} end as o{i}_{k}" for i, m in enumerate(_T1) for k in (1, 15, 30))}, {', '.join(f"case when market = '{m}' then r30 else m{i}_30 end as leg{i}" for i, m in enumerate(_T1))}, case when v then r1 end as s1 from f8 join t1 using (ts)),
x1 as (select *, {', '.join(f"count(s1 + o{i}_1) over {_w(60)} as n{i}, avg(case when o{i}_1 is not null then s1 end) over {_w(60)} as a{i}, avg(case when s1 is not null then o{i}_1 end) over {_w(60)} as b{i}, avg(s1 * o{i}_1) over {_w(60)} as ab{i}, stddev_pop(case when o{i}_1 is not null then s1 end) over {_w(60)} as sa{i}, stddev_pop(case when s1 is not null then o{i}_1 end) over {_w(60)} as sb{i}" for i in range(4))} from x0)"""


@query(
    "ft_tier1_intermarket",
    f"with {_INTER} select market, bar, "
    + ", ".join(f'{q(f"case when v then r15 - o{i}_15 end")} as "rel_ret_vs_{m}_15", {q(f"case when n{i} = 60 and sa{i} > 1e-12 and sb{i} > 1e-12 then (ab{i} - a{i} * b{i}) / (sa{i} * sb{i}) end")} as "corr_vs_{m}_60"' for i, m in enumerate(_T1))
    + f", {q('leg0 - leg1')} as es_zn_divergence_30, {q('leg2 - leg0')} as cl_es_divergence_30 from x1",
)
def ft_inter(spark, sf_dir):
    df = features.add_intermarket(features.add_base(minute_bars(spark, sf_dir)))
    return df.select("market", "bar", *_numbers(features.FAMILIES["tier1_intermarket"]))


@query(
    "ft_tier1_cross_market_regime",
    f"""with {_INTER} select market, bar, {q("(" + " + ".join(f"cast(coalesce(sign(o{i}_15) = sign(r15), false) as int)" for i in range(4)) + ") / nullif(" + " + ".join(f"cast(o{i}_15 is not null as int)" for i in range(4)) + ", 0)")} as tier1_direction_agreement_15,
    {q("list_stddev_samp(list_filter([" + ", ".join(f"o{i}_15" for i in range(4)) + "], lambda x: x is not null))")} as tier1_return_dispersion_15,
    {q("(case when market = 'ES' then 0 else m0_30 end) + (case when market = 'ZN' then 0 else -m1_30 end) + (case when market = 'CL' then 0 else 0.5 * m2_30 end)")} as tier1_risk_on_score_30,
    {q('leg0 - leg1')} as es_zn_risk_regime_30, {q('leg2 - leg0')} as cl_es_macro_divergence_30 from x0 join t1 using (ts)""".replace("m0_30 end)", "t1.m0_30 end)").replace("-m1_30", "-t1.m1_30").replace("* m2_30", "* t1.m2_30"),
)
def ft_regime(spark, sf_dir):
    df = features.add_intermarket(features.add_base(minute_bars(spark, sf_dir)))
    return df.select("market", "bar", *_numbers(features.FAMILIES["tier1_cross_market_regime"]))


@query("ft_registry", "select family, count(*) as n from (values " + ", ".join(f"('{k}', '{f}')" for k, fs in features.FAMILIES.items() for f in fs) + ") t(family, feature) group by 1")
def ft_registry(spark, sf_dir):
    rows = features.registry(features.build(labeled(spark, sf_dir)).columns)
    return spark.createDataFrame(rows, "family string, feature string").groupBy("family").agg(F.count("*").alias("n"))


@query("ft_training_rows", f"with {LABELS}, f as (select market, bar, cv and ok and not syn and not rw and not bd as v from mb) select market, count(*) filter (where v) as inputs, count(*) filter (where v and valid) as training from f join lab using (market, bar) group by 1")
def ft_training(spark, sf_dir):
    df = labeled(spark, sf_dir).withColumn("v", features.input_valid())
    return df.groupBy("market").agg(F.count_if("v").alias("inputs"), F.count_if(_c("v") & _c("target_valid")).alias("training"))
