"""Streams, run to the end of what there is and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import quantize
from tidemark.operators import causal
from tidemark.plans.domain_queries import CAL, CAUSAL
from tidemark.plans.registry import BARS, CLOCK, clock_bars, q, query, tick_bars
from tidemark.plans.window_queries import _SEG, _SHOCK
from tidemark.sources.bars import market_of
from tidemark.sources.staging import shared_path
from tidemark.streaming import bars as streams
from tidemark.streaming import holes, running
from tidemark.streaming.ordered import start


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    static = spark.read.parquet(f"{sf_dir}/events.parquet")
    source = spark.readStream.schema(static.schema).parquet(f"{sf_dir}/events.parquet*")
    return source.select(market_of().alias("market"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), (F.col("value") + 100).alias("price"))


def _finished(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Run a stream over all of its input, and return what it wrote."""
    path = shared_path(spark, name)
    start(df, path, shared_path(spark, f"{name}-marks")).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def _in_waves(spark: SparkSession, bars: DataFrame, build, name: str, late_minutes: int = 60) -> DataFrame:
    """Give a stream its input in two parts, and stop and restart it between them.

    The parts meet in the middle of the time that the bars cover; a third of the bars of the last hour before it come with the second part, out of order.
    """
    source, path, marks = (shared_path(spark, f"{name}-{x}") for x in ("in", "out", "marks"))
    ends = bars.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    if ends.a is None:
        return spark.createDataFrame([], build(bars).schema)
    middle = F.lit(ends.a + (ends.b - ends.a) / 2)
    delayed = (F.col("ts") >= middle - F.make_dt_interval(mins=F.lit(late_minutes))) & (F.pmod(F.xxhash64("market", "ts"), F.lit(3)) == 0)
    first = (F.col("ts") < middle) & ~delayed
    for wave in (first, ~first):
        bars.where(wave).write.mode("append").parquet(source)
        start(build(spark.readStream.schema(bars.schema).parquet(source)), path, marks).awaitTermination()
    return spark.read.parquet(path)


@query("stream_bars", f"with {CLOCK} select market, ts as start, {q('open')} as open, {q('high')} as high, {q('low')} as low, {q('close')} as close, volume from clock_bars where ts + interval 1 hour <= (select max(ts) from events) - interval 2 hour")
def stream_bars(spark, sf_dir):
    """Bars that the watermark has closed by the end of the input."""
    out = _finished(spark, streams.bars(_ticks(spark, sf_dir)), "stream-bars")
    return out.select("market", F.col("start").cast("timestamp_ntz").alias("start"), *[quantize(x).alias(x) for x in ("open", "high", "low", "close")], "volume")


def _sessioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with their session and its end."""
    df = causal.with_sessions(clock_bars(spark, sf_dir), CAL)
    end = F.unix_millis(F.col("ts").cast("timestamp")) + F.col("minutes_until_session_close") * 60_000
    return df.select("market", "session_id", F.col("ts").cast("timestamp").alias("ts"), *holes.PRICES, "volume", "instrument_id", "inside_session", end.alias("session_end"))


_LIMIT = "lim as (select max(ts) - interval 2 hour as until from clock_bars)"
_KEY = "market, case when inside then 'session_' || strftime(day_, '%Y-%m-%d') end as session_id"


def _filled(df: DataFrame) -> DataFrame:
    return df.select("market", "session_id", F.timestamp_millis("at").cast("timestamp_ntz").alias("ts"), quantize("close").alias("close"), "volume", "instrument_id", F.col("is_synthetic").alias("synth"), F.col("gap_minutes").alias("gap_size"))


@query(
    "stream_gap_fill",
    f"""with {CAUSAL}, {_LIMIT}
    select {_KEY}, ts, {q('close')} as close, volume, cast(instrument_id as bigint) as instrument_id, false as synth, cast(null as bigint) as gap_size from g2, lim where ts <= until
    union all select {_KEY}, ts + to_minutes(cast(60 * k as bigint)), {q('close')}, 0, cast(instrument_id as bigint), true, gap
    from (select *, unnest(range(1, cast(ceil(gap / 60.0) as bigint))) as k from g2, lim where hole and ts + to_minutes(gap) <= until)""",
)
def stream_gap_fill(spark, sf_dir):
    """What ``cb_gap_fill`` adds, as far as the watermark has come; state by market and session."""
    return _filled(_in_waves(spark, _sessioned(spark, sf_dir), lambda s: holes.filled(s, "2 hours", 60, 240), "stream-filled"))


@query(
    "stream_live_fill",
    f"""with {CAUSAL}, {_LIMIT},
    h as (select *, lead(ts) over (partition by market, case when inside then day_ end order by ts) as ahead from g2)
    select {_KEY}, ts, {q('close')} as close, volume, cast(instrument_id as bigint) as instrument_id, false as synth, cast(null as bigint) as gap_size from h, lim where ts <= until
    union all select {_KEY}, ts + to_minutes(cast(60 * k as bigint)), {q('close')}, 0, cast(instrument_id as bigint), true, null
    from (select *, unnest(range(1, 5)) as k from h, lim where inside and close is not null)
    where ts + to_minutes(cast(60 * k as bigint)) <= until and ts + to_minutes(cast(60 * k as bigint)) < least(coalesce(ahead, close_at), close_at)""",
)
def stream_live_fill(spark, sf_dir):
    """Flat bars by timers, up to four hours after the last bar, whether or not another follows."""
    return _filled(_in_waves(spark, _sessioned(spark, sf_dir), lambda s: holes.filled(s, "2 hours", 60, 240, live=True), "stream-live"))


@query(
    "stream_running",
    f"""with {BARS}, {_SHOCK}, lim as (select epoch_us(max(ts)) // 1000 - 7200000 as until from bars),
    r as (select *, sum(cast(causal_valid as int)) over s as seen, row_number() over s as rn, coalesce(close > pc, false) and causal_valid as up,
                 sum(cast(not causal_valid as int)) over s as run, sum(cast(shock as int)) over s as sid from k window s as ({_SEG} rows between unbounded preceding and current row)),
    b as (select *, case when causal_valid then seen - max(case when causal_valid and bar % 17 = 3 then seen end) over s end as since, rn - coalesce(max(case when not up then rn end) over s, 0) as up_run,
                 max(cast(shock as int)) over (partition by market, session_segment_id, run, sid) = 1 and causal_valid as live,
                 first_value(close) over w as sc, first_value(high) over w as sh, first_value(low) over w as sl, first_value(tr) over w as st, first_value(sign(close - pc)) over w as sd,
                 avg(tr) over (partition by market, session_segment_id, run, sid order by ts rows between 4 preceding and current row) as decay
          from r window s as ({_SEG} rows between unbounded preceding and current row), w as (partition by market, session_segment_id, run, sid order by ts)),
    d as (select *, case when case when sd > 0 then sc - sl else sh - sc end >= greatest(1e-12, st * 0.01) then case when sd > 0 then sc - sl else sh - sc end else st end as denom from b)
    select market, session_segment_id, epoch_us(ts) // 1000 as at, cast(since as bigint) as bars_since, cast(up_run as bigint) as up_run, {q('tr')} as tr, shock,
           {q('case when live and sd <> 0 and denom > 1e-12 then greatest(0, (sc - close) * sd) / denom end')} as retrace,
           {q('case when live and sd <> 0 and denom > 1e-12 then greatest(0, case when sd > 0 then high - sh else sl - low end) / denom end')} as continuation,
           {q('case when live and sd <> 0 and st > 1e-12 then decay / st end')} as decay from d, lim where epoch_us(ts) // 1000 <= until""",
)
def stream_running(spark, sf_dir):
    """What ``win_bars_since``, ``win_consecutive`` and ``win_shock_state`` say, kept up bar by bar."""
    bars = tick_bars(spark, sf_dir).select("market", "session_segment_id", F.col("ts").cast("timestamp").alias("ts"), "high", "low", "close", "causal_valid", (F.col("bar") % 17 == 3).alias("flag"))
    out_ = _in_waves(spark, bars, lambda s: running.running(s), "stream-running")
    return out_.select("market", "session_segment_id", "at", "bars_since", "up_run", "shock", *[quantize(x).alias(x) for x in ("tr", "retrace", "continuation", "decay")])
