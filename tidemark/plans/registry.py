"""Where queries and their DuckDB twins are registered, and the derived tables both start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from tidemark.functions.scalars import quantize
from tidemark.sources import bars as sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return add


def q(expression: str) -> str:
    """The SQL of ``quantize``."""
    return f"cast(floor(cast({expression} as double) * 1e6 + 0.500123) as bigint)"


def out(*keys: str, **values: Column) -> list:
    """Key columns as they are, the rest quantized."""
    return [*keys, *[quantize(v).alias(k) for k, v in values.items()]]


_MARKET = "case event_type " + " ".join(f"when '{k}' then '{m}'" for k, m in sources.MARKETS.items()) + " end"
COSTS = "costs(market, tick_size, tick_value, point_value, cost_ticks, min_profit_ticks, min_stop_ticks, slippage_ticks) as (values " + ", ".join(f"('{r[0]}', " + ", ".join(f"cast({v!r} as double)" for v in r[1:]) + ")" for r in sources.COSTS) + ")"
BARS = f"""ticks as (select {_MARKET} as market, ts, event_id, value + 100 as price from events),
nth as (select *, row_number() over (partition by market order by ts, event_id) - 1 as n from ticks),
raw_bars as (
    select market, cast(n // 3 as int) as bar, min(ts) as ts, arg_min(price, n) as open, max(price) as high, min(price) as low, arg_max(price, n) as close,
           cast(sum(event_id % 97 + 1) as bigint) as volume
    from nth group by 1, 2),
bars as (
    select *, bar // 150 as seg, 's' || lpad(cast(bar // 150 as varchar), 5, '0') as session_segment_id, bar % 41 <> 17 as causal_valid, bar % 211 = 7 as is_synthetic,
           bar % 150 = 0 and bar > 0 as roll_boundary_flag, bar > 0 and (bar % 150 < 3 or bar % 150 > 147) as roll_window_flag, bar < 5 as boundary_session_flag
    from raw_bars)"""
CLOCK = f"""clock_ticks as (select {_MARKET} as market, date_trunc('hour', ts) as hour, ts, event_id, value + 100 as price from events),
clock_bars as (
    select market, cast(hour as timestamp) as ts, arg_min(price, (ts, event_id)) as open, max(price) as high, min(price) as low, arg_max(price, (ts, event_id)) as close, count(*) as volume,
           cast(100 + (day(hour) - 1) // 10 as int) as instrument_id
    from clock_ticks group by market, hour)"""
PREDS = """preds as (
    select market, bar, ts, cast((bar // 60) % 5 as int) as fold_id, session_segment_id as session_id,
           (bar * 7919 + length(market)) % 1000 / 1000.0::double as p_long, (bar * 6271 + length(market)) % 1000 / 1000.0::double as p_short,
           (bar * 3571 + length(market)) % 500 / 500.0::double as p_flat,
           case when bar % 29 <> 3 then (bar * 2203 + length(market)) % 1000 / 1000.0::double end as p_fade,
           case when bar % 31 <> 4 then (bar * 4409 + length(market)) % 1000 / 1000.0::double end as p_trend,
           ((bar * 5113 + length(market)) % 1000 / 1000.0::double - 0.5) / 100 as expected_return,
           open as entry_price, close as exit_price, cast((bar * 13) % 3 - 1 as int) as y_sign
    from bars)"""


def tick_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.tick_bars(spark, sf_dir)


def clock_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.clock_bars(spark, sf_dir)


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.predictions(sources.tick_bars(spark, sf_dir))


def costs(spark: SparkSession) -> DataFrame:
    return sources.costs(spark)
