"""Coverage of stages by market and day, and where filled bars come from, with twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import coverage, joins
from tidemark.plans.domain_queries import CAUSAL, base
from tidemark.plans.registry import PREDS, BARS, clock_bars, preds, q, query
from tidemark.plans.research_queries import _quantized

_c = F.col
_BARS_ONLY = BARS + ", " + PREDS


@query(
    "val_coverage",
    f"""with {CAUSAL}, {_BARS_ONLY}, mk as (select distinct market from clock_bars union all select 'XX'), dy as (select cast(unnest(generate_series((select min(ts) from clock_bars)::date::timestamp, (select max(ts) from clock_bars)::date::timestamp, interval 1 day)) as date) as day),
    f as (select 'raw' as stage, market, cast(ts as date) as day from clock_bars union select 'causal', market, cast(ts as date) from cv where inside and market <> 'CL' union select 'predictions', market, cast(ts as date) from preds where bar % 2 = 0),
    e as (select stage, market, day from (values ('raw'), ('causal'), ('predictions')) s(stage), mk, dy where market <> 'ZN')
    select coalesce(e.stage, f.stage) as stage, coalesce(e.market, f.market) as market, coalesce(e.day, f.day) as day, case when e.stage is null then 'extra' when e.market = 'RTY' and e.day < date '2024-01-05' then 'unavailable' when f.stage is not null then 'present' else 'missing' end as status
    from e full join f on e.stage = f.stage and e.market = f.market and e.day = f.day""",
)
def val_coverage(spark, sf_dir):
    """Every market and day of the table in three stages; one market nobody expects, one that no stage has, one that starts late."""
    raw = clock_bars(spark, sf_dir).withColumn("day", F.to_date("ts"))
    days = raw.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    markets = raw.select("market").distinct().unionByName(spark.createDataFrame([("XX",)], "market string")).where("market <> 'ZN'")
    have = {"raw": raw, "causal": base(spark, sf_dir).where("inside_session and market <> 'CL'").withColumn("day", F.to_date("ts")), "predictions": preds(spark, sf_dir).where("bar % 2 = 0").withColumn("day", F.to_date("ts"))}
    starts = spark.sql("select 'RTY' as market, date'2024-01-05' as first")
    return coverage.stages(joins.full_key_grid(markets, days), starts, have, "day")


_BUCKET = f"""case when not coalesce(inside, false) then 'outside_configured_session' when since_ < 60 then '{coverage.FIRST}' when until_ <= 60 then '{coverage.LAST}' when mod_ // 60 = 18 then 'configured_evening_17_18_ct' when mod_ // 60 >= 19 or mod_ // 60 < 5 then 'overnight_19_05_ct'
    when mod_ // 60 in (6, 7) then 'pre_us_06_07_ct' when mod_ // 60 between 8 and 13 then 'us_day_08_13_ct' when mod_ // 60 in (14, 15) then 'late_day_14_15_ct' else 'other_in_session' end"""
_FILLED = f"{CAUSAL}, sy as (select *, cast(year(ts) as int) as year, {_BUCKET} as bucket, mod_ // 60 as hr from cv where synth)"


@query(
    "val_raw_gaps",
    f"""with {_FILLED}, s as (select market, year, count(*) as n, count(*) filter (where bucket in ('{coverage.FIRST}', '{coverage.LAST}')) as edge, count(*) filter (where exists (select 1 from (select distinct market, hour + interval 1 hour as ts from clock_ticks where event_id % 50 = 0) h where h.market = sy.market and h.ts = sy.ts)) as there from sy group by 1, 2),
    rw as (select market, ts from clock_bars union select market, cast(hour + interval 1 hour as timestamp) from clock_ticks where event_id % 50 = 0), w as (select market, cast(year(ts) as int) as year, count(*) as raw_rows from rw group by 1, 2),
    a as (select market, year, coalesce(raw_rows, 0) as raw_rows, coalesce(n, 0) as synthetic_rows, coalesce(there, 0) as present_in_raw, coalesce(edge, 0) as edge from w full join s using (market, year))
    select market, year, raw_rows, synthetic_rows, present_in_raw, synthetic_rows - present_in_raw as missing_from_raw, {q('case when synthetic_rows > 0 then edge / synthetic_rows else 0 end')} as edge_share, case when present_in_raw > 0 then 'mixed_presence_in_raw_parquet' when synthetic_rows > 0 then 'confirmed_absent_from_raw_parquet' else 'no_synthetic_rows' end as raw_gap_call,
    case when synthetic_rows > 0 and edge / synthetic_rows > 0.5 then 'primarily_session_edge_under_local_config' else 'not_primarily_session_edge_under_local_config' end as session_template_call from a""",
)
def val_raw_gaps(spark, sf_dir):
    """Filled bars against raw rows, to which late hours of some ticks are added."""
    from tidemark.sources.bars import events, market_of

    late = events(spark, sf_dir).where("event_id % 50 = 0").select(market_of().alias("market"), F.timestamp_add("HOUR", F.lit(1), F.date_trunc("hour", "ts").cast("timestamp_ntz")).alias("ts"))
    raw = clock_bars(spark, sf_dir).select("market", "ts").unionByName(late).distinct()
    return _quantized(coverage.raw_presence(base(spark, sf_dir), raw), ["edge_share"])


@query(
    "val_gap_counts",
    f"""with {_FILLED}, v as (select market, year, 'session_bucket' as kind, bucket as value from sy union all select market, year, 'ct_hour', cast(hr as varchar) from sy union all select market, year, 'session_date', cast(day_ as varchar) from sy where inside
    union all select market, year, 'gap_size_minutes', cast(gap_size as varchar) from (select distinct market, year, gap_id, gap_size from sy)) select market, year, kind, value, count(*) as n from v group by 1, 2, 3, 4""",
)
def val_gap_counts(spark, sf_dir):
    return coverage.gap_counts(base(spark, sf_dir))


@query("val_largest_gaps", f"with {_FILLED}, g as (select market, year, gap_id, max(gap_size) as size, count(*) as synthetic_rows, min(ts) as first_ts, max(ts) as last_ts from sy group by 1, 2, 3) select market, year, size, synthetic_rows, first_ts, last_ts, cast(row_number() over (partition by market, year order by size desc, first_ts) as int) as nth from g qualify nth <= 10")
def val_largest(spark, sf_dir):
    return coverage.largest(base(spark, sf_dir)).drop("synthetic_gap_id")
