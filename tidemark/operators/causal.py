"""Sessions, gap fill, contract rolls and validity of raw bars.

Everything is computed over whole markets and trimmed afterwards, so a year sees its neighbours. Timestamps are UTC without zone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.blocks import carried
from tidemark.functions.scalars import default, local_time, minute_of_day, minutes_between, reasons, utc_time, valid_ohlcv
from tidemark.functions.windows import START
from tidemark.sources.staging import stage


@dataclass(frozen=True)
class Calendar:
    """Exchange hours in local time; closed dates have no session, early closes end it before its time."""

    template: str = "globex"
    zone: str = "America/Chicago"
    open_minute: int = 1020
    close_minute: int = 960
    closed: tuple[str, ...] = ()
    early: dict[str, int] = field(default_factory=dict)

    def days(self, spark: SparkSession) -> DataFrame:
        """(session_date, closed, close_minute) of the special days; a handful."""
        rows = [(d, True, self.close_minute) for d in self.closed] + [(d, False, m) for d, m in self.early.items()]
        return spark.createDataFrame(rows, "d string, closed boolean, close_minute int").select(F.to_date("d").alias("_day"), F.col("closed").alias("_closed"), F.col("close_minute").alias("_close"))


def with_sessions(df: DataFrame, cal: Calendar) -> DataFrame:
    """Session fields; those of rows outside any session are NULL."""
    local = local_time("ts", cal.zone)
    day = local.cast("date")
    df = df.withColumns({"_local": local, "minute_of_day": minute_of_day(local), "day_of_week": F.weekday(local)})
    df = df.withColumn("_day", F.when(F.col("minute_of_day") < cal.close_minute, day).otherwise(F.date_add(day, 1)))
    df = df.join(F.broadcast(cal.days(df.sparkSession)), "_day", "left")
    at = lambda date, minute: utc_time(F.timestamp_add("MINUTE", minute, date.cast("timestamp_ntz")), cal.zone)
    df = df.withColumns({"_open": at(F.date_sub("_day", 1), F.lit(cal.open_minute)), "_close_at": at(F.col("_day"), F.coalesce("_close", F.lit(cal.close_minute)))})
    inside = (F.col("ts") >= F.col("_open")) & (F.col("ts") < F.col("_close_at")) & (F.weekday("_day") < 5) & ~default("_closed", False)
    df = df.withColumn("inside_session", inside)
    since, until = minutes_between("ts", "_open"), minutes_between("_close_at", "ts")
    on = lambda x: F.when(F.col("inside_session"), x)
    return df.withColumns(
        {
            "session_date": on(F.col("_day")),
            "session_id": on(F.concat(F.lit("session_"), F.date_format("_day", "yyyy-MM-dd"))),
            "session_template": on(F.lit(cal.template)),
            "minutes_since_session_open": on(since),
            "minutes_until_session_close": on(until),
            "session_progress": on(since / F.when(since + until > 0, since + until)),
        }
    ).drop("_local", "_day", "_closed", "_close", "_open", "_close_at")


def fill_gaps(df: DataFrame, step_minutes: int = 1, most_minutes: int = 120) -> DataFrame:
    """Add the minutes a session misses where the hole is short enough and the contract stays the same.

    A synthetic bar has the close before it as its prices and no volume; holes are numbered in time order.
    """
    ahead = Window.partitionBy("market", "session_id").orderBy("ts")
    gap = minutes_between(F.lead("ts").over(ahead), "ts")
    same = F.coalesce(F.lead("instrument_id").over(ahead) == F.col("instrument_id"), F.lit(True))
    base = df.withColumn("_gap", F.when(F.col("inside_session") & same & F.col("close").isNotNull(), gap))
    hole = F.coalesce((F.col("_gap") > step_minutes) & (F.col("_gap") <= most_minutes), F.lit(False))
    base = base.withColumn("_hole", hole)
    base = carried(base, {"_id": ("sum", F.col("_hole").cast("int"))})
    # each bar stands first among its fills, so bars are read once
    steps = F.when(F.col("_hole"), (F.ceil(F.col("_gap") / step_minutes) - 1).cast("int")).otherwise(0)
    rows = base.withColumn("_k", F.explode(F.sequence(F.lit(0), steps)))
    new = F.col("_k") > 0
    fill = lambda x, kept: F.when(new, x).otherwise(F.col(kept))
    flat = {x: fill(F.col("close"), x) for x in ("open", "high", "low")}
    return rows.withColumns(
        {
            "ts": F.timestamp_add("MINUTE", F.col("_k") * step_minutes, F.col("ts")),
            **flat,
            "volume": fill(F.lit(0).cast(df.schema["volume"].dataType), "volume"),
            "is_synthetic": new,
            "synthetic_gap_id": F.when(new, F.col("_id").cast("long")),
            "synthetic_gap_size_minutes": F.when(new, F.col("_gap").cast("long")),
        }
    ).drop("_gap", "_hole", "_id", "_k")


def with_rolls(df: DataFrame, window_bars: int = 15) -> DataFrame:
    """A roll is a change of contract between neighbours that are both in session; bars near one are in its window."""
    df = carried(df, {"_inside": ("lag", F.col("inside_session")), "_contract": ("lag", F.col("instrument_id")), "_rn": ("sum", F.lit(1).cast("long"))})
    changed = F.col("inside_session") & default("_inside", False) & (F.col("instrument_id") != F.col("_contract"))
    df = df.withColumn("roll_boundary_flag", default(changed, False)).drop("_inside", "_contract")
    at = F.when(F.col("roll_boundary_flag"), F.col("_rn"))
    df = carried(df, {"_before": ("last", at), "_behind": ("next", at)})
    df = df.withColumns({"bars_since_roll": F.col("_rn") - F.col("_before"), "bars_until_roll": F.col("_behind") - F.col("_rn")}).drop("_before", "_behind")
    near = default(F.col("bars_since_roll") <= window_bars, False) | default(F.col("bars_until_roll") <= window_bars, False)
    number = F.sum(F.col("roll_boundary_flag").cast("int")).over(Window.partitionBy("market", "session_id").orderBy("ts").rowsBetween(START, 0))
    segment = F.when(F.col("inside_session"), F.concat("session_id", F.lit("_seg"), number.cast("string")))
    return df.withColumns({"roll_window_flag": near, "session_segment_id": segment}).drop("_rn")


def with_edges(df: DataFrame) -> DataFrame:
    """First and last bar of each segment."""
    seg = Window.partitionBy("market", "session_segment_id")
    on = F.col("session_segment_id").isNotNull()
    return df.withColumns({"is_session_open": on & (F.col("ts") == F.min("ts").over(seg)), "is_session_close": on & (F.col("ts") == F.max("ts").over(seg))})


def with_boundary(df: DataFrame, context_before: bool = False, context_after: bool = False) -> DataFrame:
    """First and last segment of a market, where nothing before or after is known."""
    ends = df.where(F.col("session_segment_id").isNotNull()).groupBy("market").agg(F.min_by("session_segment_id", "ts").alias("_first"), F.max_by("session_segment_id", "ts").alias("_last"))
    flag = F.lit(False)
    flag = flag if context_before else flag | (F.col("session_segment_id") == F.col("_first"))
    flag = flag if context_after else flag | (F.col("session_segment_id") == F.col("_last"))
    return df.join(ends, "market", "left").withColumn("boundary_session_flag", default(flag, False)).drop("_first", "_last")


def with_degraded_sessions(df: DataFrame) -> DataFrame:
    """One degraded bar spoils its session."""
    any_ = F.max(default("data_quality_degraded", False).cast("int")).over(Window.partitionBy("market", "session_id")) == 1
    return df.withColumn("session_data_quality_degraded", F.col("session_id").isNotNull() & any_)


def with_validity(df: DataFrame) -> DataFrame:
    bad: list[tuple[Column, str]] = [
        (F.col("is_synthetic"), "raw_row_missing"),
        (F.col("is_synthetic"), "synthetic"),
        (~F.col("valid_ohlcv"), "invalid_ohlcv"),
        (~F.col("inside_session"), "outside_session"),
        (F.col("session_data_quality_degraded"), "degraded_session"),
        (F.col("roll_window_flag"), "roll_window"),
        (F.col("boundary_session_flag"), "boundary_session"),
    ]
    df = df.withColumn("causal_invalid_reason", reasons(*bad))
    return df.withColumn("causal_valid", F.col("causal_invalid_reason") == "")


def build(raw: DataFrame, cal: Calendar, step_minutes: int = 1, most_minutes: int = 120, roll_bars: int = 15) -> DataFrame:
    """Raw bars to the causal base; needs market, ts, prices, volume, instrument_id, data_quality_degraded.

    Filled bars are read for their rows and again for the totals of their days, so they are written first.
    """
    df = with_sessions(raw, cal)
    df = fill_gaps(df, step_minutes, most_minutes)
    df = with_sessions(df.drop("minute_of_day", "day_of_week", "inside_session", "session_date", "session_id", "session_template", "minutes_since_session_open", "minutes_until_session_close", "session_progress"), cal)
    df = with_boundary(with_edges(with_rolls(stage(df, "filled-bars"), roll_bars)))
    return with_validity(with_degraded_sessions(df.withColumn("valid_ohlcv", valid_ohlcv())))


def trim_year(df: DataFrame, year: int) -> DataFrame:
    return df.where(F.year("ts") == year)


def raw_rules(df: DataFrame, key: str = "market") -> DataFrame:
    """Counts of broken rules by key, in one pass."""
    w = Window.partitionBy(key).orderBy("source_row")
    df = df.withColumn("_back", default(F.col("ts") < F.lag("ts").over(w), False))
    return df.groupBy(key).agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("ts").isNull()).alias("null_ts"),
        (F.count("ts") - F.count_distinct("ts")).alias("duplicate_ts"),
        F.count_if("_back").alias("not_monotonic"),
        F.count_if(~valid_ohlcv()).alias("bad_ohlcv"),
        F.count_if(F.col("volume") < 0).alias("negative_volume"),
    )


def schema_variant(columns: list[str]) -> str:
    have = set(columns)
    if {"rtype", "publisher_id", "instrument_id", "symbol", "ts_event"} <= have:
        return "full"
    return "metadata_no_ts_event" if {"instrument_id", "symbol"} <= have else "ohlcv_only"


def thresholds(df: DataFrame, synthetic_pct: float = 2.0, degraded_pct: float = 1.0, roll_pct: float = 1.0) -> DataFrame:
    """Shares of flagged rows by market and a warning where one is too large."""
    pct = lambda x: F.avg(x.cast("double")) * 100
    out = df.groupBy("market").agg(pct(F.col("is_synthetic")).alias("synthetic_pct"), pct(F.col("session_data_quality_degraded")).alias("degraded_pct"), pct(F.col("roll_window_flag")).alias("roll_pct"))
    return out.withColumn("warnings", reasons((F.col("synthetic_pct") > synthetic_pct, "synthetic"), (F.col("degraded_pct") > degraded_pct, "degraded"), (F.col("roll_pct") > roll_pct, "roll")))


def settled(*layers: dict) -> dict:
    """Settings by precedence: an earlier layer wins where it has a value."""
    out: dict = {}
    for layer in reversed(layers):
        out |= {k: v for k, v in layer.items() if v is not None}
    return out
