"""What a stage has of what it should have, where filled bars come from, and artifacts outside their place."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import default

_c = F.col
#: Share of filled rows near a session's ends above which the session template is to blame.
EDGE_SHARE = 0.5
FIRST, LAST = "first_60m_after_configured_open", "last_60m_before_configured_close"


def stages(expected: DataFrame, starts: DataFrame, have: Mapping[str, DataFrame], day: str, keys: Sequence[str] = ("market",)) -> DataFrame:
    """(stage, keys, day, status): each expected key and day in each stage.

    present; missing; unavailable before the key's start in ``starts`` (``keys`` and ``first``), whether or not the stage has it; extra
    where nobody expects it. All stages are compared in one join.
    """
    on = [*keys, day]
    names = F.array(*[F.lit(n) for n in have])
    e = expected.select(*on).distinct().select(F.explode(names).alias("stage"), *on, F.lit(True).alias("_e"))
    found = None
    for name, df in have.items():
        one = df.select(F.lit(name).alias("stage"), *on)
        found = one if found is None else found.unionByName(one)
    both = e.join(found.distinct().withColumn("_f", F.lit(True)), ["stage", *on], "full")
    both = both.join(starts.groupBy(*keys).agg(F.min("first").alias("_first")), list(keys), "left")
    status = F.when(_c("_e").isNull(), "extra").when(_c(day) < _c("_first"), "unavailable").when(_c("_f").isNotNull(), "present").otherwise("missing")
    return both.select("stage", *on, status.alias("status"))


def session_bucket() -> Column:
    """Where in its session a bar stands, by the configured hours and the local clock."""
    hour = F.floor(_c("minute_of_day") / 60)
    return (
        F.when(~default("inside_session", False), "outside_configured_session")
        .when(_c("minutes_since_session_open") < 60, FIRST)
        .when(_c("minutes_until_session_close") <= 60, LAST)
        .when(hour == 18, "configured_evening_17_18_ct")
        .when((hour >= 19) | (hour < 5), "overnight_19_05_ct")
        .when(hour.isin(6, 7), "pre_us_06_07_ct")
        .when(hour.between(8, 13), "us_day_08_13_ct")
        .when(hour.isin(14, 15), "late_day_14_15_ct")
        .otherwise("other_in_session")
    )


def filled(bars: DataFrame) -> DataFrame:
    """Synthetic bars with their year, bucket and local hour."""
    return bars.where(default("is_synthetic", False)).withColumns({"year": F.year("ts"), "session_bucket": session_bucket(), "ct_hour": F.floor(_c("minute_of_day") / 60).cast("int")})


def raw_presence(bars: DataFrame, raw: DataFrame) -> DataFrame:
    """One row a market and year: how many filled bars the raw rows have after all, how many stand near a session's ends, and what that says.

    A market and year without filled bars has a row as well. Filled bars meet raw rows on market and time; both are spread by them.
    """
    known = raw.select("market", "ts").where("ts is not null").distinct().withColumn("_raw", F.lit(True))
    rows = filled(bars).join(known, ["market", "ts"], "left")
    edge = _c("session_bucket").isin(FIRST, LAST)
    g = rows.groupBy("market", "year").agg(F.count("*").alias("synthetic_rows"), F.count("_raw").alias("present_in_raw"), F.count_if(edge).alias("edge_rows"))
    raw_rows = raw.groupBy("market", F.year("ts").alias("year")).agg(F.count("*").alias("raw_rows"))
    out = raw_rows.join(g, ["market", "year"], "full").fillna(0, ["raw_rows", "synthetic_rows", "present_in_raw", "edge_rows"])
    n, there = _c("synthetic_rows"), _c("present_in_raw")
    share = F.when(n > 0, _c("edge_rows") / F.when(n > 0, n)).otherwise(0.0)
    call = F.when(there > 0, "mixed_presence_in_raw_parquet").when(n > 0, "confirmed_absent_from_raw_parquet").otherwise("no_synthetic_rows")
    template = F.when(_c("edge_share") <= EDGE_SHARE, "not_primarily_session_edge_under_local_config").otherwise("primarily_session_edge_under_local_config")
    return out.withColumns({"missing_from_raw": n - there, "edge_share": share, "raw_gap_call": call}).withColumn("session_template_call", template).drop("edge_rows")


def gap_counts(bars: DataFrame) -> DataFrame:
    """(market, year, kind, value, n): filled bars by bucket, local hour and session date, and gaps by their size."""
    rows = filled(bars)
    kinds = {"session_bucket": _c("session_bucket"), "ct_hour": _c("ct_hour"), "session_date": _c("session_date")}
    by_row = rows.select("market", "year", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("string").alias("value")) for k, v in kinds.items()])).alias("r"))
    counts = by_row.select("market", "year", "r.*").where("value is not null").groupBy("market", "year", "kind", "value").agg(F.count("*").alias("n"))
    gaps = rows.where("synthetic_gap_id is not null and synthetic_gap_size_minutes is not null").select("market", "year", "synthetic_gap_id", "synthetic_gap_size_minutes").distinct()
    sizes = gaps.groupBy("market", "year", F.lit("gap_size_minutes").alias("kind"), _c("synthetic_gap_size_minutes").cast("string").alias("value")).agg(F.count("*").alias("n"))
    return counts.unionByName(sizes)


def largest(bars: DataFrame, n: int = 10) -> DataFrame:
    """The largest gaps of each market and year, earlier ones first among equals."""
    rows = filled(bars).where("synthetic_gap_id is not null")
    g = rows.groupBy("market", "year", "synthetic_gap_id").agg(F.max("synthetic_gap_size_minutes").alias("size"), F.count("*").alias("synthetic_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    nth = F.row_number().over(Window.partitionBy("market", "year").orderBy(F.desc("size"), "first_ts", "synthetic_gap_id"))
    return g.where("size is not null").withColumn("nth", nth).where(_c("nth") <= n)


def strays(artifacts: DataFrame, canonical: DataFrame, quarantine: DataFrame, keys: Sequence[str] = ("market", "file")) -> DataFrame:
    """Artifacts (``path``, ``sha256`` and ``keys``) outside the canonical place that a canonical one replaces, and whether they are quarantined.

    An entry of ``quarantine`` counts only if artifact, canonical path and hash are all the same.
    """
    known = canonical.select(*keys, _c("path").alias("canonical_path")).dropDuplicates(list(keys))
    found = artifacts.join(known, list(keys)).where(_c("path") != _c("canonical_path"))
    entries = quarantine.select(_c("artifact_path").alias("path"), "canonical_path", _c("artifact_sha256").alias("sha256")).distinct().withColumn("_q", F.lit(True))
    return found.join(entries, ["path", "canonical_path", "sha256"], "left").withColumn("quarantined", _c("_q").isNotNull()).drop("_q")
