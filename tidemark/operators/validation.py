"""Coverage, gap and contract checks, and the gates they feed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import blank, default, reasons


def coverage(expected: DataFrame, found: DataFrame, unavailable: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each expected key as present, unavailable or missing; found keys that nobody expects as extra."""
    e = expected.select(*keys).distinct().withColumn("_e", F.lit(True))
    f = found.select(*keys).distinct().withColumn("_f", F.lit(True))
    u = unavailable.select(*keys).distinct().withColumn("_u", F.lit(True))
    both = e.join(f, list(keys), "full").join(u, list(keys), "left")
    status = F.when(F.col("_e").isNull(), "extra").when(F.col("_f").isNotNull(), "present").when(F.col("_u").isNotNull(), "unavailable").otherwise("missing")
    return both.select(*keys, status.alias("status"))


def cost_problems(costs: DataFrame) -> DataFrame:
    """Markets with the settings they lack."""
    cols = [c for c in costs.columns if c != "market"]
    return costs.select("market", reasons(*[(F.coalesce(F.col(c) <= 0, F.lit(True)), c) for c in cols]).alias("problems"))


def session_problems(sessions: DataFrame) -> DataFrame:
    return sessions.select("market", reasons((blank("template"), "template"), (blank("zone"), "zone"), (~default(F.col("open_minute").between(0, 1439), False), "open"), (~default(F.col("close_minute").between(0, 1439), False), "close")).alias("problems"))


def gap_buckets(bars: DataFrame) -> DataFrame:
    """Synthetic bars by where they stand in their session."""
    m = F.col("minutes_since_session_open")
    bucket = F.when(m.isNull(), "outside").when(m < 120, "open").when(F.col("minutes_until_session_close") <= 120, "close").otherwise("middle")
    return bars.where("is_synthetic").groupBy("market", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count_distinct("synthetic_gap_id").alias("gaps"))


def largest_gaps(bars: DataFrame, n: int = 10) -> DataFrame:
    g = bars.where("is_synthetic").groupBy("market", "synthetic_gap_id").agg(F.max("synthetic_gap_size_minutes").alias("size"), F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return g.orderBy(F.desc("size"), "market", "first_ts").limit(n)


def gap_windows(gaps: DataFrame, bars: DataFrame, buffer_minutes: int) -> DataFrame:
    """Query windows around gaps, with the contract if the bars next to the gap agree on one."""
    from tidemark.operators.joins import asof_backward

    raw = bars.where(~F.col("is_synthetic")).select("market", "ts", "instrument_id")
    before = asof_backward(gaps, raw.withColumnRenamed("instrument_id", "before_id"), ["market"], "first_ts", "ts", ["before_id"])
    secs = lambda t: F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(t))
    after = asof_backward(before.withColumn("_neg", -secs("last_ts")), raw.select("market", (-secs("ts")).alias("_n"), F.col("instrument_id").alias("after_id")), ["market"], "_neg", "_n", ["after_id"]).drop("_neg")
    same = F.when(F.col("before_id") == F.col("after_id"), F.col("before_id"))
    return after.withColumns({"query_start": F.timestamp_add("MINUTE", F.lit(-buffer_minutes), F.col("first_ts")), "query_end": F.timestamp_add("MINUTE", F.lit(buffer_minutes + 1), F.col("last_ts")), "instrument_id": same})


def gap_activity(gaps: DataFrame, ticks: DataFrame) -> DataFrame:
    """Ticks inside each gap; both sides are matched by market and hour first."""
    hours = F.sequence(F.date_trunc("hour", F.col("first_ts").cast("timestamp")), F.date_trunc("hour", F.col("end_ts").cast("timestamp")), F.expr("interval 1 hour"))
    cells = gaps.withColumn("_h", F.explode(hours))
    t = ticks.select("market", F.col("ts").alias("_ts"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("_h"))
    hit = cells.join(t, ["market", "_h"], "left")
    inside = default((F.col("_ts") >= F.col("first_ts")) & (F.col("_ts") < F.col("end_ts")), False)
    return hit.groupBy(*gaps.columns).agg(F.count_if(inside).alias("n_ticks"))


def robustness(frame: DataFrame, max_turnover: float = 0.10, max_share: float = 0.5) -> DataFrame:
    """One row: net profit at 1, 1.5 and 2 times the cost, concentration, folds that pass, and what fails."""
    total = frame.agg(
        F.sum("net").alias("net"),
        F.sum(F.col("gross") - 1.5 * F.col("cost")).alias("net_15"),
        F.sum(F.col("gross") - 2.0 * F.col("cost")).alias("net_20"),
        (F.sum("turnover") / F.count("*")).alias("turnover"),
    )
    by_market = frame.groupBy("market").agg(F.sum("net").alias("n")).agg(F.max("n").alias("best"), F.sum(F.greatest("n", F.lit(0.0))).alias("gain"))
    folds = frame.groupBy("market", "fold_id").agg(F.sum("net").alias("n")).agg(F.avg((F.col("n") > 0).cast("double")).alias("fold_pass_rate"))
    out = total.crossJoin(by_market).crossJoin(folds)
    out = out.withColumn("top_share", F.when(F.col("gain") > 0, F.col("best") / F.col("gain")))
    failed = reasons(
        (F.col("net") <= 0, "net"),
        (F.col("net_15") <= 0, "net_15"),
        (F.col("net_20") <= 0, "net_20"),
        (F.col("turnover") > max_turnover, "turnover"),
        (F.coalesce(F.col("top_share"), F.lit(1.0)) > max_share, "single_market_share"),
        (F.col("fold_pass_rate") < 1, "fold_pass_rate"),
    )
    return out.withColumn("failed", failed).drop("best", "gain")


def holdout_guard(requested: set[str]) -> list[str]:
    """Changes that a final holdout run refuses."""
    return sorted(requested & {"tuning", "features", "calibration", "policy", "thresholds"})


def ledger_record(robust: DataFrame, experiment: str) -> DataFrame:
    """A flat record to append."""
    return robust.select(F.lit(experiment).alias("experiment"), (F.col("failed") == "").alias("passed"), "failed", "net", "turnover", "fold_pass_rate")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
