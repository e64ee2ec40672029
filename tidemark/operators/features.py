"""122 causal features in 14 families.

Built in layers of columns, each of windows over the layer before, all over one partitioning and order, so the plan has one exchange
and one sort for the feature block. Prices are gated first: an invalid bar has none. At the end invalid bars get NULL, or false for flags.

A sliding frame costs a row its whole width, so only means and deviations slide. Whether n rows are there is the length of the streak
so far, counts of flags are differences of running ones (whole numbers, so exact), and extremes of long frames are those of short ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import windows as W
from tidemark.functions.scalars import clip, default, row_std, safe_div
from tidemark.functions.windows import SEG

TIER1 = ("ES", "ZN", "CL", "6E")
FAMILIES: dict[str, list[str]] = {
    "baseline_ohlcv": ["ret_1", "ret_5", "ret_10", "ret_20", "log_ret_1", "range_norm", "true_range", "ewma_vol_20", "volume_z_20", "close_position_in_range", "body_to_range", "upper_wick_ratio", "lower_wick_ratio", "minutes_since_session_open", "minutes_until_session_close", "session_progress", "minute_of_day_sin", "minute_of_day_cos", "day_of_week"],
    "fade_safety_trend_danger": ["efficiency_ratio_15", "efficiency_ratio_30", "efficiency_ratio_60", "directional_bar_ratio_15", "directional_bar_ratio_30", "consecutive_up_bars", "consecutive_down_bars", "trend_persistence_30", "signed_trend_persistence_30"],
    "breakout_rejection": ["prior_high_20_dist", "prior_low_20_dist", "breakout_above_20", "breakout_below_20", "failed_breakout_above_20", "failed_breakout_below_20", "close_back_inside_range_20", "upper_wick_rejection", "lower_wick_rejection"],
    "range_chop": ["realized_range_30", "realized_range_60", "range_compression_30_vs_120", "chop_ratio_30", "inside_bar_count_20", "overlap_ratio_20"],
    "session_structure": ["session_open_dist", "session_high_dist", "session_low_dist", "session_mid_dist", "session_vwap_dist", "session_range_percentile", "opening_range_30_ready", "opening_range_30_high_dist", "opening_range_30_low_dist", "opening_range_30_breakout_up", "opening_range_30_breakout_down"],
    "volatility_volume": ["realized_vol_15", "realized_vol_60", "vol_expansion_15_vs_60", "large_bar_count_30", "shock_bar_flag", "bars_since_shock", "volume_z_60", "volume_surge_with_range", "volume_surge_without_progress", "range_per_volume", "volume_climax_flag", "bars_since_volume_climax"],
    "higher_timeframe_prior_session": ["5m_ret_3", "15m_ret_4", "60m_trend_slope", "daily_open_dist", "prior_session_high_dist", "prior_session_low_dist", "prior_session_close_dist", "prior_session_range_pct", "overnight_gap_ticks"],
    "time_buckets": ["time_bucket_globex_open", "time_bucket_europe", "time_bucket_us_open", "time_bucket_midday", "time_bucket_power_hour", "first_30m_flag", "last_30m_flag"],
    "effort_result": ["effort_result_30", "absorption_proxy_30", "exhaustion_proxy_30", "volume_per_tick_progress_30", "range_without_close_progress_30"],
    "trend_day_open_drive": ["open_drive_up", "open_drive_down", "open_drive_strength_30", "session_one_wayness", "vwap_side_persistence", "bars_above_vwap_30", "bars_below_vwap_30", "pullback_shallowness_30"],
    "auction_acceptance": ["session_range_extension_up", "session_range_extension_down", "session_acceptance_above_mid", "session_acceptance_below_mid", "failed_retest_session_high", "failed_retest_session_low"],
    "shock_decay": ["shock_direction", "bars_since_up_shock", "bars_since_down_shock", "post_shock_retrace_pct", "post_shock_continuation_pct", "post_shock_range_decay"],
    "tier1_intermarket": ["rel_ret_vs_ES_15", "rel_ret_vs_ZN_15", "rel_ret_vs_CL_15", "rel_ret_vs_6E_15", "corr_vs_ES_60", "corr_vs_ZN_60", "corr_vs_CL_60", "corr_vs_6E_60", "es_zn_divergence_30", "cl_es_divergence_30"],
    "tier1_cross_market_regime": ["tier1_direction_agreement_15", "tier1_return_dispersion_15", "tier1_risk_on_score_30", "es_zn_risk_regime_30", "cl_es_macro_divergence_30"],
}
FEATURES = [f for names in FAMILIES.values() for f in names]
#: Never features, whatever their prefix.
FORBIDDEN = ("target_", "mae_", "mfe_", "fade_", "trend_danger_", "revert_to_")


def input_valid() -> Column:
    prices = F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull() & F.col("volume").isNotNull()
    flags = ~default("is_synthetic", False) & ~default("roll_window_flag", False) & ~default("boundary_session_flag", False)
    return default("causal_valid", False) & default("valid_ohlcv", True) & flags & prices


def add_base(df: DataFrame) -> DataFrame:
    """The twelve families of one market's own bars; needs session fields, tick_size and the causal flags."""
    c, V = F.col, "feature_input_valid"
    df = df.withColumns({V: input_valid(), "_rn": F.row_number().over(SEG.spec)})
    gate = lambda x: F.when(c(V), c(x).cast("double"))
    df = df.withColumns({"_o": gate("open"), "_h": gate("high"), "_l": gate("low"), "_c": gate("close"), "_v": gate("volume"), "_nv": SEG.streak(F.when(c(V), 1))})
    mask = lambda n: c("_nv") >= n
    full = lambda x, n, agg: F.when(SEG.streak(x) >= n, agg(c(x)).over(SEG.back(n)))
    ret_over = lambda k: F.when(mask(k + 1), c("close") / SEG.lag("close", k) - 1)
    tick, valid = c("tick_size"), c(V)
    df = df.withColumns({"_pc": SEG.lag("_c"), "_ph": SEG.lag("_h"), "_pl": SEG.lag("_l"), **{f"_c{k}": SEG.lag("_c", k) for k in (15, 30, 60)}, **{f"_r{k}": ret_over(k) for k in (1, 5, 10, 15, 20, 30, 60)}})
    df = df.withColumns({"_tr": W.true_range("_pc", "_h", "_l"), "_dir": F.when(valid, F.signum(c("_c") - c("_pc"))), "_step": F.when(valid, F.abs(c("_c") - c("_pc")))})
    union = F.greatest("_h", "_ph") - F.least("_l", "_pl")
    df = df.withColumns(
        {
            "_pdir": SEG.lag("_dir"),
            "_inside": F.when(c("_ph").isNotNull() & c("_pl").isNotNull(), default((c("_h") <= c("_ph")) & (c("_l") >= c("_pl")), False).cast("double")),
            "_overlap": safe_div(clip(F.least("_h", "_ph") - F.greatest("_l", "_pl"), low=0.0), union),
            "_so": SEG.first("_o"), "_sh": SEG.running("_h", F.max), "_sl": SEG.running("_l", F.min),
            "_pv": SEG.running_sum(c("_c") * c("_v")), "_cv": SEG.running("_v", F.sum),
            "_trm": full("_tr", 60, F.avg), "_trs": full("_tr", 60, F.stddev_pop), "_vm": full("_v", 60, F.avg), "_vs": full("_v", 60, F.stddev_pop),
            "_hx": F.max("_h").over(SEG.back(20)), "_lx": F.min("_l").over(SEG.back(20)), "_m20": mask(20),
            "_rv15": full("_r1", 15, F.stddev_pop), "_rv60": full("_r1", 60, F.stddev_pop),
            "_trsum": full("_tr", 30, F.sum), "_vsum": full("_v", 30, F.sum),
            **{f"_er{k}": safe_div(F.abs(c("_c") - c(f"_c{k}")), full("_step", k, F.sum)) for k in (15, 30, 60)},
            "_m60": mask(60), "_m120": mask(120),
            "_vz20": safe_div(c("_v") - full("_v", 20, F.avg), full("_v", 20, F.stddev_pop)),
        }
    )
    yes = lambda x: default(x, False)
    # extremes of 20 bars that end at earlier ones cover a longer frame
    highs, lows = (lambda *ks: F.greatest("_hx", *[SEG.lag("_hx", k) for k in ks])), (lambda *ks: F.least("_lx", *[SEG.lag("_lx", k) for k in ks]))
    span_of = {30: (10,), 60: (20, 40), 120: (20, 40, 60, 80, 100)}
    df = df.withColumns({"_hi20": F.when(mask(20), c("_hx")), "_lo20": F.when(mask(20), c("_lx")), **{f"_r{n}r": F.when(mask(n), highs(*ks) - lows(*ks)) for n, ks in span_of.items()}})
    df = df.withColumns(
        {
            "_same": F.when(c("_pdir").isNotNull(), yes(c("_dir") == c("_pdir")).cast("double")),
            "_ph20": SEG.lag("_hi20"), "_pl20": SEG.lag("_lo20"), "_ready20": yes(SEG.lag("_m20")),
            "_mid": (c("_sh") + c("_sl")) / 2.0, "_sr": c("_sh") - c("_sl"), "_vwap": safe_div("_pv", "_cv"),
            "_shock": yes((c("_tr") > c("_trm") + 3.0 * c("_trs")) & c("_m60")),
            "_large": F.when(valid & c("_trm").isNotNull() & c("_trs").isNotNull(), yes(c("_tr") > c("_trm") + 2.0 * c("_trs")).cast("double")),
            "_vz60": safe_div(c("_v") - c("_vm"), "_vs"), "_rz": safe_div(c("_tr") - c("_trm"), "_trs"),
            "_psh": SEG.lag("_sh"), "_psl": SEG.lag("_sl"),
        }
    )
    df = df.withColumns(
        {
            "_climax": yes(c("_vz60") > 3.0) & valid,
            "_sdir": F.when(c("_shock"), c("_dir")).otherwise(0.0),
            "_above": F.when(valid, yes(c("_c") > c("_vwap")).cast("double")), "_below": F.when(valid, yes(c("_c") < c("_vwap")).cast("double")),
            "_amid": F.when(valid, yes(c("_c") > c("_mid")).cast("double")), "_bmid": F.when(valid, yes(c("_c") < c("_mid")).cast("double")),
        }
    )
    df = W.with_prior_segment(df, "_p")
    df = W.with_first_n(df, 30, V, "_or")
    df = W.with_ewm_std(df, "_r1", 20, "_ewm")
    df = W.with_consecutive(df, c("_c") > c("_pc"), V, "_nup")
    df = W.with_consecutive(df, c("_c") < c("_pc"), V, "_ndown")
    for name, flag in (("_bs", c("_shock")), ("_bsc", c("_climax")), ("_bsu", c("_shock") & (c("_sdir") > 0)), ("_bsd", c("_shock") & (c("_sdir") < 0))):
        df = W.with_bars_since(df, flag, V, name)
    df = W.with_shock_state(df, "_shock", V, "_pc", "_tr")
    marks = ("_same", "_inside", "_large", "_above", "_below", "_amid", "_bmid")  # of 0 and 1
    df = df.withColumns({f"{x}_sum": F.sum(F.when(valid, c(x))).over(SEG.run) for x in marks} | {f"{x}_known": SEG.streak(F.when(valid, c(x))) for x in marks})
    above = yes(c("_h") > c("_ph20")) & c("_ready20") & valid
    below = yes(c("_l") < c("_pl20")) & c("_ready20") & valid
    span = c("_h") - c("_l")
    upper, lower = safe_div(c("_h") - F.greatest("_o", "_c"), span), safe_div(F.least("_o", "_c") - c("_l"), span)
    ready = c("_or_ready")
    drive = F.abs(c("_or_close") - c("_or_open")) / F.greatest(c("_or_high") - c("_or_low"), tick) >= 0.65
    reach = F.abs(c("_c") - c("_so"))
    room = F.greatest("_sr", tick)
    adverse = F.when(c("_c") >= c("_so"), c("_sh") - c("_c")).otherwise(c("_c") - c("_sl"))
    progress = F.abs(c("_c") - c("_c30"))
    effort, per_range = safe_div(progress, "_trsum"), safe_div("_vsum", "_trsum")
    spare = 1.0 - clip(effort, 0.0, 1.0)
    bucket = lambda x, a, b: c(x).between(a, b) & valid
    count = lambda x, n: F.when(c(f"{x}_known") >= n, c(f"{x}_sum") - F.coalesce(SEG.lag(f"{x}_sum", n), F.lit(0.0)))
    ticks = lambda x: x / tick
    floor0 = lambda x: clip(x, low=0.0)
    made: dict[str, Column] = {
        "ret_1": c("_r1"), "ret_5": c("_r5"), "ret_10": c("_r10"), "ret_20": c("_r20"), "log_ret_1": F.log1p("_r1"),
        "range_norm": safe_div(span, F.abs("_c")), "true_range": c("_tr"), "ewma_vol_20": c("_ewm"), "volume_z_20": c("_vz20"),
        "close_position_in_range": safe_div(c("_c") - c("_l"), span), "body_to_range": safe_div(F.abs(c("_c") - c("_o")), span), "upper_wick_ratio": upper, "lower_wick_ratio": lower,
        "minutes_since_session_open": c("minutes_since_session_open").cast("double"), "minutes_until_session_close": c("minutes_until_session_close").cast("double"), "session_progress": c("session_progress"),
        "minute_of_day_sin": F.sin(2 * F.pi() * c("minute_of_day") / 1440), "minute_of_day_cos": F.cos(2 * F.pi() * c("minute_of_day") / 1440), "day_of_week": c("day_of_week").cast("double"),
        "efficiency_ratio_15": c("_er15"), "efficiency_ratio_30": c("_er30"), "efficiency_ratio_60": c("_er60"),
        "directional_bar_ratio_15": count("_same", 15) / 15.0, "directional_bar_ratio_30": count("_same", 30) / 30.0,
        "consecutive_up_bars": c("_nup").cast("double"), "consecutive_down_bars": c("_ndown").cast("double"),
        "trend_persistence_30": c("_er30"), "signed_trend_persistence_30": c("_er30") * F.signum(c("_c") - c("_c30")),
        "prior_high_20_dist": F.when(c("_ready20"), ticks(c("_c") - c("_ph20"))), "prior_low_20_dist": F.when(c("_ready20"), ticks(c("_c") - c("_pl20"))),
        "breakout_above_20": above, "breakout_below_20": below,
        "failed_breakout_above_20": above & yes(c("_c") <= c("_ph20")), "failed_breakout_below_20": below & yes(c("_c") >= c("_pl20")),
        "close_back_inside_range_20": yes((c("_c") <= c("_ph20")) & (c("_c") >= c("_pl20"))) & c("_ready20") & valid,
        "upper_wick_rejection": yes(upper > 0.5) & valid, "lower_wick_rejection": yes(lower > 0.5) & valid,
        "realized_range_30": c("_r30r"), "realized_range_60": c("_r60r"), "range_compression_30_vs_120": F.when(c("_m120"), safe_div("_r30r", "_r120r")),
        "chop_ratio_30": safe_div("_trsum", progress), "inside_bar_count_20": count("_inside", 20), "overlap_ratio_20": full("_overlap", 20, F.avg),
        "session_open_dist": ticks(c("_c") - c("_so")), "session_high_dist": ticks(c("_c") - c("_sh")), "session_low_dist": ticks(c("_c") - c("_sl")), "session_mid_dist": ticks(c("_c") - c("_mid")), "session_vwap_dist": ticks(c("_c") - c("_vwap")),
        "session_range_percentile": safe_div("_sr", "_p_range"), "opening_range_30_ready": ready,
        "opening_range_30_high_dist": F.when(ready, ticks(c("_c") - c("_or_high"))), "opening_range_30_low_dist": F.when(ready, ticks(c("_c") - c("_or_low"))),
        "opening_range_30_breakout_up": yes(c("_c") > c("_or_high")) & ready & valid, "opening_range_30_breakout_down": yes(c("_c") < c("_or_low")) & ready & valid,
        "realized_vol_15": c("_rv15"), "realized_vol_60": c("_rv60"), "vol_expansion_15_vs_60": safe_div("_rv15", "_rv60"),
        "large_bar_count_30": count("_large", 30), "shock_bar_flag": c("_shock"), "bars_since_shock": c("_bs").cast("double"), "volume_z_60": c("_vz60"),
        "volume_surge_with_range": yes((c("_vz60") > 2.0) & (c("_rz") > 1.0)) & valid, "volume_surge_without_progress": yes((c("_vz60") > 2.0) & (c("_er30") < 0.2)) & valid,
        "range_per_volume": safe_div("_tr", "_v"), "volume_climax_flag": c("_climax"), "bars_since_volume_climax": c("_bsc").cast("double"),
        "5m_ret_3": c("_r15"), "15m_ret_4": c("_r60"), "60m_trend_slope": F.when(c("_m60"), (c("_c") - c("_c60")) / 60.0), "daily_open_dist": ticks(c("_c") - c("_so")),
        "prior_session_high_dist": ticks(c("_c") - c("_p_high")), "prior_session_low_dist": ticks(c("_c") - c("_p_low")), "prior_session_close_dist": ticks(c("_c") - c("_p_close")),
        "prior_session_range_pct": safe_div("_sr", "_p_range"), "overnight_gap_ticks": ticks(c("_so") - c("_p_close")),
        "time_bucket_globex_open": bucket("minute_of_day", 1020, 1139), "time_bucket_europe": bucket("minute_of_day", 120, 479), "time_bucket_us_open": bucket("minute_of_day", 480, 569),
        "time_bucket_midday": bucket("minute_of_day", 660, 839), "time_bucket_power_hour": bucket("minute_of_day", 900, 959),
        "first_30m_flag": yes(bucket("minutes_since_session_open", 0, 29)), "last_30m_flag": yes(bucket("minutes_until_session_close", 0, 29)),
        "effort_result_30": effort, "absorption_proxy_30": per_range * spare, "exhaustion_proxy_30": per_range * c("_er30") * spare,
        "volume_per_tick_progress_30": c("_vsum") / clip(ticks(progress), low=1.0), "range_without_close_progress_30": c("_trsum") / F.when(progress.isNotNull(), F.greatest(progress, tick)),
        "open_drive_up": yes(drive & (c("_or_close") > c("_or_open"))) & ready & valid, "open_drive_down": yes(drive & (c("_or_close") < c("_or_open"))) & ready & valid,
        "open_drive_strength_30": F.when(ready, safe_div(reach, room)), "session_one_wayness": safe_div(reach, room),
        "vwap_side_persistence": F.greatest(count("_above", 30), count("_below", 30)) / 30.0,
        "bars_above_vwap_30": count("_above", 30), "bars_below_vwap_30": count("_below", 30),
        "pullback_shallowness_30": 1.0 - safe_div(adverse, F.greatest(reach, tick)),
        "session_range_extension_up": F.when(c("_p_high").isNotNull(), ticks(floor0(c("_c") - c("_p_high")))), "session_range_extension_down": F.when(c("_p_low").isNotNull(), ticks(floor0(c("_p_low") - c("_c")))),
        "session_acceptance_above_mid": count("_amid", 30) / 30.0, "session_acceptance_below_mid": count("_bmid", 30) / 30.0,
        "failed_retest_session_high": yes((c("_h") > c("_psh")) & (c("_c") < c("_psh"))) & valid, "failed_retest_session_low": yes((c("_l") < c("_psl")) & (c("_c") > c("_psl"))) & valid,
        "shock_direction": c("_sdir"), "bars_since_up_shock": c("_bsu").cast("double"), "bars_since_down_shock": c("_bsd").cast("double"),
        "post_shock_retrace_pct": c("post_shock_retrace_pct"), "post_shock_continuation_pct": c("post_shock_continuation_pct"), "post_shock_range_decay": c("post_shock_range_decay"),
    }
    flags = {n for n in made if n.startswith(("breakout", "failed", "close_back", "time_bucket", "first_30m", "last_30m")) or n.endswith(("_rejection", "_ready", "breakout_up", "breakout_down", "_flag", "with_range", "without_progress", "drive_up", "drive_down"))}
    df = df.withColumns({f"feature_{n}": x for n, x in made.items()})
    df = df.withColumns({f"feature_{n}": yes(c(f"feature_{n}") & valid) if n in flags else F.when(valid, c(f"feature_{n}")) for n in made})
    keep_returns = {"_self15": c("_r15"), "_self30": c("_r30")}
    df = df.withColumns({f"own{k}": x for k, x in keep_returns.items()})
    return df.drop(*[x for x in df.columns if x.startswith("_")], "post_shock_retrace_pct", "post_shock_continuation_pct", "post_shock_range_decay")


def add_intermarket(df: DataFrame) -> DataFrame:
    """Returns of the tier-1 markets at the same instant: one aggregation by time and one join, not a read per pair."""
    c = F.col
    picks = {"1": "feature_ret_1", "15": "own_self15", "30": "own_self30"}
    others = df.where(c("market").isin(*TIER1)).groupBy("ts").agg(*[F.max(F.when(c("market") == m, c(x))).alias(f"_{m}_{k}") for m in TIER1 for k, x in picks.items()])
    df = df.join(others, "ts", "left")
    df = df.withColumns({f"_{m}_{k}_o": F.when(c("market") != m, c(f"_{m}_{k}")) for m in TIER1 for k in picks})
    out: dict[str, Column] = {}
    for m in TIER1:
        out[f"rel_ret_vs_{m}_15"] = F.when(c("feature_input_valid"), c("own_self15") - c(f"_{m}_15_o"))
        out[f"corr_vs_{m}_60"] = SEG.rolling_corr("feature_ret_1", f"_{m}_1_o", 60)
    # a market's own leg is its own return
    own = lambda m: F.when(c("market") == m, c("own_self30")).otherwise(c(f"_{m}_30"))
    es, zn, cl = own("ES"), own("ZN"), own("CL")
    out |= {"es_zn_divergence_30": es - zn, "cl_es_divergence_30": cl - es, "es_zn_risk_regime_30": es - zn, "cl_es_macro_divergence_30": cl - es}
    part = lambda m, x: F.when(c("market") == m, 0.0).otherwise(x)
    out["tier1_risk_on_score_30"] = part("ES", c("_ES_30")) + part("ZN", -c("_ZN_30")) + part("CL", 0.5 * c("_CL_30"))
    legs = [c(f"_{m}_15_o") for m in TIER1]
    known = sum((x.isNotNull().cast("int") for x in legs), F.lit(0))
    agree = sum((default(F.signum(x) == F.signum("own_self15"), False).cast("int") for x in legs), F.lit(0))
    out["tier1_direction_agreement_15"] = agree / F.when(known > 0, known)
    out["tier1_return_dispersion_15"] = row_std(*legs)
    df = df.withColumns({f"feature_{n}": x for n, x in out.items()})
    return df.drop(*[x for x in df.columns if x.startswith("_")])


def build(df: DataFrame) -> DataFrame:
    """Labeled bars to the feature matrix."""
    out = add_intermarket(add_base(df)).drop("own_self15", "own_self30")
    return out.withColumn("training_row_valid", F.col("feature_input_valid") & default("target_valid", False))


def registry(columns: list[str]) -> list[tuple[str, str]]:
    """(family, feature) of the feature columns; a forbidden or unknown one raises."""
    family = {f"feature_{f}": k for k, fs in FAMILIES.items() for f in fs}
    found = [x for x in columns if x.startswith("feature_") and x not in ("feature_input_valid",)]
    bad = [x for x in found if x not in family or x.removeprefix("feature_").startswith(FORBIDDEN)]
    if bad:
        raise ValueError(f"not features: {bad}")
    return [(family[x], x) for x in found]
