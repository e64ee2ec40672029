"""Forward-looking labels: entry one bar ahead, exit 16, regime 31, costs in ticks.

Windows run over the market (and the year, if ``by`` says so), not the segment: a path that leaves the segment is
found and refused. They see 60 bars back and 31 ahead, so a market is worked on in blocks with halos of so many. Bars need causal_valid, valid_ohlcv, is_synthetic, the boundary and roll flags, and per-market terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.blocks import over_blocks
from tidemark.functions.scalars import default, first_match, valid_price
from tidemark.functions.windows import SEG, Bars, true_range

ENTRY, EXIT, REGIME, ATR = 1, 16, 31, 60
#: Offset of a level that is not reached.
NEVER = 1 << 20
SEMANTICS = "next_open_entry_15m_open_exit_v1"


def path_checks(b: Bars, h: int) -> dict[str, Column]:
    return {
        "cross": ~b.future_same("session_segment_id", h),
        "synthetic": b.future_any("is_synthetic", h),
        "invalid": b.future_any(~default("valid_ohlcv", False), h),
        "boundary": b.future_any("boundary_session_flag", h),
        "roll": b.future_any(F.col("roll_window_flag") | F.col("roll_boundary_flag"), h),
    }


def add_labels(df: DataFrame, by: tuple[str, ...] = ("market",)) -> DataFrame:
    """34 columns; market terms (tick_size, tick_value, cost_ticks, min_profit_ticks, min_stop_ticks) must be joined."""
    run = SEG.run
    volume = F.coalesce(F.col("volume").cast("double"), F.lit(0.0))
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    vol_sum = F.sum(volume).over(run)
    df = df.withColumns({"_vwap": F.sum(typical * volume).over(run) / F.when(vol_sum != 0, vol_sum), "_mid": (F.max("high").over(run) + F.min("low").over(run)) / 2.0})
    return _labels(over_blocks(df, _paths, ATR, REGIME, by))


def _paths(df: DataFrame, b: Bars) -> DataFrame:
    """Entry and exit, what lies on the path, and when levels are reached."""
    df = df.withColumn("_pc", b.lag("close"))
    df = df.withColumn("_tr", true_range("_pc"))
    df = df.withColumns(
        {
            "_e_ts": b.lead("ts", ENTRY), "_x_ts": b.lead("ts", EXIT), "_e": b.lead("open", ENTRY), "_x": b.lead("open", EXIT),
            "_atr": F.avg("_tr").over(b.back(ATR)) / F.col("tick_size"),
            **{f"_{k}15": v for k, v in path_checks(b, EXIT).items()},
            **{f"_{k}30": v for k, v in path_checks(b, REGIME).items()},
            **{f"_{n}{h}": b.future(x, o, a) for h, o in (("15", EXIT), ("30", REGIME)) for n, x, a in (("hi", "high", F.max), ("lo", "low", F.min))},
        }
    )
    c = F.col
    tick = c("tick_size")
    profit = F.greatest(c("min_profit_ticks"), c("_atr") * 0.5) * tick
    adverse = F.greatest(c("min_stop_ticks"), c("_atr") * 1.0) * tick
    df = df.withColumns({"_up_p": c("_e") + profit, "_dn_p": c("_e") - profit, "_up_a": c("_e") + adverse, "_dn_a": c("_e") - adverse})
    never = F.lit(NEVER)
    hit = lambda x, level, up: F.coalesce(b.first_hit(x, level, EXIT, up), never)
    return df.withColumns({"_lp": hit("high", "_up_p", True), "_la": hit("low", "_dn_a", False), "_sp": hit("low", "_dn_p", False), "_sa": hit("high", "_up_a", True)})


def _labels(df: DataFrame) -> DataFrame:
    c = F.col
    tick, never = c("tick_size"), F.lit(NEVER)
    danger = F.greatest(c("min_stop_ticks"), c("_atr") * 1.5)
    causal, no_entry, no_exit = default("causal_valid", False), c("_e_ts").isNull(), c("_x_ts").isNull()
    bad_price = ~valid_price("_e") | ~valid_price("_x")
    cases = [
        (~causal, "current_causal_valid_false"),
        (no_entry, "entry_missing"),
        (no_exit, "exit_missing"),
        (c("_cross15"), "session_segment_cross"),
        (c("_synthetic15"), "synthetic_path"),
        (c("_invalid15"), "invalid_ohlcv_path"),
        (c("_boundary15"), "boundary_session_path"),
        (c("_roll15"), "roll_path"),
        (bad_price, "entry_exit_price_invalid"),
    ]
    reason = first_match(*cases)
    ok30 = causal & ~no_entry & valid_price("_e") & ~c("_cross30") & ~c("_synthetic30") & ~c("_invalid30") & ~c("_boundary30") & ~c("_roll30")
    df = df.withColumns({"target_invalid_reason": reason, "_ok30": ok30, "_g": (c("_x") - c("_e")) / tick})
    df = df.withColumn("target_valid", c("target_invalid_reason").isNull())
    on = lambda x: F.when(c("target_valid"), x)
    net = F.signum("_g") * F.greatest(F.abs("_g") - c("cost_ticks"), F.lit(0.0))
    sign = default(on(F.signum("_g").cast("int")), 0)
    dead = F.abs("_g") <= c("cost_ticks") + c("min_profit_ticks")
    touch = lambda level: default(c("_ok30") & (((c("_e") >= level) & (c("_lo30") <= level)) | ((c("_e") < level) & (c("_hi30") >= level))), False)
    long_, short = (default(c("target_valid") & (c(p) < never) & (c(p) < c(a)), False) for p, a in (("_lp", "_la"), ("_sp", "_sa")))
    up = default(c("_ok30") & ((c("_hi30") - c("_e")) / tick >= danger), False)
    down = default(c("_ok30") & ((c("_e") - c("_lo30")) / tick >= danger), False)
    df = df.withColumns(
        {
            "target_entry_ts": on(c("_e_ts")), "target_exit_ts": on(c("_x_ts")), "target_entry_price": on(c("_e")), "target_exit_price": on(c("_x")),
            "target_horizon_bars": on(F.lit(EXIT - ENTRY)),
            "target_ret_15m": on(c("_x") / c("_e") - 1.0),
            "target_ret_ticks_15m": on(c("_g")),
            "target_gross_dollars_15m": on(c("_g") * c("tick_value")),
            "target_estimated_cost_ticks": on(c("cost_ticks")),
            "target_estimated_cost_dollars": on(c("cost_ticks") * c("tick_value")),
            "target_net_ticks_after_est_cost": on(net),
            "target_net_dollars_after_est_cost": on(net * c("tick_value")),
            "target_sign_15m": sign,
            "target_sign_with_deadzone": F.when(default(dead, False), 0).otherwise(sign),
            "target_tradeable_after_cost": default(on(F.abs("_g") > c("cost_ticks")), False),
            "mae_ticks_15m": on((c("_lo15") - c("_e")) / tick),
            "mfe_ticks_15m": on((c("_hi15") - c("_e")) / tick),
            "fade_long_success_15m": long_, "fade_short_success_15m": short,
            "target_fade_long_success_15m": long_, "target_fade_short_success_15m": short, "target_fade_success_15m": long_ | short,
            "trend_danger_up_30m": up, "trend_danger_down_30m": down,
            # named after the side that is in danger's way as the labels define it: long copies up
            "target_trend_danger_long_30m": up, "target_trend_danger_short_30m": down, "target_trend_danger_30m": up | down,
            "revert_to_vwap_30m": touch(c("_vwap")), "revert_to_session_mid_30m": touch(c("_mid")),
            "label_semantics": F.lit(SEMANTICS), "cost_source": F.lit("settings"), "cost_provisional": F.lit(False),
        }
    )
    return df.drop(*[x for x in df.columns if x.startswith("_")])


def resolve_cost(cfg: dict, default_ticks: float = 2.0) -> float:
    """Ticks of a round turn: stated in ticks, else in dollars, else from slippage and fees, else a default."""
    tick_value = cfg.get("tick_value") or 0.0
    for key in ("round_turn_cost_ticks", "estimated_cost_ticks", "cost_ticks", "total_cost_ticks", "round_trip_cost_ticks", "all_in_cost_ticks"):
        if cfg.get(key) is not None:
            return float(cfg[key])
    for key in ("round_turn_cost_dollars", "estimated_cost_dollars", "cost_dollars", "total_cost_dollars", "round_trip_cost_dollars", "all_in_cost_dollars"):
        if cfg.get(key) is not None and tick_value:
            return float(cfg[key]) / tick_value
    if cfg.get("slippage_ticks_per_side") is not None and tick_value:
        fees = (cfg.get("commission_per_contract_dollars") or 0.0) + (cfg.get("exchange_fees_dollars") or 0.0)
        return 2 * float(cfg["slippage_ticks_per_side"]) + 2 * fees / tick_value
    return default_ticks
