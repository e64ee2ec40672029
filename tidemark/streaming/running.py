"""Bars since a flag, runs of a condition, and what followed a shock, kept up in a stream.

The same columns as ``with_bars_since``, ``with_consecutive`` and ``with_shock_state`` give over whole tables, by (market,
segment): state is a handful of counters, the last shock's bar, and a ring of the ``WINDOW - 1`` last ranges.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tidemark.streaming.ordered import AT, InOrder, in_order

WINDOW, DEVIATIONS, DECAY, TINY = 20, 1.5, 5, 1e-12
OUT = "market string, session_segment_id string, at long, bars_since long, up_run long, tr double, shock boolean, retrace double, continuation double, decay double"


def last_where(mask: np.ndarray, values: np.ndarray, before: float) -> np.ndarray:
    """At each place, the value of the last place so far where ``mask`` holds; ``before`` where there was none."""
    at = np.maximum.accumulate(np.where(mask, np.arange(len(mask)), -1)) if len(mask) else np.zeros(0, np.int64)
    return np.where(at >= 0, values[np.maximum(at, 0)] if len(values) else before, before)


class Running(InOrder):
    carried = "seen long, flagged long, up_run long, close double, ranges array<double>, valids array<boolean>, isle long, live boolean, shock array<double>"
    fresh = (0, -1, 0, float("nan"), [], [], 0, False, [0.0] * 5)

    def release(self, rows, carry, now):
        seen, flagged, up_run, close, ranges, valids, isle, live, shock = carry
        n = len(rows[AT])
        if not n:
            return {}, carry, None
        valid, flag = rows["causal_valid"], rows["flag"] & rows["causal_valid"]
        high, low, c = rows["high"], rows["low"], rows["close"]
        prev = np.concatenate([[close], c[:-1]])
        # valid bars since the last flag
        count = seen + np.cumsum(valid)
        since = count - last_where(flag, count, flagged)
        known = valid & (last_where(flag, np.ones(n), float(flagged >= 0)) > 0)
        # valid bars in a row that closed higher
        up = (c > prev) & valid
        nth = np.arange(1, n + 1)
        run = nth - last_where(~up, nth, -up_run)
        # a range well above its recent mean is a shock
        tr = np.fmax(np.fmax(high - low, np.abs(high - prev)), np.abs(low - prev))
        all_tr, all_valid = np.concatenate([ranges, tr]), np.concatenate([np.array(valids, bool), valid])
        old = len(ranges)
        shocks = np.zeros(n, bool)
        if len(all_tr) >= WINDOW:
            view = np.lib.stride_tricks.sliding_window_view
            full = view(all_valid, WINDOW).all(axis=1)
            high_ = full & (all_tr[WINDOW - 1 :] > view(all_tr, WINDOW).mean(axis=1) + DEVIATIONS * view(all_tr, WINDOW).std(axis=1))
            shocks[max(0, WINDOW - 1 - old) :] = high_[max(0, old - WINDOW + 1) :]
        shocks &= valid
        # an island begins with a shock or an invalid bar; only the first kind is live
        begins = shocks | ~valid
        origin = np.maximum.accumulate(np.where(begins, np.arange(n), -1))
        own = np.maximum(origin, 0)
        on = np.where(origin >= 0, shocks[own], live) & valid
        fields = np.stack([c, high, low, tr, np.sign(c - prev)])
        sc, sh, sl, st, sd = np.where(origin >= 0, fields[:, own], np.array(shock)[:, None])
        end = old + nth
        begin = np.maximum(np.where(origin >= 0, old + origin, old - isle), end - DECAY)
        mean = sum(np.where(end - 1 - j >= begin, all_tr[np.maximum(end - 1 - j, 0)], 0.0) for j in range(DECAY)) / (end - begin)
        rising = sd > 0
        move = np.where(rising, sc - sl, sh - sc)
        denom = np.where(move >= np.maximum(TINY, st * 0.01), move, st)
        moved = on & (sd != 0) & (np.abs(denom) > TINY)
        safe = np.where(np.abs(denom) > TINY, denom, 1.0)
        optional = lambda mask, x: [float(v) if m else None for m, v in zip(mask.tolist(), x.tolist(), strict=True)]
        out = {
            "at": rows[AT],
            "bars_since": [int(v) if m else None for m, v in zip(known.tolist(), since.tolist(), strict=True)],
            "up_run": run.astype(np.int64),
            "tr": tr,
            "shock": shocks,
            "retrace": optional(moved, np.maximum(0.0, (sc - c) * sd) / safe),
            "continuation": optional(moved, np.maximum(0.0, np.where(rising, high - sh, sl - low)) / safe),
            "decay": optional(on & (sd != 0) & (st > TINY), mean / np.where(st > TINY, st, 1.0)),
        }
        flagged = int(last_where(flag, count, flagged)[-1])
        length = int(n - origin[-1]) if origin[-1] >= 0 else int(isle + n)
        state = [float(x[-1]) for x in (sc, sh, sl, st, sd)]
        live = bool(shocks[own[-1]]) if origin[-1] >= 0 else bool(live)
        keep = WINDOW - 1
        carry = (int(count[-1]), flagged, int(run[-1]), float(c[-1]), all_tr[-keep:].tolist(), all_valid[-keep:].tolist(), min(length, keep), live, state)
        return out, carry, None


def running(bars: DataFrame, late: str = "2 hours", idle_ms: int = 30 * 86_400_000) -> DataFrame:
    """A stream of (market, session_segment_id, ts, high, low, close, causal_valid, flag) to the columns of ``OUT``."""
    own = bars.select("market", "session_segment_id", "ts", "high", "low", "close", "causal_valid", "flag")
    return in_order(own, ["market", "session_segment_id"], "ts", late, Running, OUT, idle_ms)
