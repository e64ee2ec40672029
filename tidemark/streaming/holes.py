"""Missing minutes of a session, filled in a stream.

State is kept by (market, session): the last bar given out, and the bars that the watermark has not passed. Two rules:

* ``filled`` gives a hole's flat bars when the bar behind the hole is due: the same bars as ``causal.fill_gaps``.
* ``live`` does not wait for that bar. A timer gives a flat bar for each minute that the watermark passes without one, for
  ``most_minutes`` after the last bar and not beyond the session's end; a bar that comes after its minute was filled
  is late and dropped.

A flat bar has the close before it as its prices and no volume; bars outside a session pass unfilled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.streaming.ordered import AT, NONE, InOrder, in_order

OUT = "market string, session_id string, at long, open double, high double, low double, close double, volume long, instrument_id long, is_synthetic boolean, gap_minutes long"
PRICES = ("open", "high", "low", "close")


class Holes(InOrder):
    #: last bar's time and close, its contract, flat bars given out behind it, the end of its session
    carried = "at long, close double, instrument_id long, given long, until long"
    fresh = (NONE, float("nan"), NONE, 0, NONE)

    def __init__(self, *args, step_minutes: int = 1, most_minutes: int = 120, live: bool = False):
        super().__init__(*args)
        self.step, self.most, self.live = step_minutes * 60_000, most_minutes * 60_000, live

    def settled(self, carry: tuple) -> int:
        return carry[0] + carry[3] * self.step if carry[0] != NONE else NONE

    def release(self, rows, carry, now):
        at, close, contract, given, until = carry
        n, first = len(rows[AT]), int(at != NONE)
        times, closes, contracts = (np.append([before] * first, rows[c]).astype(rows[c].dtype) for before, c in ((at, AT), (close, "close"), (contract, "instrument_id")))
        gap = np.diff(times)
        if self.live:
            # a hole's flat bars end where the watermark, the limit or the next bar does
            flats = np.where(np.isfinite(closes[:-1]), np.minimum((gap - 1) // self.step, self.most // self.step), 0)
        else:
            # an unknown contract changes nothing, as a comparison with NULL does
            same = (contracts[1:] == contracts[:-1]) | (contracts[1:] == NONE) | (contracts[:-1] == NONE)
            hole = (gap > self.step) & (gap <= self.most) & same & np.isfinite(closes[:-1])
            flats = np.where(hole, -(-gap // self.step) - 1, 0)
        inside = rows["inside_session"] if n else np.zeros(0, bool)
        flats = np.where(inside[1 - first :], flats, 0) if n else flats
        skip = np.zeros(len(flats), np.int64)
        if first and len(flats):
            skip[0] = given if self.live else 0
        new = {c: [] for c in ("at", *PRICES, "volume", "instrument_id", "is_synthetic", "gap_minutes")}

        def add(when, price, volume, ids, synthetic, minutes) -> None:
            for c, v in zip(new, (when, *(price if isinstance(price, tuple) else (price,) * 4), volume, ids, np.full(len(when), synthetic), minutes), strict=True):
                new[c].append(np.asarray(v))

        if n:
            add(rows[AT], tuple(rows[p] for p in PRICES), rows["volume"], rows["instrument_id"], False, np.full(n, NONE))
        count = np.maximum(flats - skip, 0)
        hole_of = np.repeat(np.arange(len(count)), count)
        nth = np.arange(len(hole_of)) - np.repeat(np.cumsum(count) - count, count) + 1 + skip[hole_of]
        add(times[:-1][hole_of] + nth * self.step, closes[:-1][hole_of], np.zeros(len(hole_of), np.int64), contracts[:-1][hole_of], True, np.full(len(hole_of), NONE) if self.live else gap[hole_of] // 60_000)
        if n:
            at, close, contract, given = int(rows[AT][-1]), float(rows["close"][-1]), int(rows["instrument_id"][-1]), 0
            until = int(rows["session_end"][-1]) if inside[-1] else NONE
        wake = None
        if self.live and at != NONE and until != NONE and np.isfinite(close):
            most = min(self.most // self.step, (until - 1 - at) // self.step)
            due = int(min((now - at) // self.step, most))
            if due > given:
                k = np.arange(given + 1, due + 1)
                add(at + k * self.step, np.full(len(k), close), np.zeros(len(k), np.int64), np.full(len(k), contract), True, np.full(len(k), NONE))
                given = due
            wake = at + (given + 1) * self.step if given < most else None
        out = {c: np.concatenate(v) for c, v in new.items()}
        order = np.argsort(out["at"], kind="stable")
        out = {c: v[order] for c, v in out.items()}
        for c in ("volume", "instrument_id", "gap_minutes"):
            out[c] = [None if x == NONE else x for x in out[c].astype(np.int64).tolist()]
        for c in PRICES:
            out[c] = [x if np.isfinite(x) else None for x in out[c].tolist()]
        return out, (at, close, contract, given, until), wake


def filled(bars: DataFrame, late: str = "2 hours", step_minutes: int = 1, most_minutes: int = 120, live: bool = False, idle_ms: int = 86_400_000) -> DataFrame:
    """A stream of (market, session_id, ts, open, high, low, close, volume, instrument_id, inside_session, session_end in ms) with its holes filled.

    Columns of the result: ``OUT``; gap_minutes is the size of a flat bar's hole, unknown if ``live``.
    """
    own = bars.select("market", "session_id", "ts", *PRICES, *[F.col(c).cast("long").alias(c) for c in ("volume", "instrument_id", "session_end")], "inside_session")
    return in_order(own, ["market", "session_id"], "ts", late, Holes, OUT, idle_ms, step_minutes=step_minutes, most_minutes=most_minutes, live=live)
