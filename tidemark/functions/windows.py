"""Window functions over bars.

Features look back within (market, session_segment_id); labels look ahead within the market. All share one of two
window specifications, so a stage needs one exchange and one sort. A rolling value needs n values that
are there, not n rows; NULL rows of running values are NULL themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.scalars import c, shock_denominator

START = Window.unboundedPreceding


class Bars:
    """Window helpers over one partitioning and order."""

    def __init__(self, by: tuple[str, ...] = ("market", "session_segment_id"), order: str = "ts"):
        self.by, self.order = by, order

    def streak(self, x: Column | str, rn: str = "_rn") -> Column:
        """How many rows in a row, this one the last, have a value. One running step a row, however far a window looks back; ``rn`` numbers a partition's rows from 1."""
        return F.col(rn) - F.coalesce(F.last(F.when(c(x).isNull(), F.col(rn)), True).over(self.run), F.lit(0))

    @property
    def spec(self) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(self.order)

    @property
    def run(self) -> WindowSpec:
        return self.spec.rowsBetween(START, 0)

    @property
    def whole(self) -> WindowSpec:
        return self.spec.rowsBetween(START, Window.unboundedFollowing)

    def back(self, n: int) -> WindowSpec:
        return self.spec.rowsBetween(-(n - 1), 0)

    def ahead(self, a: int, b: int) -> WindowSpec:
        return self.spec.rowsBetween(a, b)

    def lag(self, x: Column | str, k: int = 1) -> Column:
        return F.lag(c(x), k).over(self.spec)

    def lead(self, x: Column | str, k: int = 1) -> Column:
        return F.lead(c(x), k).over(self.spec)

    def full(self, x: Column | str, n: int, agg: Callable[[Column], Column]) -> Column:
        """An aggregate of the last n rows where all n have a value."""
        return F.when(F.count(c(x)).over(self.back(n)) == n, agg(c(x)).over(self.back(n)))

    def mask(self, valid: Column | str, n: int) -> Column:
        """The last n rows exist and are valid."""
        return F.sum(F.coalesce(c(valid), F.lit(False)).cast("int")).over(self.back(n)) == n

    def full_valid(self, x: Column | str, valid: Column | str, n: int, agg: Callable[[Column], Column]) -> Column:
        return F.when(self.mask(valid, n), self.full(F.when(c(valid), c(x)), n, agg))

    def true_count(self, cond: Column, valid: Column | str, n: int) -> Column:
        return self.full(F.when(c(valid), cond.cast("double")), n, F.sum)

    def ret_over(self, close: Column | str, valid: Column | str, k: int) -> Column:
        """Return over k bars; needs k + 1 valid bars in a row."""
        return F.when(self.mask(valid, k + 1), c(close) / self.lag(close, k) - 1)

    def rolling_corr(self, a: Column | str, b: Column | str, n: int) -> Column:
        """Pearson over the last n rows, all complete; NULL where either is constant."""
        both = c(a).isNotNull() & c(b).isNotNull()
        x, y = (F.when(both, c(v)).cast("double") for v in (a, b))
        w = self.back(n)
        mean = lambda v: F.avg(v).over(w)
        cov = mean(x * y) - mean(x) * mean(y)
        vx, vy = (F.stddev_pop(v).over(w) for v in (x, y))
        return F.when((F.count(x).over(w) == n) & (vx > 1e-12) & (vy > 1e-12), cov / (vx * vy))

    def ewm_parts(self, x: Column | str, span: int) -> tuple[Column, Column]:
        """What an observation leaves of the weights before it, and its own share; gaps decay."""
        x = c(x).cast("double")
        rn = F.row_number().over(self.spec)
        last = F.last(F.when(x.isNotNull(), rn), True).over(self.spec.rowsBetween(START, -1))
        alpha = 2.0 / (span + 1)
        old = F.pow(F.lit(1 - alpha), (rn - last).cast("double"))
        keep = F.when(x.isNotNull(), F.when(last.isNull(), 1.0).otherwise(old / (old + alpha)))
        new = F.when(x.isNotNull(), F.when(last.isNull(), 1.0).otherwise(alpha / (old + alpha)))
        return keep, new

    def since_parts(self, flag: Column, valid: Column | str) -> tuple[Column, Column]:
        """Valid bars so far, on valid bars; the same on flagged ones."""
        v = F.coalesce(c(valid), F.lit(False))
        seen = F.sum(v.cast("int")).over(self.run)
        return F.when(v, seen), F.when(F.coalesce(flag, F.lit(False)) & v, seen)

    def running(self, x: Column | str, agg: Callable[[Column], Column]) -> Column:
        return F.when(c(x).isNotNull(), agg(c(x)).over(self.run))

    def running_sum(self, x: Column | str) -> Column:
        """The running sum rounded once at its end: parts in steps of 2^-10 and what is left of them add up without rounding, up to 8e12."""
        coarse = F.rint(c(x) * 1024.0) / 1024.0
        return F.when(c(x).isNotNull(), F.sum(coarse).over(self.run) + F.sum(c(x) - coarse).over(self.run))

    def first(self, x: Column | str) -> Column:
        return F.first(c(x), True).over(self.whole)

    def future(self, x: Column | str, h: int, agg: Callable[[Column], Column], start: int = 1) -> Column:
        return agg(c(x)).over(self.ahead(start, h))

    def future_any(self, flag: Column | str, h: int) -> Column:
        return F.coalesce(F.max(F.coalesce(c(flag), F.lit(False)).cast("int")).over(self.ahead(0, h)), F.lit(0)) == 1

    def future_same(self, key: Column | str, h: int) -> Column:
        """The next h rows exist and share this row's key."""
        w = self.ahead(1, h)
        return F.coalesce((F.count(c(key)).over(w) == h) & (F.min(c(key)).over(w) == c(key)) & (F.max(c(key)).over(w) == c(key)), F.lit(False))

    def first_hit(self, x: Column | str, level: Column | str, h: int, up: bool = True) -> Column:
        """The first offset of 1 to h at which x reaches the row's level."""
        hit = (lambda k: self.lead(x, k) >= c(level)) if up else (lambda k: self.lead(x, k) <= c(level))
        return F.coalesce(*[F.when(hit(k), k) for k in range(1, h + 1)])


SEG = Bars()
MARKET = Bars(("market",))


def with_ewm_std(df, x: str, span: int, name: str, bars: Bars = SEG):
    """Add an exponentially weighted deviation: recursive form, bias-corrected, from ``span`` values on.

    Weights are products of factors over the observations, so they come from a running sum of logarithms.
    """
    keep, new = bars.ewm_parts(x, span)
    v = F.col(x).cast("double")
    step = df.withColumns({"__keep": keep, "__new": new})
    step = step.withColumn("__s", F.sum(F.log("__keep")).over(bars.run))
    part = lambda y, k: F.exp(k * F.col("__s")) * F.sum(y * F.exp(-k * F.col("__s"))).over(bars.run)
    step = step.withColumns(
        {
            "__m1": part(F.col("__new") * v, F.lit(1.0)),
            "__m2": part(F.col("__new") * v * v, F.lit(1.0)),
            "__w2": part(F.col("__new") * F.col("__new"), F.lit(2.0)),
            "__n": F.count(v).over(bars.run),
        }
    )
    var = (F.col("__m2") - F.col("__m1") * F.col("__m1")) / F.when(F.col("__w2") < 1 - 1e-12, 1 - F.col("__w2"))
    return step.withColumn(name, F.when(F.col("__n") >= span, F.sqrt(F.greatest(var, F.lit(0.0))))).drop("__keep", "__new", "__s", "__m1", "__m2", "__w2", "__n")


def with_bars_since(df, flag: Column, valid: str, name: str, bars: Bars = SEG):
    """Valid bars since the last flag; an invalid bar shows NULL and counts for nothing."""
    seen, at = bars.since_parts(flag, valid)
    step = df.withColumns({"__seen": seen, "__at": at})
    return step.withColumn(name, F.col("__seen") - F.last("__at", True).over(bars.run)).drop("__seen", "__at")


def with_consecutive(df, cond: Column, valid: str, name: str, bars: Bars = SEG):
    """How many rows in a row the condition has held on valid bars."""
    on = F.coalesce(cond, F.lit(False)) & F.coalesce(c(valid), F.lit(False))
    step = df.withColumns({"__on": on, "__rn": F.row_number().over(bars.spec)})
    out = step.withColumn(name, F.col("__rn") - F.coalesce(F.last(F.when(~F.col("__on"), F.col("__rn")), True).over(bars.run), F.lit(0)))
    return out.drop("__on", "__rn")


def with_first_n(df, n: int, valid: str, prefix: str, high="high", low="low", open_="open", close="close", bars: Bars = SEG):
    """Range and drive of the first n bars, known from bar n on, if all of them are valid."""
    step = df.withColumn("__rn", F.row_number().over(bars.spec))
    early = F.col("__rn") <= n
    whole = bars.whole
    step = step.withColumns(
        {
            "__ok": F.sum(F.when(early, F.coalesce(c(valid), F.lit(False)).cast("int"))).over(whole) == n,
            "__hi": F.max(F.when(early, c(high))).over(whole),
            "__lo": F.min(F.when(early, c(low))).over(whole),
            "__op": F.max(F.when(F.col("__rn") == 1, c(open_))).over(whole),
            "__cl": F.max(F.when(F.col("__rn") == n, c(close))).over(whole),
        }
    )
    ready = F.coalesce(F.col("__ok") & (F.col("__rn") >= n), F.lit(False))
    out = {f"{prefix}_ready": ready}
    out |= {f"{prefix}_{k}": F.when(ready, F.col(f"__{v}")) for k, v in (("high", "hi"), ("low", "lo"), ("open", "op"), ("close", "cl"))}
    return step.withColumns(out).drop("__rn", "__ok", "__hi", "__lo", "__op", "__cl")


def with_prior_segment(df, prefix: str = "prior"):
    """High, low, close and range of the market's segment before this one, from all of its rows."""
    stats = df.groupBy("market", "session_segment_id").agg(
        F.min("ts").alias("__first"),
        F.max("high").alias("__h"),
        F.min("low").alias("__l"),
        F.max_by("close", F.when(F.col("close").isNotNull(), F.col("ts"))).alias("__c"),
    )
    by = Window.partitionBy("market").orderBy("__first")
    prior = stats.select("market", "session_segment_id", *[F.lag(x).over(by).alias(f"{prefix}_{n}") for n, x in (("high", "__h"), ("low", "__l"), ("close", "__c"))])
    prior = prior.withColumn(f"{prefix}_range", F.col(f"{prefix}_high") - F.col(f"{prefix}_low"))
    return df.join(prior, ["market", "session_segment_id"], "left")


def with_shock_state(df, shock: str, valid: str, prev_close: str = "prev_close", tr: str = "tr", bars: Bars = SEG):
    """After a shock, until an invalid bar: retrace and continuation over the shock's move, and range decay."""
    on = F.coalesce(c(shock), F.lit(False)) & F.coalesce(c(valid), F.lit(False))
    step = df.withColumns({"__on": on, "__run": F.sum((~F.coalesce(c(valid), F.lit(False))).cast("int")).over(bars.run), "__shock": F.sum(on.cast("int")).over(bars.run)})
    isle = Window.partitionBy("market", "session_segment_id", "__run", "__shock").orderBy("ts")
    begun = F.first("__on").over(isle.rowsBetween(START, Window.unboundedFollowing))
    # an island that an invalid row cut off starts with no shock of its own
    take = lambda x: F.first(x).over(isle.rowsBetween(START, 0))
    step = step.withColumns(
        {
            "__in": begun & F.coalesce(c(valid), F.lit(False)),
            "__sc": take("close"), "__sh": take("high"), "__sl": take("low"), "__st": take(tr),
            "__sd": take(F.signum(F.col("close") - F.col(prev_close))),
            "__decay": F.avg(tr).over(isle.rowsBetween(-4, 0)),
        }
    )
    live, up = F.col("__in"), F.col("__sd") > 0
    pick = lambda a, b: F.when(up, a).otherwise(b)
    denom = shock_denominator(pick(F.col("__sc") - F.col("__sl"), F.col("__sh") - F.col("__sc")), F.col("__st"))
    back = F.greatest(F.lit(0.0), (F.col("__sc") - F.col("close")) * F.col("__sd"))
    further = F.greatest(F.lit(0.0), pick(F.col("high") - F.col("__sh"), F.col("__sl") - F.col("low")))
    moved = live & (F.col("__sd") != 0) & (F.abs(denom) > 1e-12)
    return step.withColumns(
        {
            "post_shock_retrace_pct": F.when(moved, back / denom),
            "post_shock_continuation_pct": F.when(moved, further / denom),
            "post_shock_range_decay": F.when(live & (F.col("__sd") != 0) & (F.col("__st") > 1e-12), F.col("__decay") / F.col("__st")),
        }
    ).drop("__on", "__run", "__shock", "__in", "__sc", "__sh", "__sl", "__st", "__sd", "__decay")


def true_range(prev_close: Column | str, h="high", l="low") -> Column:  # noqa: E741
    h, l, p = c(h), c(l), c(prev_close)  # noqa: E741
    return F.greatest(h - l, F.abs(h - p), F.abs(l - p))
