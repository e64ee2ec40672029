"""Scalar expressions. Missing values are SQL NULL throughout; NaN never leaves a scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def quantize(x: Column | str, scale: float = 1e6) -> Column:
    """A whole number that engines agree on: ties of decimal rounding never arise."""
    return F.floor(c(x).cast("double") * scale + 0.500123).cast("long")


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a / b where b is not about zero, else NULL."""
    return F.when(F.abs(c(b)) > TINY, c(a) / c(b))


def sign(x: Column | str) -> Column:
    return F.signum(c(x).cast("double")).cast("int")


def clip(x: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Bounds that leave NULL alone, which greatest and least would not."""
    out = c(x)
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c(x).isNotNull(), out)


def finite(x: Column | str) -> Column:
    """The number, NULL for NaN and infinities."""
    v = c(x).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def valid_price(x: Column | str) -> Column:
    return F.coalesce(finite(x) > 0, F.lit(False))


def valid_ohlcv(o="open", h="high", l="low", cl="close", v="volume") -> Column:  # noqa: E741
    """Complete, and high and low enclose the rest."""
    o, h, l, cl, v = map(c, (o, h, l, cl, v))  # noqa: E741
    return F.coalesce((h >= l) & (l <= o) & (o <= h) & (l <= cl) & (cl <= h) & (v >= 0), F.lit(False))


def bad_ohlc(o="open", h="high", l="low", cl="close") -> Column:  # noqa: E741
    """The ingest rule: a missing price is bad as well."""
    o, h, l, cl = map(c, (o, h, l, cl))  # noqa: E741
    some = o.isNull() | h.isNull() | l.isNull() | cl.isNull()
    return some | F.coalesce((h < F.greatest(o, cl)) | (l > F.least(o, cl)), F.lit(True))


def blank(x: Column | str) -> Column:
    return F.trim(F.coalesce(c(x), F.lit(""))) == ""


def default(x: Column | str, value) -> Column:
    return F.coalesce(c(x), F.lit(value))


def number(x: Column | str) -> Column:
    """A number from text, NULL where it is none."""
    return finite(c(x).try_cast("double"))


def first_match(*cases: tuple[Column, str]) -> Column:
    return F.coalesce(*[F.when(cond, F.lit(name)) for cond, name in cases])


def last_match(start: str | int, *cases: tuple[Column, str | int]) -> Column:
    """Masked overwrites in order: the last case that holds wins."""
    out = F.lit(start)
    for cond, value in cases:
        out = F.when(F.coalesce(cond, F.lit(False)), F.lit(value)).otherwise(out)
    return out


def reasons(*cases: tuple[Column, str], sep: str = "|") -> Column:
    """All names whose condition holds, in order."""
    return F.concat_ws(sep, *[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for cond, name in cases])


def row_sum(*cols: Column | str) -> Column:
    """NULL unless all are there."""
    return reduce(lambda a, b: a + b, map(c, cols))


def row_std(*cols: Column | str) -> Column:
    """Sample deviation of the values that are there; NULL for fewer than two."""
    x = [c(v).cast("double") for v in cols]
    n = reduce(lambda a, b: a + b, [v.isNotNull().cast("int") for v in x])
    total = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in x])
    square = reduce(lambda a, b: a + b, [F.coalesce(F.pow(v - total / F.when(n > 0, n), 2), F.lit(0.0)) for v in x])
    return F.when(n > 1, F.sqrt(square / F.when(n > 1, n - 1)))


def argmax3(short: Column | str, flat: Column | str, long: Column | str) -> Column:
    """-1, 0 or 1 for the largest; ties go to the first in that order, NULL counts as least."""
    s, f, g = (F.coalesce(c(x), F.lit(float("-inf"))) for x in (short, flat, long))
    return F.when((s >= f) & (s >= g), -1).when(f >= g, 0).otherwise(1)


def cut(x: Column | str, edges: list[float], missing: str = "missing") -> Column:
    """Right-closed buckets by label: <=first, (a,b], >last."""
    v = c(x)
    out = F.when(v.isNull(), missing).when(v <= edges[0], f"<={edges[0]:g}")
    for a, b in zip(edges, edges[1:]):  # noqa: B905
        out = out.when(v <= b, f"({a:g},{b:g}]")
    return out.otherwise(f">{edges[-1]:g}")


def cut10(x: Column | str) -> Column:
    """Ten equal bins of [0, 1], right-closed, the lowest value in the first: 1 to 10."""
    v = clip(x, 0.0, 1.0)
    return F.when(v.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(10), F.ceil(v * 10))).cast("int"))


def shock_denominator(move: Column, true_range: Column) -> Column:
    """The directional move if it is at least a hundredth of the range, else the range."""
    return F.when(move >= F.greatest(F.lit(TINY), true_range * 0.01), move).otherwise(true_range)


def degraded(status: Column | str) -> Column:
    return ~F.lower(F.trim(F.coalesce(c(status), F.lit("")))).isin("available", "ok", "normal", "")


def pad_id(prefix: str, n: Column | str, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(c(n).cast("string"), width, "0"))


def minute_of_day(local: Column | str) -> Column:
    return F.hour(c(local)) * 60 + F.minute(c(local))


def local_time(ts: Column | str, zone: str = "America/Chicago") -> Column:
    """Wall time of a UTC timestamp without zone; independent of the session's zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), c(ts))


def utc_time(local: Column | str, zone: str = "America/Chicago") -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), c(local))


def session_date(local: Column | str, close_minute: int) -> Column:
    """Bars from the close on belong to the next day."""
    day = c(local).cast("date")
    return F.when(minute_of_day(local) < close_minute, day).otherwise(F.date_add(day, 1))


def minutes_between(a: Column | str, b: Column | str) -> Column:
    """Whole minutes from b to a, rounded down."""
    return F.floor(F.timestamp_diff("SECOND", c(b), c(a)) / 60).cast("long")
