"""Joins: as-of, null-safe, range, lookup, semi and anti."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedupe_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by ``order``."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return df.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the latest right row of its key at or before it; NULL before the first.

    One shuffle: both sides are unioned, sorted once by key and time with right rows first, and the last right row is
    carried forward. Right keys must be unique in (by, right_on).
    """
    names = left.columns
    a = left.select(*names, F.col(left_on).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(f"struct<{','.join(f'{f.name}:{f.dataType.simpleString()}' for f in right.select(*values).schema)}>").alias("_v"))
    b = right.select(*by, F.col(right_on).alias("_t"), F.lit(0).alias("_side"), F.struct(*values).alias("_v"))
    w = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_v", F.last("_v", True).over(w))
    return both.where("_side = 1").select(*names, *[F.col(f"_v.{v}").alias(v) for v in values])


def nullsafe_left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which NULL keys match each other."""
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = reduce(lambda x, y: x & y, [left[k].eqNullSafe(r[f"_r_{k}"]) for k in keys])
    return left.join(r, cond, "left").drop(*[f"_r_{k}" for k in keys])


def lookup(df: DataFrame, small: DataFrame, key: str, most: int = 100_000) -> DataFrame:
    """Left join with a table of settings; it is broadcast only if it has at most ``most`` rows."""
    return df.join(F.broadcast(small) if small.limit(most + 1).count() <= most else small, key, "left")


def range_join(rows: DataFrame, ranges: DataFrame, on: str, low: str, high: str, by: list[str], width: int) -> DataFrame:
    """Rows inside [low, high] of whole numbers, by key. Ranges are cut into cells of ``width``, so it is an equi-join."""
    cells = ranges.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return rows.withColumn("_cell", F.floor(F.col(on) / width)).join(cells, [*by, "_cell"]).where(F.col(on).between(F.col(low), F.col(high))).drop("_cell")


def with_nearest(windows: DataFrame, rows: DataFrame, by: list[str], start: str, end: str, on: str, value: str) -> DataFrame:
    """For each window the value of the last row before its start and of the first after its end: two as-of joins."""
    before = asof_backward(windows.withColumn("_s", F.col(start) - 1), rows.select(*by, on, F.col(value).alias("before")), by, "_s", on, ["before"]).drop("_s")
    flipped = rows.select(*by, (-F.col(on)).alias("_n"), F.col(value).alias("after"))
    return asof_backward(before.withColumn("_e", -F.col(end) - 1), flipped, by, "_e", "_n", ["after"]).drop("_e")


def full_key_grid(*parts: DataFrame) -> DataFrame:
    """Cross product of small settings tables."""
    return reduce(lambda a, b: a.crossJoin(b), parts)
