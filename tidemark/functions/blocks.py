"""Functions over a whole market's bars without a window over a whole market.

Two levels. What runs from a market's first bar on (``carried``) is worked out within blocks of the order, a day by
default; each block leaves one row of totals, and what the blocks before (or behind) hold is joined back. What looks a
bounded number of bars back or ahead (``over_blocks``) runs in blocks of ``SIZE`` numbered bars, each with a halo of copies
of its neighbours' nearest bars. So a task holds a day or a block, whatever a market's share of all bars is; only totals,
one row a day, are ordered by market. The columns of ``by`` hold no nulls.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.windows import START, Bars

#: Bars in a block; its halo is copied, so it should be small beside it.
SIZE = 8192


def day(df: DataFrame, column: str) -> Column:
    """What cuts an order into blocks: the date of a time, ranges of ``SIZE`` of a number."""
    return F.floor(F.col(column) / SIZE) if isinstance(df.schema[column].dataType, T.NumericType) else F.to_date(column)


def carried(df: DataFrame, columns: dict[str, tuple[str, Column]], by: Sequence[str] = ("market",), order: Sequence[str] = ("ts",), bucket: Column | None = None) -> DataFrame:
    """Add running columns, each by an operation over a column in the group's order.

    ``sum``, ``max``: of the rows so far. ``last``: the last value so far that is not NULL. ``next``: the first from this row on.
    ``lag``: the row before's, NULL for the first. ``bucket`` must rise with the order; by default it is ``day``.
    """
    df = df.withColumn("_bucket", day(df, order[0]) if bucket is None else bucket)
    inner = Window.partitionBy(*by, "_bucket").orderBy(*order)
    so_far, across = inner.rowsBetween(START, 0), Window.partitionBy(*by).orderBy("_bucket")
    before = across.rowsBetween(START, -1)
    # from the end backwards: a frame that ends with the partition is gone through anew for each row
    from_here = Window.partitionBy(*by, "_bucket").orderBy(*[F.desc(o) for o in order]).rowsBetween(START, 0)
    behind = Window.partitionBy(*by).orderBy(F.desc("_bucket")).rowsBetween(START, -1)
    at = F.struct(*order)
    own: dict[str, Column] = {}
    totals: list[Column] = []
    brought: dict[str, Column] = {}
    joined: dict[str, Column] = {}
    for i, (name, (how, x)) in enumerate(columns.items()):
        mine, total, carry = f"_own{i}", f"_total{i}", f"_carry{i}"
        if how == "sum":
            own[mine], tot, brought[carry] = F.sum(x).over(so_far), F.sum(x), F.sum(total).over(before)
            joined[name] = F.when(F.col(mine).isNull() & F.col(carry).isNull(), None).otherwise(F.coalesce(mine, F.lit(0)) + F.coalesce(carry, F.lit(0)))
        elif how == "max":
            own[mine], tot, brought[carry] = F.max(x).over(so_far), F.max(x), F.max(total).over(before)
            joined[name] = F.greatest(mine, carry)
        elif how == "last":
            own[mine], tot, brought[carry] = F.last(x, True).over(so_far), F.max_by(x, F.when(x.isNotNull(), at)), F.last(total, True).over(before)
            joined[name] = F.coalesce(mine, carry)
        elif how == "next":
            own[mine], tot, brought[carry] = F.last(x, True).over(from_here), F.min_by(x, F.when(x.isNotNull(), at)), F.last(total, True).over(behind)
            joined[name] = F.coalesce(mine, carry)
        elif how == "lag":
            own[mine], tot, brought[carry] = F.lag(x).over(inner), F.max_by(x, at), F.lag(total).over(across)
            joined[name] = F.when(F.col("_nth") == 1, F.col(carry)).otherwise(F.col(mine))
            own["_nth"] = F.row_number().over(inner)
        else:
            raise ValueError(how)
        totals.append(tot.alias(total))
    sums = df.groupBy(*by, "_bucket").agg(*totals).withColumns(brought).drop(*[f"_total{i}" for i in range(len(totals))])
    out = df.withColumns(own).join(sums, [*by, "_bucket"], "left").withColumns(joined)
    return out.select(*[c for c in df.columns if c != "_bucket" and c not in columns], *columns)


def numbered(df: DataFrame, by: Sequence[str] = ("market",), order: Sequence[str] = ("ts",), bucket: Column | None = None, name: str = "_rn") -> DataFrame:
    """Number the rows of each group from 1 in its order."""
    return carried(df, {name: ("sum", F.lit(1).cast("long"))}, by, order, bucket)


def over_blocks(df: DataFrame, add: Callable[[DataFrame, Bars], DataFrame], back: int, ahead: int, by: Sequence[str] = ("market",), order: Sequence[str] = ("ts",), bucket: Column | None = None, size: int = SIZE) -> DataFrame:
    """What ``add`` makes of blocks of bars, each with ``back`` bars before it and ``ahead`` behind it.

    ``add`` gets the rows and the window helpers to use; what it says of the halo's bars is dropped.
    """
    if max(back, ahead) > size:
        raise ValueError("a halo must not be wider than a block")
    rows = numbered(df, by, order, bucket)
    place = (F.col("_rn") - 1) % size
    rows = rows.withColumn("_block", F.floor((F.col("_rn") - 1) / size))
    near = F.array(F.lit(0), F.when(place >= size - back, 1), F.when((place < ahead) & (F.col("_block") > 0), -1))
    rows = rows.withColumn("_to", F.explode(F.array_compact(near))).withColumn("_block", F.col("_block") + F.col("_to"))
    out = add(rows, Bars((*by, "_block"), "_rn"))
    return out.where(F.col("_to") == 0).drop("_rn", "_block", "_to")
