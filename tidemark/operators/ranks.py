"""Ranks, deciles, quantiles and rank correlation over whole tables, in range partitions.

A column's order is cut at approximate quantiles (an array of bounded size); each range is ordered by itself and counts of
the ranges before are added (``blocks.carried``), so results are exact and no task holds more than a range. A value that fills
ranges by itself is one of the cuts: it gets a range of its own, which is cut once more by the column that breaks ties.
Values are counted before they are ordered where only values matter, so any number of equal ones is one row.

Cuts depend on the order in which partial estimates arrive, so another evaluation may give other cuts: what is cut is written
once before it is read twice.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.blocks import carried, numbered
from tidemark.sources.staging import stage

#: Ranges of an order, and how finely their cuts are estimated.
RANGES, ACCURACY = 64, 2000
#: Values of a group, over all columns, that a task may hold to find quantiles.
SMALL = 1 << 16


def _cuts(x: Column) -> Column:
    return F.array_sort(F.array_distinct(F.percentile_approx(x, F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)]), F.lit(ACCURACY))))


def _range(x: Column, cuts: Column) -> Column:
    """2i for values between two cuts, 2i + 1 for those that equal the upper one."""
    below = F.size(F.filter(cuts, lambda e: e < x))
    return below * 2 + F.coalesce(F.array_contains(cuts, x), F.lit(False)).cast("int")


def ranged(df: DataFrame, x: str, tie: str) -> DataFrame:
    """``df`` with _range, which rises with (``x``, ``tie``)."""
    as_number = F.col(tie) if dict(df.dtypes)[tie] not in ("timestamp", "timestamp_ntz", "date") else F.unix_micros(F.col(tie).cast("timestamp"))
    # one row of two bounded arrays
    cuts = df.agg(_cuts(F.col(x)).alias("_cx"), _cuts(as_number).alias("_ct"))
    own = _range(F.col(x), F.col("_cx"))
    bucket = own * (2 * RANGES + 1) + F.when(own % 2 == 1, _range(as_number, F.col("_ct"))).otherwise(0)
    return stage(df.join(F.broadcast(cuts), F.lit(True)).withColumn("_range", bucket).drop("_cx", "_ct"), "ranged")


def ordered(df: DataFrame, x: str, tie: str, name: str = "_rn") -> DataFrame:
    """Rows numbered from 1 by ``x``, then ``tie``, both without nulls; ``tie`` is a number or a time."""
    return numbered(ranged(df, x, tie), (), (x, tie), F.col("_range"), name).drop("_range")


def with_decile(df: DataFrame, x: str, name: str, tie: str) -> DataFrame:
    """d01 to d10 by rank over the whole table, ties in the order of ``tie``; ``missing`` for NULL."""
    known = ordered(df.where(F.col(x).isNotNull()), x, tie)
    n = df.agg(F.count(x).alias("_n"))
    rank = F.ceil(F.col("_rn") * 10.0 / F.col("_n"))
    label = F.concat(F.lit("d"), F.lpad(F.greatest(F.lit(1), F.least(F.lit(10), rank)).cast("int").cast("string"), 2, "0"))
    known = known.join(F.broadcast(n), F.lit(True)).withColumn(name, label).drop("_rn", "_n")
    return known.unionByName(df.where(F.col(x).isNull()).withColumn(name, F.lit("missing")))


def _long(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    return df.select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_x")) for c in columns]))).where(F.col("_x").isNotNull())


def _counted(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by, _column, _x, _n, _upto): each distinct value of each column with its rows and those up to it."""
    keys = [*by, "_column"]
    counts = stage(_long(df, columns, by).groupBy(*keys, "_x").agg(F.count("*").alias("_n")), "counted")
    edges = stage(counts.groupBy(*keys).agg(_cuts(F.col("_x")).alias("_cuts")), "cuts")
    rows = counts.join(edges, keys).withColumn("_range", _range(F.col("_x"), F.col("_cuts"))).drop("_cuts")
    return carried(rows, {"_upto": ("sum", F.col("_n"))}, keys, ("_x",), F.col("_range")).drop("_range")


def _quantiles_of_small(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    at = F.array(*[F.lit(float(p)) for p in probs])
    found = df.groupBy(*by).agg(*[F.percentile(F.col(c).cast("double"), at).alias(f"_q{i}") for i, c in enumerate(columns)])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_q{i}").alias("q")) for i, c in enumerate(columns)])
    return found.select(*by, F.inline(each)).where(F.col("q").isNotNull())


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, column, q): exact quantiles of each column, an array in the order of ``probs``, interpolated as ``percentile`` does.

    Columns without a value in a group have no row. The columns of ``by`` hold no nulls. Groups of at most ``SMALL`` values go to a task
    each. If one is larger, rows are counted by range, and only the values of the ranges that hold a quantile are shuffled and ordered.
    ``df`` is read up to four times: what is costly should be staged.
    """
    # one number: the rows of the largest group
    most = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if (most or 0) * len(columns) <= SMALL:
        return _quantiles_of_small(df, columns, probs, by)
    keys = [*by, "_column"]
    long = _long(df, columns, by)
    edges = stage(long.groupBy(*keys).agg(_cuts(F.col("_x")).alias("_cuts")), "cuts")
    rows = long.join(edges, keys).withColumn("_range", _range(F.col("_x"), F.col("_cuts"))).drop("_cuts")
    all_, so_far = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    sizes = rows.groupBy(*keys, "_range").agg(F.count("*").alias("_size"))
    sizes = sizes.withColumns({"_before": F.sum("_size").over(so_far) - F.col("_size"), "_total": F.sum("_size").over(all_)})
    at = [F.lit(float(p)) * (F.col("_total") - 1) for p in probs]
    places = {f"_{side}{i}": k for i, x in enumerate(at) for side, k in (("lo", F.floor(x)), ("hi", F.ceil(x)))}
    inside = [(F.col("_before") <= k) & (k < F.col("_before") + F.col("_size")) for k in places.values()]
    wanted = sizes.where(reduce(lambda a, b: a | b, inside)).drop("_size")
    values = rows.join(wanted, [*keys, "_range"]).groupBy(*keys, "_range", "_x").agg(F.count("*").alias("_n"), F.first("_before").alias("_before"), F.first("_total").alias("_total"))
    run = Window.partitionBy(*keys, "_range").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    values = values.withColumn("_upto", F.col("_before") + F.sum("_n").over(run))
    picks = [F.max(F.when((F.col("_upto") - F.col("_n") <= k) & (k < F.col("_upto")), F.col("_x"))).alias(name) for name, k in places.items()]
    found = values.groupBy(*keys).agg(F.max("_total").alias("_total"), *picks)
    share = lambda x: x - F.floor(x)
    q = [F.when(F.col(f"_lo{i}") == F.col(f"_hi{i}"), F.col(f"_lo{i}")).otherwise((1 - share(x)) * F.col(f"_lo{i}") + share(x) * F.col(f"_hi{i}")) for i, x in enumerate(at)]
    return found.select(*by, F.col("_column").alias("column"), F.array(*q).alias("q"))


def with_qcut(df: DataFrame, x: str, parts: int, name: str) -> DataFrame:
    """Right-closed quantile buckets of the whole table, from 1; equal edges fall together."""
    df = stage(df, "qcut")
    edges = quantiles(df, [x], [i / parts for i in range(1, parts)]).select(F.col("q").alias("_edges"))
    # one row of parts - 1 numbers, or none
    rows = df.join(F.broadcast(edges), F.lit(True), "left")
    above = F.size(F.filter(F.array_distinct("_edges"), lambda e: F.col(x) > e))
    return rows.withColumn(name, F.when(F.col(x).isNotNull(), above + 1).cast("int")).drop("_edges")


def average_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, x, rank): each distinct value of each column with its rank over the table from 1, ties sharing their mean."""
    rank = F.col("_upto") - (F.col("_n") - 1) / 2
    return _counted(df, columns, ()).select(F.col("_column").alias("column"), F.col("_x").alias("x"), rank.alias("rank"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, rho): rank correlation of the rows where both are known; NULL where either is constant."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"))
    ranks = average_ranks(both, ["_a", "_b"])
    # pairs are counted first: any number of equal rows is one
    pairs = both.groupBy("_a", "_b").agg(F.count("*").alias("_n"))
    for c, r in (("_a", "_ra"), ("_b", "_rb")):
        pairs = pairs.join(ranks.where(F.col("column") == c).select(F.col("x").alias(c), F.col("rank").alias(r)), c)
    n = F.sum("_n")
    mean = (n + 1) / 2  # of ranks
    centred = pairs.agg(n.alias("n"), mean.alias("m"), F.sum(F.col("_n") * F.col("_ra") * F.col("_rb")).alias("ab"), F.sum(F.col("_n") * F.col("_ra") ** 2).alias("aa"), F.sum(F.col("_n") * F.col("_rb") ** 2).alias("bb"))
    less = lambda c: F.col(c) - F.col("n") * F.col("m") * F.col("m")
    return centred.select(F.coalesce("n", F.lit(0)).alias("n"), F.when((less("aa") > 1e-9) & (less("bb") > 1e-9), less("ab") / F.sqrt(less("aa") * less("bb"))).alias("rho"))
