"""Screens over many feature columns at once: correlations, missing values, shifts between all and traded rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.staging import stage


def correlations(df: DataFrame, columns: Sequence[str], least: float | None = None) -> DataFrame:
    """Pearson correlation of every pair (feature_a before feature_b in ``columns``) over the rows where both have values.

    One pass: each task keeps five matrices of sums over its rows, centred by the column means, and they are added up by
    cell. NULL where a pair has under two rows or a side is constant among them; ``least`` keeps pairs at or above it in size.
    """
    d = len(columns)
    # read twice, and costly to make
    df = stage(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), "screened")
    means = df.agg(*[F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    centre = np.array([means[f"m{i}"] for i in range(d)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sx, sxx, sxy = (np.zeros((d, d)) for _ in range(4))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(d)]) - centre
            v = np.isfinite(x)
            x = np.where(v, x, 0.0)
            v = v.astype(float)
            n += v.T @ v
            sx += x.T @ v
            sxx += (x * x).T @ v
            sxy += x.T @ x
        a, b = np.triu_indices(d, 1)
        sums = {"n": n[a, b], "sa": sx[a, b], "sb": sx[b, a], "saa": sxx[a, b], "sbb": sxx[b, a], "sab": sxy[a, b]}
        yield pa.record_batch({"a": a.astype(np.int32), "b": b.astype(np.int32), **sums})

    names = ["n", "sa", "sb", "saa", "sbb", "sab"]
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    sums = rows.mapInArrow(run, "a int, b int, " + ", ".join(f"{x} double" for x in names)).groupBy("a", "b").agg(*[F.sum(x).alias(x) for x in names])
    va = F.col("saa") - F.col("sa") * F.col("sa") / F.col("n")
    vb = F.col("sbb") - F.col("sb") * F.col("sb") / F.col("n")
    flat = lambda v, s: v <= 1e-12 * F.greatest(F.col(s), F.lit(1e-300))
    r = F.when((F.col("n") >= 2) & ~flat(va, "saa") & ~flat(vb, "sbb"), (F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")) / F.sqrt(va * vb))
    label = F.array(*[F.lit(c) for c in columns])
    out = sums.where("n > 0").select(label[F.col("a")].alias("feature_a"), label[F.col("b")].alias("feature_b"), F.col("n").cast("long").alias("n"), r.alias("corr"))
    return out if least is None else out.where(F.abs("corr") >= least)


def _long(df: DataFrame, keep: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.select(*keep, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).unpivot(list(keep), [f"`{c}`" for c in columns], "feature", "x")


def null_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values of each column, and whether it has none at all."""
    # one row of counts, laid out by column afterwards: no row is copied for each column
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"_k{i}") for i, c in enumerate(columns)]).where("n > 0")
    g = counts.select("n", F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), (F.col("n") - F.col(f"_k{i}")).alias("nulls")) for i, c in enumerate(columns)])))
    return g.select("feature", "n", "nulls", (F.col("nulls") / F.col("n")).alias("rate"), (F.col("nulls") == F.col("n")).alias("unavailable"))


def feature_shift(df: DataFrame, columns: Sequence[str], far: float = 5.0) -> DataFrame:
    """How traded rows (``traded``) differ from all rows: missing rates, means, deviations, rates of abs(z) above ``far``.

    z is by the mean and population deviation of all rows; without a deviation, shift and rates are NULL.
    """
    rows = _long(stage(df.select("traded", *columns), "shifted"), ["traded"], columns)  # read twice
    t = F.when(F.col("traded"), F.col("x"))
    missing = F.col("x").isNull().cast("int")
    g = rows.groupBy("feature").agg(
        F.count("*").alias("n"),
        F.count_if("traded").alias("n_traded"),
        F.avg(missing).alias("missing"),
        F.avg(F.when(F.col("traded"), missing)).alias("missing_traded"),
        F.avg("x").alias("mean"),
        F.avg(t).alias("mean_traded"),
        F.stddev_pop("x").alias("std"),
        F.stddev_pop(t).alias("std_traded"),
    )
    spread = F.when(F.col("std") > 1e-12, F.col("std"))
    g = g.withColumns({"missing_delta": F.col("missing_traded") - F.col("missing"), "shift": F.abs(F.col("mean_traded") - F.col("mean")) / spread})
    z = F.coalesce(F.abs(F.col("x") - F.col("mean")) / spread > far, F.lit(False)).cast("double")
    far_ = rows.join(F.broadcast(g.select("feature", "mean", "std")), "feature").groupBy("feature").agg(
        F.avg(F.when(F.col("std") > 1e-12, z)).alias("far_rate"), F.avg(F.when(F.col("traded") & (F.col("std") > 1e-12), z)).alias("far_rate_traded")
    )
    return g.join(far_, "feature")
