"""Heavier loads for the bench: windows over all order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.windows import MARKET, SEG
from tidemark.sources.bars import line_bars


def rolling(spark, sf_dir):
    """Thirty rolling aggregates, one exchange and one sort."""
    aggs = (F.avg, F.stddev_pop, F.max, F.min, F.count, F.sum)
    return line_bars(spark, sf_dir).select("market", "bar", *[SEG.full("close", n, a).alias(f"a{n}_{i}") for n in (5, 15, 30, 60, 120) for i, a in enumerate(aggs)])


def leads(spark, sf_dir):
    """Thirty-one forward columns."""
    return line_bars(spark, sf_dir).select("market", "bar", *[MARKET.lead("close", k).alias(f"l{k}") for k in range(1, 32)])


LOADS = {"line_rolling_30": rolling, "line_leads_31": leads}
