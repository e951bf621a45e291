"""Coarser candles from finer ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import SERIES, floor_to


def _candle(by: str) -> list[Column]:
    return [F.min_by("open", by).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", by).alias("close"), F.sum("volume").alias("volume")]


def by_time(candles: DataFrame, width_ms: int, complete_of: int | None = None, interval_ms: int | None = None) -> DataFrame:
    """Candles of `width_ms`. With `complete_of`, only buckets that hold exactly so many bars, spaced by `interval_ms`."""
    out = candles.groupBy(*SERIES, floor_to(F.col("open_time"), width_ms).alias("bucket")).agg(*_candle("open_time"), F.count("*").alias("bars"), F.min("open_time").alias("first_open"), F.max("open_time").alias("last_open"))
    if complete_of is not None:
        out = out.where((F.col("bars") == complete_of) & (F.col("last_open") - F.col("first_open") == (complete_of - 1) * interval_ms))
    return out.select(*SERIES, F.col("bucket").alias("open_time"), "open", "high", "low", "close", "volume", "bars")


def by_count(candles: DataFrame, bars: int) -> DataFrame:
    """Candles of `bars` bars in a row from the start of each series; the last one may hold fewer."""
    out = candles.groupBy(*SERIES, F.expr(f"bar_index div {bars}").alias("group_index")).agg(*_candle("bar_index"), F.min("open_time").alias("open_time"), F.count("*").alias("bars"))
    return out.select(*SERIES, "group_index", "open_time", "open", "high", "low", "close", "volume", "bars")


def actual_and_projected(actual: DataFrame, projected: DataFrame, width_ms: int) -> DataFrame:
    """Display candles of both; a bucket that has bars of both kinds is a transition."""
    both = actual.withColumn("_projected", F.lit(False)).unionByName(projected.select(*actual.columns).withColumn("_projected", F.lit(True)))
    out = both.groupBy(*SERIES, floor_to(F.col("open_time"), width_ms).alias("bucket")).agg(*_candle("open_time"), F.count("*").alias("bars"), F.bool_or("_projected").alias("any"), F.bool_and("_projected").alias("all"))
    phase = F.when(F.col("all"), "projected").when(F.col("any"), "transition").otherwise("actual")
    return out.select(*SERIES, F.col("bucket").alias("open_time"), phase.alias("phase"), "open", "high", "low", "close", "bars")
