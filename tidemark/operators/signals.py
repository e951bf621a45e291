"""Candles with a tiny body and one dominant wick, and the context they stand in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import SERIES, iso_utc, overlapped, ratio

# Fixed names, in this order: stores and matchers know a signal's context by them.
FEATURES = (
    "body_pct_of_range", "dominant_wick_pct_of_range", "opposite_wick_pct_of_range", "range_pct_of_close",
    "range_vs_prior_20_median", "volume_vs_prior_20_mean", "aligned_prior_1h_return_pct",
)


@dataclass(frozen=True)
class Shape:
    """Limits of a signal's shape, as fractions of its range; all inclusive."""

    body_most: float = 0.05
    dominant_least: float = 0.75
    opposite_most: float = 0.20


STRICT = Shape()
CONTEXT_BARS = 20


def shapes(candles: DataFrame) -> DataFrame:
    """candles with range and its parts; parts of an empty range are NULL."""
    size = F.col("high") - F.col("low")
    part = lambda x: F.when(size > 0, ratio(x, size))
    return candles.select(
        "*", size.alias("range"), part(F.abs(F.col("close") - F.col("open"))).alias("body_pct_of_range"),
        part(F.least("open", "close") - F.col("low")).alias("lower_wick_pct_of_range"), part(F.col("high") - F.greatest("open", "close")).alias("upper_wick_pct_of_range"),
        F.when(size > 0, ratio(size, F.col("close")) * 100.0).alias("range_pct_of_close"),
    )


def with_context(candles: DataFrame, return_bars: int) -> DataFrame:
    """candles with shapes and what came before each: CONTEXT_BARS whole bars, the bar itself left out, and a return over `return_bars`."""
    series = Window.partitionBy(*SERIES, "_block").orderBy("bar_index")
    prior = series.rowsBetween(-CONTEXT_BARS, -1)
    # the window only gathers: the median is taken of rows that a filter on the shape has left
    earlier = [F.lag("range", k).over(series) for k in range(1, CONTEXT_BARS + 1)]
    found = shapes(overlapped(candles, max(CONTEXT_BARS, return_bars))).select(
        "*", F.array(*earlier).alias("_ranges"), F.avg("volume").over(prior).alias("_volume"), F.lag("close", return_bars).over(series).alias("_close"),
    )
    ordered, half = F.array_sort("_ranges"), CONTEXT_BARS // 2
    middle = (ordered[half - 1] + ordered[half]) / 2
    whole = F.col("_ranges")[CONTEXT_BARS - 1].isNotNull()
    return found.where("_own").select(
        *candles.columns, "range", "body_pct_of_range", "lower_wick_pct_of_range", "upper_wick_pct_of_range", "range_pct_of_close",
        ratio(F.col("range"), F.when(whole, middle)).alias("range_vs_prior_20_median"), ratio(F.col("volume"), F.when(whole, F.col("_volume"))).alias("volume_vs_prior_20_mean"),
        ((ratio(F.col("close"), F.col("_close")) - 1.0) * 100.0).alias("prior_1h_return_pct"),
    )


def sign_of(shape: Shape = STRICT) -> Column:
    """1 for a lower wick, -1 for an upper wick, 0 for neither; a candle that is both is a lower one."""
    small = (F.col("range") > 0) & (F.col("body_pct_of_range") <= shape.body_most)
    wick = lambda main, other: small & (F.col(f"{main}_wick_pct_of_range") >= shape.dominant_least) & (F.col(f"{other}_wick_pct_of_range") <= shape.opposite_most)
    return F.when(wick("lower", "upper"), 1).when(wick("upper", "lower"), -1).otherwise(0)


def detect(candles: DataFrame, return_bars: int, shape: Shape = STRICT) -> DataFrame:
    """Signals: candles of the shape whose seven features all exist, with target and opposite extreme."""
    found = with_context(candles, return_bars).withColumn("direction_sign", sign_of(shape)).where("direction_sign <> 0")
    lower = F.col("direction_sign") == 1
    pick = lambda a, b: F.when(lower, F.col(a)).otherwise(F.col(b))
    out = found.select(
        F.concat_ws("_", "asset", "timeframe", F.when(lower, "lower_wick").otherwise("upper_wick"), F.col("open_time").cast("string")).alias("signal_id"),
        *SERIES, "interval_minutes", "bar_index", "open_time", iso_utc(F.col("open_time")).alias("signal_open_time_utc"), F.when(lower, "lower_wick").otherwise("upper_wick").alias("direction"), "direction_sign",
        "open", "high", "low", "close", "volume", pick("low", "high").alias("wick_target"), pick("high", "low").alias("opposite_extreme"),
        "body_pct_of_range", pick("lower_wick_pct_of_range", "upper_wick_pct_of_range").alias("dominant_wick_pct_of_range"), pick("upper_wick_pct_of_range", "lower_wick_pct_of_range").alias("opposite_wick_pct_of_range"),
        "range_pct_of_close", "range_vs_prior_20_median", "volume_vs_prior_20_mean", (F.col("direction_sign") * F.col("prior_1h_return_pct")).alias("aligned_prior_1h_return_pct"),
    )
    return out.dropna(subset=list(FEATURES))


def pinned_shape(candles: DataFrame) -> DataFrame:
    """Every candle read as a signal without limits: the longer wick gives the direction."""
    lower = F.col("lower_wick_pct_of_range") >= F.col("upper_wick_pct_of_range")
    return shapes(candles).where("range > 0").select(
        *SERIES, "bar_index", "open_time", F.when(lower, "lower_wick").otherwise("upper_wick").alias("direction"), (F.col("body_pct_of_range") * 100).alias("body_pct"),
        (F.greatest("lower_wick_pct_of_range", "upper_wick_pct_of_range") * 100).alias("dominant_pct"), (F.least("lower_wick_pct_of_range", "upper_wick_pct_of_range") * 100).alias("opposite_pct"),
    )
