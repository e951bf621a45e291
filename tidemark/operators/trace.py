"""What became of each signal: departure, fill, or neither within the follow-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import SERIES, ratio
from tidemark.operators.first_hit import Blocks, first_hits


def series_length(candles: DataFrame) -> DataFrame:
    return candles.groupBy(*SERIES).agg((F.max("bar_index") + 1).alias("series_bars"))


def _requests(signals: DataFrame, fill_bars: int, departure_bars: int) -> DataFrame:
    lower = F.col("direction_sign") == 1
    fill = F.struct(F.lit("fill").alias("what"), F.when(lower, "neg_low").otherwise("high").alias("track"), F.when(lower, -F.col("wick_target")).otherwise(F.col("wick_target")).alias("level"), F.lit(fill_bars).alias("bars"))
    leave = F.struct(F.lit("departure").alias("what"), F.when(lower, "close").otherwise("neg_close").alias("track"), F.when(lower, F.col("opposite_extreme")).otherwise(-F.col("opposite_extreme")).alias("level"), F.lit(departure_bars).alias("bars"))
    asked = signals.select("signal_id", *SERIES, "bar_index", F.explode(F.array(fill, leave)).alias("r"))
    return asked.select(F.struct("signal_id", "r.what").alias("rid"), *SERIES, F.col("bar_index").alias("after"), (F.col("bar_index") + F.col("r.bars")).alias("last"), "r.track", "r.level")


def first_fill_and_departure(signals: DataFrame, candles: DataFrame, fill_bars: int, departure_bars: int | None = None, blocks: Blocks | None = None) -> DataFrame:
    """signals with series_bars, first_fill and first_departure: bar numbers within their caps, or NULL. blocks: of the candles, if they are written."""
    hits = first_hits(_requests(signals, fill_bars, departure_bars or fill_bars), blocks or candles).select("rid.signal_id", "rid.what", "hit")
    wide = hits.groupBy("signal_id").agg(F.max(F.when(F.col("what") == "fill", F.col("hit"))).alias("first_fill"), F.max(F.when(F.col("what") == "departure", F.col("hit"))).alias("first_departure"))
    return signals.join(series_length(candles), list(SERIES)).join(wide, "signal_id", "left")


def status(follow_up: int) -> Column:
    """From first_fill, first_departure, bar_index and series_bars. A fill in the departure's bar is early; a series that ends first censors."""
    seen = F.col("bar_index") + follow_up < F.col("series_bars")
    fill, leave = F.col("first_fill"), F.col("first_departure")
    early = fill.isNotNull() & (leave.isNull() | (fill <= leave))
    open_ = F.when(leave.isNull(), F.when(seen, "no_departure").otherwise("right_censored")).otherwise(F.when(seen, "unfilled").otherwise("right_censored"))
    return F.when(early, "filled_before_departure").when(fill.isNotNull(), "filled").otherwise(open_)


def trace(signals: DataFrame, candles: DataFrame, follow_up: int, blocks: Blocks | None = None) -> DataFrame:
    """signals with status, departure_index and fill_index; both are NULL for early fills, the second unless filled.

    Two independent first hits are enough: a fill that comes after the first departure is the first fill after it.
    """
    found = first_fill_and_departure(signals, candles, follow_up, blocks=blocks).withColumn("status", status(follow_up))
    left = F.col("status") != "filled_before_departure"
    return found.select(
        *signals.columns, "series_bars", "status", F.when(left, F.col("first_departure")).alias("departure_index"),
        F.when(F.col("status") == "filled", F.col("first_fill")).alias("fill_index"),
    )


def trace_capped(signals: DataFrame, candles: DataFrame, departure_bars: int | None, fill_bars: int | None) -> DataFrame:
    """Separate caps: the departure within `departure_bars` of the signal, the fill within `fill_bars` of the departure, nothing early.

    None is no cap but the end of the series. status: filled_before_departure, no_departure, unfilled or filled.
    """
    if departure_bars is None or fill_bars is None:
        # no series is longer
        whole = (candles.agg(F.max("bar_index")).first()[0] or 0) + 1
        departure_bars, fill_bars = whole if departure_bars is None else departure_bars, whole if fill_bars is None else fill_bars
    found = first_fill_and_departure(signals, candles, departure_bars)
    early = F.col("first_fill").isNotNull() & (F.col("first_departure").isNull() | (F.col("first_fill") <= F.col("first_departure")))
    left = found.where(~early & F.col("first_departure").isNotNull()).withColumn("_from", F.col("first_departure"))
    lower = F.col("direction_sign") == 1
    again = left.select(F.col("signal_id").alias("rid"), *SERIES, F.col("_from").alias("after"), (F.col("_from") + fill_bars).alias("last"), F.when(lower, "neg_low").otherwise("high").alias("track"), F.when(lower, -F.col("wick_target")).otherwise(F.col("wick_target")).alias("level"))
    fills = first_hits(again, candles).withColumnRenamed("rid", "signal_id").withColumnRenamed("hit", "fill_index")
    what = F.when(early, "filled_before_departure").when(F.col("first_departure").isNull(), "no_departure").when(F.col("fill_index").isNull(), "unfilled").otherwise("filled")
    return found.join(fills, "signal_id", "left").select(*signals.columns, what.alias("status"), F.when(~early, F.col("first_departure")).alias("departure_index"), "fill_index")


def status_counts(traced: DataFrame) -> DataFrame:
    return traced.groupBy("status").agg(F.count("*").alias("signals"))


def open_signals(traced: DataFrame, candles: DataFrame, latest: int = 400, most: int = 80) -> DataFrame:
    """Of each series' latest signals those that have departed, are not filled and stand away from their target; newest first."""
    from pyspark.sql import Window

    newest = Window.partitionBy(*SERIES).orderBy(F.desc("open_time"), "signal_id")
    now = candles.groupBy(*SERIES).agg(F.max_by("close", "bar_index").alias("last_close"))
    live = traced.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= latest).drop("_n").join(now, list(SERIES))
    move = F.col("direction_sign") * (ratio(F.col("last_close"), F.col("wick_target")) - 1.0) * 100.0
    kept = live.where(F.col("departure_index").isNotNull() & F.col("fill_index").isNull()).withColumn("current_move_pct", move).where("current_move_pct > 0")
    return kept.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= most).select("signal_id", *SERIES, "direction", "status", "current_move_pct", F.col("_n").alias("newest_rank"))
