"""Completed routes: episodes, their candles in direction-normalised form, and the states that matching compares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import SERIES, mirrored_pct
from tidemark.operators.signals import FEATURES


def paths(traced: DataFrame, candles: DataFrame) -> DataFrame:
    """One row per filled signal and bar from signal to fill: phase and prices as signed percent from the target.

    The range of bars is written out and joined by bar number: an equi-join, whatever the lengths.
    """
    filled = traced.where(F.col("status") == "filled").select(F.col("signal_id").alias("episode_id"), *SERIES, "direction", "direction_sign", "wick_target", "bar_index", "departure_index", "fill_index")
    steps = filled.withColumn("i", F.explode(F.sequence("bar_index", "fill_index")))
    bars = candles.select(*SERIES, F.col("bar_index").alias("i"), "open_time", "open", "high", "low", "close", "volume")
    phase = F.when(F.col("i") == F.col("bar_index"), "signal").when(F.col("i") < F.col("departure_index"), "pre_departure").when(F.col("i") == F.col("departure_index"), "departure").when(F.col("i") < F.col("fill_index"), "return_path").otherwise("fill")
    pct = lambda c: mirrored_pct(F.col(c), F.col("wick_target"), F.col("direction_sign")).alias(f"normalized_{c}_pct")
    return steps.join(bars, [*SERIES, "i"]).select("episode_id", *SERIES, "direction", "direction_sign", "open_time", (F.col("i") - F.col("bar_index")).alias("offset_bars"), phase.alias("phase"), "open", "high", "low", "close", "volume", *map(pct, ("open", "high", "low", "close")))


def episodes(traced: DataFrame, candles: DataFrame) -> DataFrame:
    """One row per filled signal with its durations, largest move away and the bar that first made it."""
    away = F.when(F.col("direction_sign") == 1, F.col("normalized_high_pct")).otherwise(F.col("normalized_low_pct"))
    moves = paths(traced, candles).select("episode_id", "offset_bars", away.alias("away")).groupBy("episode_id").agg(F.max("away").alias("max_away_move_pct"), F.min_by("offset_bars", F.struct(-F.col("away"), "offset_bars")).alias("time_to_max_away_bars"))
    closes = candles.select(*SERIES, F.col("bar_index").alias("fill_index"), F.col("close_time").alias("fill_close_ms"))
    kept = traced.where(F.col("status") == "filled").withColumnRenamed("signal_id", "episode_id").join(closes, [*SERIES, "fill_index"]).join(moves, "episode_id")
    bars = lambda c: F.col(c) - F.col("bar_index")
    return kept.select(
        "episode_id", *SERIES, "interval_minutes", "direction", "direction_sign", F.col("open_time").alias("signal_open_ms"), (F.col("fill_close_ms") + 1).alias("fill_close_ms"), "wick_target",
        bars("departure_index").alias("signal_to_departure_bars"), bars("fill_index").alias("signal_to_fill_bars"), (bars("fill_index") * F.col("interval_minutes")).alias("signal_to_fill_minutes"),
        "max_away_move_pct", "time_to_max_away_bars", *FEATURES,
    )


def known_by(found: DataFrame, snapshot_ms: int) -> DataFrame:
    """Episodes whose fill had closed at the snapshot (inclusive): the only ones that it may look at."""
    return found.where(F.col("fill_close_ms") <= snapshot_ms)


def states(path_rows: DataFrame, found: DataFrame) -> DataFrame:
    """Per bar of a route: move, running peak, drawdown, what was left, the future peak, and whether it can be matched.

    A candidate lies after the departure, before the fill, on the far side of the target, with bars still to come.
    """
    known = found.select("episode_id", "signal_to_departure_bars", "signal_to_fill_bars")
    peak = F.when(F.col("direction_sign") == 1, F.col("normalized_high_pct")).otherwise(F.col("normalized_low_pct"))
    route = Window.partitionBy("episode_id").orderBy("offset_bars")
    rows = path_rows.join(known, "episode_id").where(F.col("offset_bars").between(0, F.col("signal_to_fill_bars"))).withColumn("peak_at_bar", peak)
    rows = rows.withColumn("peak_move_pct", F.max("peak_at_bar").over(route.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("future_peak_move_pct", F.max("peak_at_bar").over(route.rowsBetween(1, Window.unboundedFollowing)))
    move = F.col("normalized_close_pct")
    inner = (F.col("offset_bars") > 0) & (F.col("offset_bars") < F.col("signal_to_fill_bars")) & (F.col("offset_bars") >= F.col("signal_to_departure_bars"))
    return rows.select(
        "episode_id", *SERIES, "direction", "direction_sign", "offset_bars", move.alias("current_move_pct"), "peak_move_pct", F.greatest(F.col("peak_move_pct") - move, F.lit(0.0)).alias("drawdown_pct"),
        (F.col("signal_to_fill_bars") - F.col("offset_bars")).alias("remaining_bars"), "future_peak_move_pct", (inner & (move > 0) & F.col("future_peak_move_pct").isNotNull()).alias("candidate"),
    )


def observable_state(rows: DataFrame, assets: Sequence[str]) -> DataFrame:
    """Live states as a model reads them, one row each; a state that could not be observed is an error when it is read.

    rows: (asset, direction, elapsed_bars, current_move_pct, peak_move_pct, drawdown_pct, volume_ratio_to_signal, ..).
    Every number is finite, ages, drawdowns and volumes are not negative, and the price stands away from the target.
    """
    numbers = ("elapsed_bars", "current_move_pct", "peak_move_pct", "drawdown_pct", "volume_ratio_to_signal")
    value = lambda c: F.col(c).cast("double")
    wrong = F.when(~F.coalesce(F.col("asset").isin(*assets), F.lit(False)), "asset").when(~F.coalesce(F.col("direction").isin("upper_wick", "lower_wick"), F.lit(False)), "direction")
    for c in numbers:
        wrong = wrong.when(value(c).isNull() | F.isnan(value(c)) | (F.abs(value(c)) == float("inf")), c)
    wrong = wrong.when(value("elapsed_bars") < 0, "elapsed_bars").when(value("current_move_pct") <= 0, "current_move_pct").when(value("drawdown_pct") < 0, "drawdown_pct").when(value("volume_ratio_to_signal") < 0, "volume_ratio_to_signal")
    kept = rows.withColumn("_wrong", wrong).where(F.when(F.col("_wrong").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not an observable state: "), F.col("_wrong"))).cast("boolean")))
    return kept.select(
        F.log1p(value("elapsed_bars")).alias("elapsed_log_bars"), F.log1p(value("volume_ratio_to_signal")).alias("log_volume_ratio_to_signal"), *(value(c).alias(c) for c in ("current_move_pct", "peak_move_pct", "drawdown_pct")),
        *((F.col("asset") == a).cast("double").alias(f"asset_{a}") for a in assets), (F.col("direction") == "lower_wick").cast("double").alias("direction_is_lower"),
    )


# Fixed values of the grid: ages in bars up to which every bar and every fifth one is kept, and every fifteenth beyond.
EXACT_BARS, MIDDLE_BARS, MIDDLE_STEP, FAR_STEP = 240, 1440, 5, 15


def thinned(found: DataFrame, exact_bars: int = EXACT_BARS, middle_bars: int = MIDDLE_BARS, middle_step: int = MIDDLE_STEP, far_step: int = FAR_STEP) -> DataFrame:
    """Candidates on a grid that widens with age: every bar, then every middle_step-th, then every far_step-th."""
    off = F.col("offset_bars")
    return found.where(F.col("candidate") & ((off <= exact_bars) | ((off <= middle_bars) & (off % middle_step == 0)) | (off % far_step == 0)))


def snapshots(path_rows: DataFrame, found: DataFrame, offsets: Sequence[int]) -> DataFrame:
    """States at fixed ages, with short averages of range and of close changes over up to three bars."""
    last3 = Window.partitionBy("episode_id").orderBy("offset_bars").rowsBetween(-2, 0)
    order = Window.partitionBy("episode_id").orderBy("offset_bars")
    step = F.abs(F.col("normalized_close_pct") - F.coalesce(F.lag("normalized_close_pct").over(order), F.col("normalized_close_pct")))
    size = F.abs(F.col("normalized_high_pct") - F.col("normalized_low_pct"))
    recent = path_rows.select("episode_id", "offset_bars", step.alias("step"), size.alias("size")).select("episode_id", "offset_bars", F.avg("size").over(last3).alias("recent_range_pct"), F.avg("step").over(last3).alias("recent_change_pct"))
    return states(path_rows, found).where(F.col("candidate") & F.col("offset_bars").isin(*offsets)).join(recent, ["episode_id", "offset_bars"])


def live_state(candles: DataFrame, pinned: DataFrame) -> DataFrame:
    """State of pinned signals (signal_id, series, bar_index, now_index, direction_sign, wick_target) at now_index."""
    seen = pinned.withColumn("i", F.explode(F.sequence("bar_index", "now_index"))).join(candles.select(*SERIES, F.col("bar_index").alias("i"), "high", "low", "close"), [*SERIES, "i"])
    pct = lambda c: mirrored_pct(c, F.col("wick_target"), F.col("direction_sign"))
    far = F.when(F.col("direction_sign") == 1, F.col("high")).otherwise(F.col("low"))
    out = seen.groupBy("signal_id").agg((F.max("i") - F.min("i")).alias("elapsed_bars"), F.max_by(pct(F.col("close")), "i").alias("current_move_pct"), F.max(pct(far)).alias("peak_move_pct"))
    return out.withColumn("drawdown_pct", F.greatest(F.col("peak_move_pct") - F.col("current_move_pct"), F.lit(0.0)))
