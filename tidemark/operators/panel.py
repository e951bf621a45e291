"""Fixed-horizon labels of every signal, and their rates by series."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import SERIES
from tidemark.operators.trace import first_fill_and_departure


def outcome(fill: Column, leave: Column, bars: int) -> Column:
    filled, left = fill.isNotNull() & (fill <= bars), leave.isNotNull() & (leave <= bars)
    return F.when(filled & left & (leave < fill), "departure_then_fill").when(filled, "filled_before_or_with_departure").when(left, "departed_not_filled").otherwise("no_departure_no_fill")


def labels(signals: DataFrame, candles: DataFrame, horizons: Mapping[str, int]) -> DataFrame:
    """One row per signal; fill, departure, clean fill and outcome of each horizon (name -> bars), NULL until the horizon has passed."""
    found = first_fill_and_departure(signals, candles, max(horizons.values()))
    found = found.withColumn("fill_bars", F.col("first_fill") - F.col("bar_index")).withColumn("departure_bars", F.col("first_departure") - F.col("bar_index"))
    fill, leave = F.col("fill_bars"), F.col("departure_bars")
    columns = []
    for name, bars in horizons.items():
        mature = F.col("bar_index") + bars < F.col("series_bars")
        filled, left = F.coalesce(fill <= bars, F.lit(False)), F.coalesce(leave <= bars, F.lit(False))
        columns += [
            F.when(mature, filled.cast("int")).alias(f"fill_{name}"), F.when(mature, left.cast("int")).alias(f"departure_{name}"),
            F.when(mature, (filled & left & (leave < fill)).cast("int")).alias(f"clean_{name}"), F.when(mature, outcome(fill, leave, bars)).alias(f"outcome_{name}"),
        ]
    return found.select("signal_id", *SERIES, "open_time", "direction", "fill_bars", "departure_bars", *columns)


def strata(panel: DataFrame, horizons: Mapping[str, int]) -> DataFrame:
    """Counts and rates of the mature labels by series."""
    columns = [F.count("*").alias("signals"), F.count_if(F.col("direction") == "lower_wick").alias("lower_wicks"), F.count_if(F.col("direction") == "upper_wick").alias("upper_wicks")]
    for name in horizons:
        columns += [F.count(f"fill_{name}").alias(f"mature_{name}"), F.avg(f"fill_{name}").alias(f"fill_rate_{name}"), F.avg(f"clean_{name}").alias(f"clean_rate_{name}")]
    return panel.groupBy(*SERIES).agg(*columns)


def outcome_counts(panel: DataFrame, horizons: Mapping[str, int]) -> DataFrame:
    long = panel.select(*SERIES, F.explode(F.array(*(F.struct(F.lit(n).alias("horizon"), F.col(f"outcome_{n}").alias("outcome")) for n in horizons))).alias("o")).select(*SERIES, "o.*")
    return long.where("outcome IS NOT NULL").groupBy(*SERIES, "horizon", "outcome").agg(F.count("*").alias("signals"))
