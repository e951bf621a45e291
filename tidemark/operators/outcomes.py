"""Every signal at fixed ages, with competing outcomes over several horizons and adverse thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import SERIES, mirrored_pct, slug
from tidemark.operators.first_hit import Blocks, first_hits, range_max


def _aged(traced: DataFrame, ages: Sequence[int]) -> DataFrame:
    """Signal x age (bars), with the reason why there is no observation, tested in this order."""
    rows = traced.withColumn("age_bars", F.explode(F.array(*map(F.lit, ages)))).withColumn("entry_index", F.col("bar_index") + F.col("age_bars"))
    reason = (
        F.when(F.col("entry_index") >= F.col("series_bars"), "entry_not_observed")
        .when(F.col("departure_index").isNull() | (F.col("departure_index") > F.col("entry_index")), "not_departed_by_entry")
        .when(F.col("fill_index") <= F.col("entry_index"), "filled_by_entry")
    )
    return rows.withColumn("omitted", reason)


def omissions(traced: DataFrame, ages: Sequence[int]) -> DataFrame:
    return _aged(traced, ages).groupBy("age_bars", F.coalesce("omitted", F.lit("observed")).alias("reason")).agg(F.count("*").alias("signals"))


def observations(traced: DataFrame, candles: DataFrame, ages: Sequence[int], blocks: Blocks | None = None) -> DataFrame:
    """What can be seen at each age: entry price, distance and peak distance from the target, drawdown."""
    kept = _aged(traced, ages).where("omitted IS NULL")
    entry = candles.select(*SERIES, F.col("bar_index").alias("entry_index"), F.col("close").alias("entry_price"), F.col("open_time").alias("entry_open_time"), F.col("close_time").alias("entry_close_time"))
    rows = kept.join(entry, [*SERIES, "entry_index"]).withColumn("observation_id", F.concat_ws("_", "signal_id", F.lit("entry"), F.concat((F.col("age_bars") * F.col("interval_minutes")).cast("string"), F.lit("m"))))
    lower = F.col("direction_sign") == 1
    asked = rows.select(F.col("observation_id").alias("rid"), *SERIES, (F.col("bar_index") - 1).alias("after"), F.col("entry_index").alias("last"), F.when(lower, "high").otherwise("neg_low").alias("track"))
    far = range_max(asked, blocks or candles).withColumnRenamed("rid", "observation_id")
    edge = F.when(lower, F.col("largest")).otherwise(-F.col("largest"))
    peak = F.greatest(mirrored_pct(edge, F.col("wick_target"), F.col("direction_sign")), F.lit(0.0))
    now = F.greatest(mirrored_pct(F.col("entry_price"), F.col("wick_target"), F.col("direction_sign")), F.lit(0.0))
    return rows.join(far, "observation_id").select(
        "observation_id", "signal_id", *SERIES, "interval_minutes", "direction", "direction_sign", F.col("open_time").alias("signal_open_time"), F.col("bar_index").alias("signal_index"), "departure_index", "entry_index", "age_bars",
        "entry_open_time", "entry_close_time", "entry_price", "wick_target", "series_bars", now.alias("entry_distance_pct"), peak.alias("peak_distance_pct"), F.greatest(peak - now, F.lit(0.0)).alias("drawdown_pct"),
        (F.col("entry_index") - F.col("departure_index")).alias("departure_to_entry_bars"), *(c for c in traced.columns if c.endswith(("_of_range", "_of_close", "_median", "_mean", "_return_pct"))),
    )


def touches(observed: DataFrame, candles: DataFrame | Blocks, horizon_bars: int, thresholds: Sequence[float]) -> DataFrame:
    """(observation_id, available_bars, target_bars, adverse_bars: threshold name -> bars): first touches within the largest horizon, NULL if none."""
    lower, sign = F.col("direction_sign") == 1, F.col("direction_sign")
    target = F.struct(F.lit("target").alias("what"), F.when(lower, "neg_low").otherwise("high").alias("track"), (-sign * F.col("wick_target")).alias("level"))
    against = [F.struct(F.lit(slug(t)).alias("what"), F.when(lower, "high").otherwise("neg_low").alias("track"), (sign * F.col("entry_price") * (1 + sign * t / 100.0)).alias("level")) for t in thresholds]
    last = F.least(F.col("entry_index") + horizon_bars, F.col("series_bars") - 1)
    asked = observed.withColumn("r", F.explode(F.array(target, *against))).select(F.struct("observation_id", "r.what").alias("rid"), *SERIES, F.col("entry_index").alias("after"), last.alias("last"), "r.track", "r.level")
    hits = first_hits(asked, candles).select("rid.observation_id", "rid.what", "hit")
    names = ["target", *map(slug, thresholds)]
    wide = hits.groupBy("observation_id").agg(*(F.max(F.when(F.col("what") == n, F.col("hit"))).alias(f"_{n}") for n in names))
    out = observed.select("observation_id", "entry_index", (last - F.col("entry_index")).alias("available_bars")).join(wide, "observation_id", "left")
    return out.select("observation_id", "available_bars", *((F.col(f"_{n}") - F.col("entry_index")).alias("target_bars" if n == "target" else f"adverse_{n}pct_bars") for n in names))


def competing(target: Column, adverse: Column, horizon: Column | int, available: Column) -> Column:
    """Which comes first within the horizon; both in one bar is ambiguous, and neither needs the whole horizon seen."""
    hit, against = F.coalesce(target <= horizon, F.lit(False)), F.coalesce(adverse <= horizon, F.lit(False))
    both = F.when(target == adverse, "ambiguous_intrabar").when(target < adverse, "target_first").otherwise("adverse_first")
    return F.when(hit & against, both).when(hit, "target_first").when(against, "adverse_first").when(available >= horizon, "neither").otherwise("right_censored")


def outcomes(touched: DataFrame, horizons: Sequence[int], thresholds: Sequence[float]) -> DataFrame:
    """Long: one row per observation, horizon (bars) and threshold."""
    pairs = [F.struct(F.lit(h).alias("horizon_bars"), F.lit(float(t)).alias("threshold_pct"), competing(F.col("target_bars"), F.col(f"adverse_{slug(t)}pct_bars"), h, F.col("available_bars")).alias("outcome")) for h in horizons for t in thresholds]
    return touched.select("observation_id", F.explode(F.array(*pairs)).alias("o")).select("observation_id", "o.*")


def outcomes_wide(touched: DataFrame, horizons: Sequence[int], thresholds: Sequence[float]) -> DataFrame:
    """One column per horizon and threshold, named as the wide contract does."""
    return touched.select("observation_id", *(competing(F.col("target_bars"), F.col(f"adverse_{slug(t)}pct_bars"), h, F.col("available_bars")).alias(f"outcome_{h}b_vs_{slug(t)}pct") for h in horizons for t in thresholds))


def outcome_totals(long: DataFrame) -> DataFrame:
    return long.groupBy("horizon_bars", "threshold_pct", "outcome").agg(F.count("*").alias("observations"))


def adverse_bounds(observed: DataFrame, touched: DataFrame, candles: DataFrame | Blocks, horizons: Sequence[int]) -> DataFrame:
    """Long: per observation and horizon whether the target was hit and the largest adverse move before it.

    The lower bound leaves the touching bar out, the upper one counts it: within one bar the order is not known.
    """
    rows = observed.join(touched.select("observation_id", "available_bars", "target_bars"), "observation_id").withColumn("horizon_bars", F.explode(F.array(*map(F.lit, horizons))))
    rows = rows.withColumn("target_hit", F.coalesce(F.col("target_bars") <= F.col("horizon_bars"), F.lit(False))).withColumn("visible", F.least("horizon_bars", "available_bars"))
    stop = F.when(F.col("target_hit"), F.col("target_bars")).otherwise(F.col("visible"))
    rows = rows.withColumn("upper_bars", F.least("visible", stop)).withColumn("lower_bars", F.least(F.col("visible"), F.when(F.col("target_hit"), F.col("target_bars") - 1).otherwise(F.col("visible"))))
    track = F.when(F.col("direction_sign") == 1, "high").otherwise("neg_low")
    bounds = F.explode(F.array(F.struct(F.lit("lower").alias("what"), F.col("lower_bars").alias("bars")), F.struct(F.lit("upper").alias("what"), F.col("upper_bars").alias("bars"))))
    asked = rows.select("observation_id", "horizon_bars", *SERIES, "entry_index", track.alias("track"), bounds.alias("b"))
    asked = asked.select(F.struct("observation_id", "horizon_bars", "b.what").alias("rid"), *SERIES, F.col("entry_index").alias("after"), (F.col("entry_index") + F.col("b.bars")).alias("last"), "track")
    found = range_max(asked, candles).groupBy("rid.observation_id", "rid.horizon_bars").agg(*(F.max(F.when(F.col("rid.what") == w, F.col("largest"))).alias(f"_{w}") for w in ("lower", "upper")))
    sign = F.col("direction_sign")
    # the largest high (or -low) gives the largest adverse move: it grows with it
    move = lambda w: F.greatest(F.coalesce(sign * (sign * F.col(f"_{w}") / F.col("entry_price") - 1.0) * 100.0, F.lit(0.0)), F.lit(0.0)).alias(f"max_adverse_{w}_pct")
    return rows.join(found, ["observation_id", "horizon_bars"], "left").select("observation_id", "horizon_bars", (F.col("available_bars") >= F.col("horizon_bars")).alias("fully_observed"), "target_hit", move("lower"), move("upper"))
