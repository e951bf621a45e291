"""Features of an observation from candles up to its entry, and its path as a fixed-width fingerprint."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import SERIES, mirrored_pct, missing_as_zero, overlapped, ratio


def rolling(candles: DataFrame, windows: Sequence[int]) -> DataFrame:
    """Per bar and window (bars): return, standard deviation of one-bar returns, mean range, and mean volume now to one window ago.

    What needs bars from before the series began is NULL, the volume ratio too where one window ago had no mean yet.
    """
    order = Window.partitionBy(*SERIES, "_block").orderBy("bar_index")
    change = (ratio(F.col("close"), F.lag("close").over(order)) - 1.0) * 100.0
    rows = overlapped(candles, 2 * max(*windows, 2) + 1).select(*SERIES, "_block", "_own", "bar_index", "close", "volume", change.alias("change"), (ratio(F.col("high") - F.col("low"), F.col("close")) * 100.0).alias("range_pct"))
    columns = []
    for w in windows:
        frame = order.rowsBetween(1 - max(w, 2), 0)
        two = lambda c, x: F.when(F.count(c).over(frame) >= 2, x)
        columns += [
            ((ratio(F.col("close"), F.lag("close", w).over(order)) - 1.0) * 100.0).alias(f"return_{w}"), two("change", F.stddev_pop("change").over(frame)).alias(f"volatility_{w}"),
            two("range_pct", F.avg("range_pct").over(frame)).alias(f"range_{w}"), two("volume", F.avg("volume").over(frame)).alias(f"volume_{w}"),
        ]
    wide = rows.select(*SERIES, "_block", "_own", "bar_index", *columns)
    # greatest() passes over NULL, which here must stay
    before = lambda w: F.lag(f"volume_{w}", w).over(order)
    ago = [F.when(before(w).isNotNull(), F.col(f"volume_{w}") / F.greatest(before(w), F.lit(1e-12))).alias(f"volume_ratio_{w}") for w in windows]
    found = wide.select(*SERIES, "_own", "bar_index", *(f"{n}_{w}" for w in windows for n in ("return", "volatility", "range")), *ago)
    return found.where("_own").drop("_own")


def of_observations(observed: DataFrame, candles: DataFrame, before: Sequence[int], recent: Sequence[int], assets: Sequence[str]) -> DataFrame:
    """Features by observation: logs of its state, its entry bar, windows before the signal and up to the entry, and who it is.

    Nothing after the entry bar is read. What is missing or infinite is 0.
    """
    bar = candles.select(*SERIES, F.col("bar_index").alias("entry_index"), *(F.col(c).alias(f"_{c}") for c in ("open", "high", "low")))
    signal = candles.select(*SERIES, F.col("bar_index").alias("signal_index"), F.col("close").alias("_signal_close"))
    moved = rolling(candles, sorted({*before, *recent}))
    names = ("return", "volatility", "range", "volume_ratio")
    pick = lambda prefix, at, windows: moved.select(*SERIES, F.col("bar_index").alias(at), *(F.col(f"{n}_{w}").alias(f"{prefix}_{n}_{w}") for w in windows for n in names))
    rows = observed.withColumn("_before_index", F.col("signal_index") - 1).join(bar, [*SERIES, "entry_index"]).join(signal, [*SERIES, "signal_index"])
    rows = rows.join(pick("pre", "_before_index", before), [*SERIES, "_before_index"], "left").join(pick("recent", "entry_index", recent), [*SERIES, "entry_index"], "left")
    log1p = lambda c: F.log1p(F.greatest(c.cast("double"), F.lit(0.0)))
    price, sign = F.greatest("entry_price", F.lit(1e-12)), F.col("direction_sign")
    columns: list[Column] = [
        log1p(F.col("age_bars") * F.col("interval_minutes")).alias("log_age_minutes"), log1p(F.col("entry_distance_pct")).alias("log_entry_distance"), log1p(F.col("peak_distance_pct")).alias("log_peak_distance"),
        log1p(F.col("departure_to_entry_bars")).alias("log_departure_to_entry"), ((F.col("_high") - F.col("_low")) / price * 100.0).alias("entry_range_pct"), (F.abs(F.col("entry_price") - F.col("_open")) / price * 100.0).alias("entry_body_pct"),
        (sign * (ratio(F.col("entry_price"), F.col("_signal_close")) - 1.0) * 100.0).alias("signal_to_entry_return"),
        *((sign * F.col(f"{p}_return_{w}")).alias(f"{p}_return_{w}") for p, ws in (("pre", before), ("recent", recent)) for w in ws),
        *(F.col(f"{p}_{n}_{w}") for p, ws in (("pre", before), ("recent", recent)) for w in ws for n in names[1:]),
        *((F.col("asset") == a).cast("double").alias(f"asset_{a}") for a in assets), (F.col("direction") == "upper_wick").cast("double").alias("upper_wick"),
    ]
    wide = rows.select("observation_id", *columns)
    return wide.select("observation_id", *(missing_as_zero(F.col(c)).alias(c) for c in wide.columns[1:]))


def evenly(start: Column, end: Column, points: int) -> Column:
    """`points` bar numbers from start to end, both kept, the others rounded half to even."""
    step = lambda k: F.rint(start + F.lit(k) * (end - start) / F.lit(float(points - 1))).cast("long")
    return F.array(*map(step, range(points)))


def fingerprint(observed: DataFrame, candles: DataFrame, pre_bars: int, recent_bars: int, points: tuple[int, int, int] = (12, 12, 16)) -> DataFrame:
    """Long (observation_id, view, point, value): mirrored distances before the signal, up to the entry, and between both.

    The first two views are relative to their last point, the third to its first.
    """
    zero = F.lit(0).cast("long")
    views = [
        ("pre", F.greatest(F.col("signal_index") - pre_bars, zero), F.greatest(F.col("signal_index") - 1, zero), points[0]),
        ("recent", F.greatest(F.col("entry_index") - recent_bars + 1, zero), F.col("entry_index"), points[1]),
        ("episode", F.col("signal_index"), F.col("entry_index"), points[2]),
    ]

    def placed(view: str, start: Column, end: Column, n: int) -> Column:
        anchor = 0 if view == "episode" else n - 1
        return F.transform(evenly(start, F.greatest(start, end), n), lambda i, k: F.struct(F.lit(view).alias("view"), k.alias("point"), (k == anchor).alias("anchor"), i.alias("bar_index")))

    at = F.concat(*(placed(*v) for v in views))
    rows = observed.select("observation_id", *SERIES, "wick_target", "direction_sign", F.explode(at).alias("p")).select("observation_id", *SERIES, "wick_target", "direction_sign", "p.*")
    value = mirrored_pct(F.col("close"), F.greatest("wick_target", F.lit(1e-12)), F.col("direction_sign"))
    found = rows.join(candles.select(*SERIES, "bar_index", "close"), [*SERIES, "bar_index"]).select("observation_id", "view", "point", "anchor", value.alias("v"))
    base = F.max(F.when(F.col("anchor"), F.col("v"))).over(Window.partitionBy("observation_id", "view"))
    return found.select("observation_id", "view", "point", (F.col("v") - base).alias("value"))


def as_vectors(long: DataFrame, key: str = "observation_id") -> DataFrame:
    """Fingerprints as one array per observation, views in the order pre, recent, episode."""
    order = F.when(F.col("view") == "pre", 0).when(F.col("view") == "recent", 1).otherwise(2)
    return long.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "point", "value"))).alias("_v")).select(key, F.transform("_v", lambda x: x["value"]).alias("vector"))


def resampled(values: Column, points: int) -> Column:
    """An array of any length read at `points` even places, linearly between its elements. One element is repeated, an empty array stays empty."""
    n = F.size(values)

    def at(k: Column) -> Column:
        x = k * (n - 1) / float(points - 1)
        low = F.floor(x).cast("int")
        high = F.least(low + 1, n - 1)
        return F.get(values, low) + (x - low) * (F.get(values, high) - F.get(values, low))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at)).otherwise(F.array().cast("array<double>"))


def future_curve(path_rows: DataFrame, snapshots: DataFrame, horizons: Sequence[int], least_move: float = 0.02, most_ratio: float = 25.0) -> DataFrame:
    """Long (episode_id, offset_bars, horizon_bars, distance, log_ratio, falls): where a route stood `horizon_bars` after each snapshot.

    From the fill on the distance is 0; `falls` says that it is below the snapshot's move.
    """
    ends = path_rows.groupBy("episode_id").agg(F.max("offset_bars").alias("_end"))
    asked = snapshots.select("episode_id", "offset_bars", "current_move_pct", F.explode(F.array(*map(F.lit, horizons))).alias("horizon_bars")).join(ends, "episode_id")
    later = path_rows.select("episode_id", F.col("offset_bars").alias("_at"), F.greatest("normalized_close_pct", F.lit(0.0)).alias("_later"))
    rows = asked.withColumn("_at", F.col("offset_bars") + F.col("horizon_bars")).join(later, ["episode_id", "_at"], "left")
    distance = F.when(F.col("_at") >= F.col("_end"), 0.0).otherwise(F.col("_later"))
    ratio_ = F.least(distance / F.greatest("current_move_pct", F.lit(least_move)), F.lit(most_ratio))
    return rows.select("episode_id", "offset_bars", "horizon_bars", distance.alias("distance"), F.log1p(ratio_).alias("log_ratio"), (distance < F.col("current_move_pct")).alias("falls"))


def signed_log1p(value: Column) -> Column:
    """ln(1 + |x|) with the sign of x."""
    return F.signum(value) * F.log1p(F.abs(value))


def decoded_distance(log_ratio: Column, current_move: Column, least_move: float = 0.02) -> Column:
    """The distance that a curve's log ratio stands for."""
    return F.expm1(F.greatest(log_ratio, F.lit(0.0))) * F.greatest(current_move, F.lit(least_move))


def composed(blocks: dict[str, str], weights: dict[str, float]) -> Column:
    """One vector of several blocks' vectors (name -> array column), each times its weight; blocks without a weight are left out."""
    return F.concat(*(_times(F.col(c), weights[b]) for b, c in blocks.items() if weights.get(b)))


def _times(vector: Column, weight: float) -> Column:
    return F.transform(vector, lambda x: x * weight)
