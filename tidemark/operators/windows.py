"""Windows of raw candles for many observations: blocks of bars are written once, and a request reads the blocks it touches.

A request is exploded into its block numbers, never into its bars, and joined on these; what comes back is one array of
bars for each request, as long as its window, and channels are computed inside the array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import SERIES, clip, mirrored_pct
from tidemark.functions.storage import stored
from tidemark.operators.features import resampled, signed_log1p

BLOCK = 64
BAR = ("open", "high", "low", "close", "volume")
#: what a point of a raw window holds, in this order; `present` is 0 where the series had not begun
CHANNELS = ("open", "high", "low", "close", "change", "range", "volume", "after_signal", "present")
ROUTE_CHANNELS = ("open", "high", "low", "close", "range", "volume")
#: largest change between two bars, in percent (fixed value)
MOST_CHANGE = 20.0


def written(candles: DataFrame, block: int = BLOCK) -> DataFrame:
    """(series, block, bars): candles in blocks of `block` bars, written."""
    bars = candles.groupBy(*SERIES, F.expr(f"bar_index div {block}").alias("block")).agg(F.array_sort(F.collect_list(F.struct(F.col("bar_index").alias("i"), *BAR))).alias("bars"))
    return stored(bars, "window-blocks")


def sliced(requests: DataFrame, blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """(rid, bars): the bars first to last of each request (rid, series, first, last), in order; requests without bars have no row."""
    touched = requests.where("first <= last").withColumn("block", F.explode(F.sequence(F.expr(f"first div {block}"), F.expr(f"last div {block}"))))
    part = F.filter("bars", lambda b: b["i"].between(F.col("first"), F.col("last")))
    met = touched.join(blocks, [*SERIES, "block"]).select("rid", "block", part.alias("part")).where(F.size("part") > 0)
    parts = met.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("block", "part"))).alias("parts"))
    return parts.select("rid", F.flatten(F.transform("parts", lambda p: p["part"])).alias("bars"))


def _points(bars: Column, target: Column, sign: Column, volume: Column, signal_index: Column) -> Column:
    """The channels of each bar of a window; the first has no change."""
    least = lambda c: F.greatest(c, F.lit(1e-12))

    def point(bar: Column, k: Column) -> Column:
        before = F.get(bars, F.greatest(k - 1, F.lit(0)))["close"]
        prices = [signed_log1p(mirrored_pct(bar[c], target, sign)).alias(c) for c in ("open", "high", "low", "close")]
        change = clip(sign * F.ln(least(bar["close"]) / least(before)) * 100.0, -MOST_CHANGE, MOST_CHANGE).alias("change")
        size = F.log1p(F.abs(bar["high"] - bar["low"]) / target * 100.0).alias("range")
        amount = F.log1p(F.greatest(bar["volume"], F.lit(0.0)) / least(volume)).alias("volume")
        return F.struct(*prices, change, size, amount, (bar["i"] >= signal_index).cast("double").alias("after_signal"), F.lit(1.0).alias("present"))

    return F.transform(bars, point)


def raw_window(bars: Column, length: int, target: Column, sign: Column, volume: Column, signal_index: Column) -> Column:
    """The last `length` bars as points of CHANNELS; a shorter window stands at the end, behind points of zeros."""
    kept = F.slice(bars, F.greatest(F.size(bars) - length + 1, F.lit(1)), F.lit(length))
    points = _points(kept, target, sign, volume, signal_index)
    empty = F.struct(*(F.lit(0.0).alias(c) for c in CHANNELS))
    return F.concat(F.array_repeat(empty, F.greatest(F.lit(length) - F.size(kept), F.lit(0))), points)


def route_window(bars: Column, points: int, target: Column, sign: Column, volume: Column) -> Column:
    """A route of any length read at `points` even places, as points of ROUTE_CHANNELS. Prices are read before they are put on the log scale."""
    pct = lambda c: F.transform(bars, lambda b: mirrored_pct(b[c], target, sign))
    size = F.transform(bars, lambda b: F.abs(mirrored_pct(b["high"], target, sign) - mirrored_pct(b["low"], target, sign)))
    amount = F.transform(bars, lambda b: F.greatest(b["volume"], F.lit(0.0)) / F.greatest(volume, F.lit(1e-12)))
    read = [F.transform(resampled(pct(c), points), signed_log1p) for c in ("open", "high", "low", "close")] + [F.transform(resampled(x, points), lambda v: F.log1p(v)) for x in (size, amount)]
    return F.arrays_zip(*(r.alias(c) for r, c in zip(read, ROUTE_CHANNELS)))


def samples(observed: DataFrame, blocks: DataFrame, lengths: dict[str, int], route_points: int, block: int = BLOCK) -> DataFrame:
    """(observation_id, pre, recent, episode): raw windows up to the bar before the signal and up to the entry, and the route between both.

    lengths: points of pre and recent. The signal's volume is the unit of volumes; an observation whose signal bar is
    not in the blocks has no row.
    """
    spans = {"pre": (F.col("signal_index") - lengths["pre"], F.col("signal_index") - 1), "recent": (F.col("entry_index") - lengths["recent"] + 1, F.col("entry_index")), "episode": (F.col("signal_index"), F.col("entry_index"))}
    asked = [F.struct(F.lit(v).alias("view"), F.greatest(a, F.lit(0)).cast("long").alias("first"), b.cast("long").alias("last")) for v, (a, b) in spans.items()]
    requests = observed.select("observation_id", *SERIES, F.explode(F.array(*asked)).alias("r")).select(F.struct("observation_id", "r.view").alias("rid"), *SERIES, "r.first", "r.last")
    found = sliced(requests, blocks, block).groupBy("rid.observation_id").agg(*(F.max_by(F.when(F.col("rid.view") == v, F.col("bars")), F.when(F.col("rid.view") == v, 1)).alias(f"_{v}") for v in spans))
    none = F.array().cast(found.schema["_pre"].dataType)
    rows = observed.select("observation_id", "wick_target", "direction_sign", "signal_index").join(found, "observation_id").where("_episode IS NOT NULL")
    volume = F.get("_episode", 0)["volume"]
    target, sign = F.greatest(F.col("wick_target"), F.lit(1e-12)), F.col("direction_sign")
    raw = lambda v: raw_window(F.coalesce(F.col(f"_{v}"), none), lengths[v], target, sign, volume, F.col("signal_index")).alias(v)
    return rows.select("observation_id", raw("pre"), raw("recent"), route_window(F.col("_episode"), route_points, target, sign, volume).alias("episode"))


def long_points(rows: DataFrame, view: str, channels: Sequence[str]) -> DataFrame:
    """(observation_id, view, point, channels) of one view."""
    each = rows.select("observation_id", F.posexplode(view).alias("point", "p"))
    return each.select("observation_id", F.lit(view).alias("view"), "point", *(F.col(f"p.{c}").alias(c) for c in channels))
