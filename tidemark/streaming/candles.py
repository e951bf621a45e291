"""Candle streams: closed roll-ups, signals found and followed bar by bar, and sinks that take each row once.

Only closed bars count: a bucket comes out when the watermark has passed its end, and bars that come late or twice are
turned away, never merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from statistics import median

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tidemark.functions.columns import SERIES
from tidemark.functions.storage import stored
from tidemark.operators.signals import CONTEXT_BARS, STRICT, Shape

EVENTS = "asset string, timeframe string, signal_id string, status string, bar_index long, departure_index long, fill_index long"


def rollup(stream: DataFrame, width: str, delay: str, complete_of: int | None = None) -> DataFrame:
    """Tumbling candles of a stream of candles (open_time in ms), each emitted once its end is behind the watermark."""
    timed = stream.withColumn("ts", F.timestamp_millis("open_time")).withWatermark("ts", delay)
    out = timed.groupBy(*SERIES, F.window("ts", width)).agg(F.min_by("open", "open_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_time").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("bars"))
    if complete_of is not None:
        out = out.where(F.col("bars") == complete_of)
    return out.select(*SERIES, F.unix_millis("window.start").alias("open_time"), "open", "high", "low", "close", "volume", "bars")


class Follower:
    """One series: its last bars, its open signals by id, and what became of the others."""

    def __init__(self, bars: list[tuple], opened: dict[str, tuple], following: int, last: int | None, follow_up: int, return_bars: int, shape: Shape):
        self.bars, self.open, self.next, self.last = bars, opened, following, last
        self.follow_up, self.return_bars, self.shape = follow_up, return_bars, shape
        #: resolved signals, and the ids whose state has changed
        self.out: list[tuple] = []
        self.changed: set[str] = set()

    @property
    def kept(self) -> int:
        """Bars that a later signal can look back on: the context or the longer look back."""
        return max(CONTEXT_BARS, self.return_bars)

    def _signal(self, bar: tuple) -> tuple[str, tuple] | None:
        time, o, h, low, c, volume = bar
        size = h - low
        prior = self.bars[-CONTEXT_BARS:]
        if size <= 0 or len(prior) < CONTEXT_BARS or len(self.bars) < self.return_bars:
            return None
        usual, mean, back = median(b[2] - b[3] for b in prior), sum(b[5] for b in prior) / CONTEXT_BARS, self.bars[-self.return_bars][4]
        if not usual or not mean or not back or not c:
            return None
        body, lower, upper = abs(c - o) / size, (min(o, c) - low) / size, (h - max(o, c)) / size
        fits = lambda main, other: body <= self.shape.body_most and main >= self.shape.dominant_least and other <= self.shape.opposite_most
        sign = 1 if fits(lower, upper) else -1 if fits(upper, lower) else 0
        if not sign:
            return None
        name = "lower_wick" if sign == 1 else "upper_wick"
        return f"{name}_{time}", (sign, self.next, low if sign == 1 else h, h if sign == 1 else low, None)

    def take(self, bar: tuple) -> bool:
        """Whether the bar was taken: one that is not later than the last is turned away."""
        if self.last is not None and bar[0] <= self.last:
            return False
        _, _, h, low, c, _ = bar
        for name, (sign, at, target, far, left) in list(self.open.items()):
            touch = low <= target if sign == 1 else h >= target
            leave = c >= far if sign == 1 else c <= far
            status = None
            if left is None:
                if touch:
                    status = "filled_before_departure"
                elif leave:
                    left = self.next
                    self.open[name] = (sign, at, target, far, left)
                    self.changed.add(name)
            elif touch:
                status = "filled"
            if status is None and self.next - at == self.follow_up:
                status = "no_departure" if left is None else "unfilled"
            if status:
                self.out.append((name, status, at, left, self.next if status == "filled" else None))
                del self.open[name]
                self.changed.add(name)
        if (found := self._signal(bar)) is not None:
            self.open[found[0]] = found[1]
            self.changed.add(found[0])
        self.bars = [*self.bars, bar][-self.kept :]
        self.last, self.next = bar[0], self.next + 1
        return True


class Following(StatefulProcessor):
    """Keyed state of each series: its last bars as a list, its open signals as a map, and a timer that ends a series gone quiet."""

    def __init__(self, follow_up: int, return_bars: int, shape: Shape, quiet_ms: int | None):
        self.follow_up, self.return_bars, self.shape, self.quiet_ms = follow_up, return_bars, shape, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bars = handle.getListState("bars", "open_time long, open double, high double, low double, close double, volume double")
        self.open = handle.getMapState("open", "name string", "sign int, at long, target double, far double, departed long")
        self.place = handle.getValueState("place", "following long, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        following, last = self.place.get() if self.place.exists() else (0, None)
        opened = {k[0]: tuple(v) for k, v in self.open.iterator()} if self.open.exists() else {}
        one = Follower([tuple(b) for b in self.bars.get()] if self.bars.exists() else [], opened, following, last, self.follow_up, self.return_bars, self.shape)
        # a batch brings a series' bars in any order; only their numbers are held
        new = sorted((int(time), *map(float, rest)) for part in rows for time, *rest in part[["open_time", "open", "high", "low", "close", "volume"]].itertuples(index=False, name=None))
        if not any([one.take(bar) for bar in new]):
            return
        self.bars.put(one.bars)
        for name in one.changed:
            if name in one.open:
                self.open.updateValue((name,), one.open[name])
            elif self.open.containsKey((name,)):
                self.open.removeKey((name,))
        self.place.update((one.next, one.last))
        if self.quiet_ms is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(one.last + self.quiet_ms)
        yield self._told(key, one.out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        """What is still open when a series has gone quiet is censored."""
        rows = [(k[0], "right_censored", v[1], v[4], None) for k, v in self.open.iterator()] if self.open.exists() else []
        self.open.clear()
        yield self._told(key, rows)

    def _told(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        named = [(key[0], key[1], f"{key[0]}_{key[1]}_{name}", *rest) for name, *rest in rows]
        return pd.DataFrame(named, columns=["asset", "timeframe", "signal_id", "status", "bar_index", "departure_index", "fill_index"]).astype({"bar_index": "Int64", "departure_index": "Int64", "fill_index": "Int64"})

    def close(self) -> None:
        pass


def follow(stream: DataFrame, follow_up: int, return_bars: int = 1, shape: Shape = STRICT, quiet_ms: int | None = None, delay: str = "0 seconds") -> DataFrame:
    """One row per signal when it is resolved: filled, filled_before_departure, unfilled, no_departure or right_censored.

    quiet_ms: signals that are still open when the watermark, `delay` behind the newest bar of all series, has passed
    the last bar of their series by so much are censored; None: they stay open. State per series: as many bars as a
    signal looks back on, and the signals still open, of which there are at most follow_up; only what a batch has
    changed is written. The state store must be one that keeps maps and lists, and is set here.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = stream if quiet_ms is None else stream.withColumn("ts", F.timestamp_millis("open_time")).withWatermark("ts", delay)
    return timed.groupBy(*SERIES).transformWithStateInPandas(Following(follow_up, return_bars, shape, quiet_ms), EVENTS, "append", "None" if quiet_ms is None else "EventTime")


def append_in_order(path: str, interval_ms: int) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for candles: takes each series' bars that continue the stored ones without a gap, and raises otherwise.

    Bars that are stored already are skipped, so a batch that is tried again changes nothing.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            last = spark.read.parquet(path).groupBy(*SERIES).agg(F.max("open_time").alias("_last"))
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            last = spark.createDataFrame([], "asset string, timeframe string, _last long")
        new = stored(batch.join(last, list(SERIES), "left").where(F.col("_last").isNull() | (F.col("open_time") > F.col("_last"))), "stream-batch")
        spans = new.groupBy(*SERIES, "_last").agg(F.min("open_time").alias("a"), F.max("open_time").alias("b"), F.count("*").alias("n"), F.count_distinct("open_time").alias("k"))
        broken = spans.where((F.col("n") != F.col("k")) | (F.col("b") - F.col("a") != (F.col("n") - 1) * interval_ms) | (F.col("_last").isNotNull() & (F.col("a") != F.col("_last") + interval_ms))).limit(1).collect()
        if broken:
            raise ValueError(f"{broken[0].asset} {broken[0].timeframe}: the batch does not continue the stored bars without a gap or a repeat")
        new.drop("_last").write.mode("append").parquet(path)

    return write


def isolated(path: str, interval_ms: int) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that takes the series that continue their stored bars, and sets the others aside with the reason.

    Below `path`: bars (by batch), quarantine (by batch, with `reason`) and versions (by batch: series, bars, last_open).
    A bad series does not stop the others, and is taken again once a later batch continues it. Bars that are stored
    already are skipped. Each batch is written to folders of its own, so a batch that is tried again replaces them.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        earlier = _read_earlier(spark, f"{path}/versions", number)
        last = earlier.groupBy(*SERIES).agg(F.max("last_open").alias("_last")) if earlier is not None else spark.createDataFrame([], "asset string, timeframe string, _last long")
        new = stored(batch.join(last, list(SERIES), "left").where(F.col("_last").isNull() | (F.col("open_time") > F.col("_last")) | F.col("open_time").isNull()), "stream-batch")
        bad_prices = F.coalesce((F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high")), F.lit(True))
        spans = new.groupBy(*SERIES).agg(F.max("_last").alias("last"), F.min("open_time").alias("a"), F.max("open_time").alias("b"), F.count("*").alias("n"), F.count("open_time").alias("timed"), F.count_distinct("open_time").alias("k"), F.count_if(bad_prices).alias("bad"))
        reason = F.when(F.col("timed") < F.col("n"), "a bar without a time").when(F.col("n") != F.col("k"), "a repeated bar").when(F.col("b") - F.col("a") != (F.col("n") - 1) * interval_ms, "a gap inside the batch")
        reason = reason.when(F.col("last").isNotNull() & (F.col("a") != F.col("last") + interval_ms), "a gap after the stored bars").when(F.col("bad") > 0, "prices that contradict each other")
        judged = stored(spans.select(*SERIES, reason.alias("reason"), F.col("n").alias("bars"), F.col("b").alias("last_open")), "stream-judged")
        # NULL names a series too
        same = F.lit(True)
        for c in SERIES:
            same = same & F.col(f"rows.{c}").eqNullSafe(F.col(f"judged.{c}"))
        both = new.drop("_last").alias("rows").join(judged.select(*SERIES, "reason").alias("judged"), same).select("rows.*", "judged.reason")
        both.where("reason IS NULL").drop("reason").write.mode("overwrite").parquet(f"{path}/bars/batch={number}")
        both.where("reason IS NOT NULL").write.mode("overwrite").parquet(f"{path}/quarantine/batch={number}")
        # last, so that a batch counts once its bars are there
        judged.where("reason IS NULL").drop("reason").write.mode("overwrite").parquet(f"{path}/versions/batch={number}")

    return write


def _read_earlier(spark: SparkSession, path: str, number: int) -> DataFrame | None:
    try:
        return spark.read.parquet(path).where(F.col("batch") < number)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def run_available(spark: SparkSession, out: DataFrame, path: str) -> DataFrame:
    """What a streaming query gives for all that its source holds now, written to `path` and read back."""
    out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")
