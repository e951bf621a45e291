"""Regular time series of open, high, low, close and volume: sources and contracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import SERIES
from tidemark.operators.ranks import running

#: The raw file's columns, in their order (fixed by the data's publisher).
RAW = T.StructType(
    [
        T.StructField("open_time", T.LongType()), T.StructField("open", T.DoubleType()), T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()), T.StructField("close", T.DoubleType()), T.StructField("volume", T.DoubleType()),
        T.StructField("close_time", T.LongType()), T.StructField("quote_asset_volume", T.DoubleType()), T.StructField("number_of_trades", T.LongType()),
        T.StructField("taker_buy_base_asset_volume", T.DoubleType()), T.StructField("taker_buy_quote_asset_volume", T.DoubleType()), T.StructField("ignore", T.StringType()),
    ]
)
COLUMNS = ("open_time", "close_time", "open", "high", "low", "close", "volume")


class ContractError(ValueError):
    """The data break a rule that everything downstream relies on."""


def read_csv(spark: SparkSession, path: str | list[str], asset: str, timeframe: str, interval_ms: int, begin_ms: int | None = None, end_ms: int | None = None, header: bool = True, check: bool = True, more: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """Candles of one series from CSV (also compressed, also many files). Numbers must parse; times may be cut to [begin, end).

    more: further columns of RAW that are kept, such as quote and taker volumes; most: only so many bars, the earliest.
    """
    rows = spark.read.schema(RAW).csv(path, header=header, mode="FAILFAST").select(*COLUMNS, *more)
    if begin_ms is not None:
        rows = rows.where(F.col("open_time") >= begin_ms)
    if end_ms is not None:
        rows = rows.where(F.col("open_time") < end_ms)
    if most is not None:
        rows = rows.orderBy("open_time").limit(most)
    out = rows.select(F.lit(asset).alias("asset"), F.lit(timeframe).alias("timeframe"), F.lit(interval_ms // 60_000).alias("interval_minutes"), *COLUMNS, *more)
    if check:
        require_contract(out, interval_ms)
    return with_index(out, interval_ms)


def read_parquet(spark: SparkSession, path: str, timeframe: str | None = None) -> DataFrame:
    """A candle store partitioned by asset and timeframe; a timeframe reads only its partitions."""
    rows = spark.read.parquet(path)
    return rows if timeframe is None else rows.where(F.col("timeframe") == timeframe)


def write_parquet(candles: DataFrame, path: str) -> None:
    """Partitioned by series and sorted by time in each file, so time ranges prune row groups; a long series is several files."""
    candles.repartitionByRange(*SERIES, "open_time").sortWithinPartitions(*SERIES, "open_time").write.mode("overwrite").option("compression", "zstd").partitionBy(*SERIES).parquet(path)


def from_ticks(rows: DataFrame, asset: Column, micros: Column, price: Column, order: Column, seconds: int, volume: Column | None = None) -> DataFrame:
    """Candles of a table of prices: buckets of `seconds` from the epoch; first and last by (time, order). Rows without time or price are left out.

    Sparse: a bucket without rows is not there, and bar_index counts the buckets that are.
    """
    width = seconds * 1000
    ticks = rows.select(asset.alias("asset"), micros.alias("t"), price.cast("double").alias("p"), order.alias("o"), (F.lit(1.0) if volume is None else volume.cast("double")).alias("v")).where("t IS NOT NULL AND p IS NOT NULL")
    at = F.struct("t", "o")
    out = ticks.groupBy("asset", F.expr(f"t div {seconds * 1_000_000}").alias("bucket")).agg(
        F.min_by("p", at).alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", at).alias("close"), F.sum("v").alias("volume")
    )
    timed = out.select("asset", F.lit(f"{seconds // 60}m").alias("timeframe"), F.lit(seconds // 60).alias("interval_minutes"), (F.col("bucket") * width).alias("open_time"), (F.col("bucket") * width + width - 1).alias("close_time"), "open", "high", "low", "close", "volume")
    return with_index(timed)


def with_index(candles: DataFrame, interval_ms: int | None = None) -> DataFrame:
    """bar_index from 0 in each series: by arithmetic where the series is gapless (an interval is given), else by counting."""
    if interval_ms is None:
        return running(candles, SERIES, ["open_time"]).withColumnRenamed("_before", "bar_index").drop("_all")
    first = candles.groupBy(*SERIES).agg(F.min("open_time").alias("_first"))
    return candles.join(first, list(SERIES)).withColumn("bar_index", F.floor((F.col("open_time") - F.col("_first")) / interval_ms).cast("long")).drop("_first")


def contract_report(candles: DataFrame, interval_ms: int) -> DataFrame:
    """Per series: rows, distinct times, times off the grid, missing bars, candles with broken order or prices."""
    bad = (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high"))
    per = candles.groupBy(*SERIES).agg(
        F.count("*").alias("row_count"), F.count_distinct("open_time").alias("distinct_times"), F.min("open_time").alias("first_open"), F.max("open_time").alias("last_open"),
        F.count_if(F.pmod("open_time", F.lit(interval_ms)) != 0).alias("off_grid"), F.count_if(F.col("close_time") != F.col("open_time") + interval_ms - 1).alias("bad_close_time"), F.count_if(bad).alias("bad_prices"),
    )
    span = F.expr(f"(last_open - first_open) div {interval_ms}") + 1
    return per.withColumn("missing_bars", span - F.col("distinct_times"))


def require_contract(candles: DataFrame, interval_ms: int) -> None:
    broken = contract_report(candles, interval_ms).where("row_count <> distinct_times OR off_grid > 0 OR missing_bars > 0 OR bad_close_time > 0").limit(3).collect()
    if broken:
        raise ContractError("; ".join(f"{r.asset} {r.timeframe}: {r.row_count} rows, {r.distinct_times} times, {r.missing_bars} missing, {r.off_grid} off the grid, {r.bad_close_time} closing at another time" for r in broken))


def keep_last(candles: DataFrame, order: str) -> DataFrame:
    """One candle per time, the one that `order` has last; rows without a price are left out."""
    newest = Window.partitionBy(*SERIES, "open_time").orderBy(F.desc(order))
    return candles.dropna(subset=["open", "high", "low", "close"]).withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def missing_ranges(candles: DataFrame, interval_ms: int, begin: int | None = None, end: int | None = None) -> DataFrame:
    """Gaps of each series as [gap_start, gap_end); with begin and end also those before the first and after the last bar."""
    times = candles.select(*SERIES, "open_time").distinct()
    if begin is not None and end is not None:
        names = candles.select(*SERIES).distinct()
        edges = names.select(*SERIES, F.explode(F.array(F.lit(begin - interval_ms), F.lit(end))).alias("open_time"))
        times = times.where((F.col("open_time") >= begin) & (F.col("open_time") < end)).unionByName(edges)
    gaps = running(times, SERIES, ["open_time"], previous="open_time").where(F.col("open_time") - F.col("_previous") > interval_ms)
    return gaps.select(*SERIES, (F.col("_previous") + interval_ms).alias("gap_start"), F.col("open_time").alias("gap_end"), F.expr(f"(open_time - _previous) div {interval_ms} - 1").alias("missing_bars"))


def common_window(candles: DataFrame, interval_ms: int) -> DataFrame:
    """The time that all series of a timeframe cover, [window_start, window_end)."""
    per = candles.groupBy(*SERIES).agg(F.min("open_time").alias("first"), F.max("open_time").alias("last"))
    return per.groupBy("timeframe").agg(F.max("first").alias("window_start"), (F.min("last") + interval_ms).alias("window_end"), F.count("*").alias("series_count"))


def restricted(candles: DataFrame, window: DataFrame) -> DataFrame:
    """Candles inside their timeframe's common window."""
    inside = candles.join(F.broadcast(window.select("timeframe", "window_start", "window_end")), "timeframe")
    return inside.where((F.col("open_time") >= F.col("window_start")) & (F.col("open_time") < F.col("window_end"))).select(*candles.columns)
