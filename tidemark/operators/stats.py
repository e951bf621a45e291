"""Exact statistics that differ in small print: robust scales, weighted quantiles, average ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import clip
from tidemark.operators.ranks import LOCAL_ROWS, by_value, quantiles, running

#: makes the median absolute deviation of normal data their standard deviation (fixed value)
MAD_TO_STD = 1.4826


def long(df: DataFrame, columns: Sequence[str], *keys: str) -> DataFrame:
    """(keys, name, value): one row per row and column."""
    return df.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns))).alias("_x")).select(*keys, "_x.name", "_x.value")


def robust_scales(values: DataFrame, variant: str = "first_usable", *by: str, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(by, name, center, scale) of long values, NULLs left out. Two passes, because deviations need the median.

    first_usable: scaled MAD above 1e-12, else the standard deviation above 1e-12, else 1;
    largest: the largest of scaled MAD, standard deviation and 1e-6;
    raw: MAD unscaled above 1e-12, else the standard deviation above 1e-12, else 1.
    """
    keys = [*by, "name"]
    middle = quantiles(values, keys, "value", [0.5], local_rows).withColumnRenamed("q0", "center")
    center = middle.join(values.groupBy(*keys).agg(F.stddev_pop("value").alias("spread")), keys)
    off = values.join(center.select(*keys, "center"), keys).select(*keys, F.abs(F.col("value") - F.col("center")).alias("off"))
    mad = center.join(quantiles(off, keys, "off", [0.5], local_rows).withColumnRenamed("q0", "mad"), keys)
    scaled = F.col("mad") * (1.0 if variant == "raw" else MAD_TO_STD)
    if variant == "largest":
        scale = F.greatest(scaled, F.col("spread"), F.lit(1e-6))
    elif variant in ("first_usable", "raw"):
        scale = F.when(scaled > 1e-12, scaled).when(F.col("spread") > 1e-12, F.col("spread")).otherwise(1.0)
    else:
        raise ValueError(f"no such variant: {variant}")
    return mad.select(*keys, "center", scale.alias("scale"))


def iqr_scales(values: DataFrame, *by: str) -> DataFrame:
    """(by, name, center, scale): median and interquartile range, 1 where that is not above 1e-9."""
    width = F.col("q2") - F.col("q0")
    return quantiles(values, [*by, "name"], "value", [0.25, 0.5, 0.75]).select(*by, "name", F.col("q1").alias("center"), F.when(width > 1e-9, width).otherwise(1.0).alias("scale"))


def scaled(values: DataFrame, scales: DataFrame, limit: float, *by: str) -> DataFrame:
    """Long values as (value - center) / scale, held within +-limit; a missing value stands at the center."""
    z = clip(F.coalesce((F.col("value") - F.col("center")) / F.col("scale"), F.lit(0.0)), -limit, limit)
    return values.join(scales, [*by, "name"]).withColumn("value", z).drop("center", "scale")


def block_scaled(values: DataFrame, limit: float = 8.0) -> DataFrame:
    """Columns of one block scaled robustly and divided by the root of their number, so blocks weigh alike whatever their width."""
    scales = robust_scales(values).select("name", "center", F.col("scale"))
    width = values.select("name").distinct().agg(F.count("*").alias("_n"))
    return scaled(values, scales, limit).join(F.broadcast(width)).withColumn("value", F.col("value") / F.sqrt("_n")).drop("_n")


def effective_n(weights: DataFrame, *by: str) -> DataFrame:
    total = F.sum("weight")
    return weights.groupBy(*by).agg((total * total / F.greatest(F.sum(F.col("weight") * F.col("weight")), F.lit(1e-12))).alias("effective_n"))


def weighted_quantile_step(values: DataFrame, q: float, by: Sequence[str], local_rows: int = LOCAL_ROWS) -> DataFrame:
    """The first value, in order, at which the weights reach q of their sum."""
    sums = values.where("value IS NOT NULL").groupBy(*by, "value").agg(F.sum("weight").alias("weight"))
    run = running(sums, by, ["value"], "weight", local_rows=local_rows)
    return run.where(F.col("_before") + F.col("weight") >= q * F.col("_all")).groupBy(*by).agg(F.min("value").alias("quantile"))


def weighted_quantile_linear(values: DataFrame, q: float, by: Sequence[str], order: str, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """Linear between the values' cumulative shares of weight, held at the first and the last value. Ties of value fall in the order of `order`."""
    run = running(values.where("value IS NOT NULL"), by, ["value", order], "weight", "value", local_rows)
    run = run.withColumn("_share", (F.col("_before") + F.col("weight")) / F.col("_all")).withColumn("_left", F.when(F.col("_previous").isNotNull(), F.col("_before") / F.col("_all")))
    inside = F.col("_previous") + (q - F.col("_left")) / (F.col("_share") - F.col("_left")) * (F.col("value") - F.col("_previous"))
    at = F.when(F.col("_left").isNull() | (F.col("_share") <= F.col("_left")), F.col("value")).otherwise(inside)
    key = F.struct("_share", "value", order)
    reached = F.min_by(F.when(F.col("_share") >= q, at), F.when(F.col("_share") >= q, key))
    # sums of weights can end a little below one
    return run.groupBy(*by).agg(F.coalesce(reached, F.max("value")).alias("quantile"))


def auc(scored: DataFrame, *by: str, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """Area under the ROC curve of (label 0/1, score), ties counted half; NULL where a class is missing."""
    placed = by_value(scored, by, "score", F.sum(F.col("label").cast("double")).alias("positive"), local_rows=local_rows)
    n1 = F.sum("positive")
    n0 = F.sum("n") - n1
    ranks = F.sum(F.col("positive") * (F.col("_before") + (F.col("n") + 1) / 2.0))
    return placed.groupBy(*by).agg(F.try_divide(ranks - n1 * (n1 + 1) / 2, n1 * n0).alias("auc"))
