"""Chronological splits, folds and samples: nothing is learnt from what was not yet known."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import months_before
from tidemark.functions.storage import stored
from tidemark.operators.ranks import running
from tidemark.sources.candles import ContractError


def chrono_split(rows: DataFrame, time: str, train: float = 0.6, validate: float = 0.2) -> DataFrame:
    """rows with `part`: train, validation or test by distinct times, so that one moment is never in two parts."""
    times = running(rows.select(time).distinct(), [], [time])
    place, n = F.col("_before"), F.col("_all")
    part = F.when(place < F.floor(n * train), "train").when(place < F.floor(n * (train + validate)), "validation").otherwise("test")
    return rows.join(times.select(time, part.alias("part")), time)


def holdout_split(rows: DataFrame, holdout_months: int, embargo_ms: int, time: str = "signal_open_ms", resolved: str = "fill_close_ms") -> DataFrame:
    """rows with `part`: holdout from the last signal less so many calendar months on; train where all was resolved `embargo_ms` before that.

    Rows between the two are left out, so nothing that is learnt was still open when the holdout began.
    """
    last = rows.agg(F.max(time).alias("last"))
    start = last.select(months_before(F.col("last"), holdout_months).alias("_start"))
    both = rows.crossJoin(F.broadcast(start))
    part = F.when(F.col(time) >= F.col("_start"), "holdout").when(F.col(resolved) <= F.col("_start") - embargo_ms, "train")
    return both.withColumn("part", part).where("part IS NOT NULL").drop("_start")


def calibration_tail(rows: DataFrame, share: float, horizon_ms: int, time: str = "signal_open_time", known: str = "entry_close_time", observed: str = "fully_observed") -> DataFrame:
    """rows with `part`: calibration for the last `share` of distinct times, history for what was known before the first of these closed.

    Only rows whose largest horizon was seen whole take part.
    """
    times = running(rows.select(time).distinct(), [], [time])
    boundary = times.where(F.col("_before") == F.greatest(F.floor(F.col("_all") * (1.0 - share)), F.lit(1))).select(F.col(time).alias("_boundary"))
    both = rows.where(F.col(observed)).crossJoin(F.broadcast(boundary))
    first = both.where(F.col(time) >= F.col("_boundary")).agg(F.min(known).alias("_first"))
    part = F.when(F.col(time) >= F.col("_boundary"), "calibration").when(F.col(known) + horizon_ms <= F.col("_first"), "history")
    return both.crossJoin(F.broadcast(first)).withColumn("part", part).where("part IS NOT NULL").drop("_boundary", "_first")


def rolling_folds(spark: SparkSession, begin_ms: int, end_ms: int, train_ms: int, window_ms: int, step_ms: int, embargo_ms: int) -> DataFrame:
    """(fold, test_start, test_end): windows after the first training span, the last one ending `embargo_ms` before the data do."""
    last = end_ms - embargo_ms - window_ms
    first = begin_ms + train_ms
    n = max(0, (last - first) // step_ms + 1) if last >= first else 0
    return spark.range(n).select(F.col("id").cast("int").alias("fold"), (F.lit(first) + F.col("id") * step_ms).alias("test_start"), (F.lit(first) + F.col("id") * step_ms + window_ms).alias("test_end"))


def eligible_history(observed: DataFrame, folds: DataFrame, horizon_ms: int, time: str = "signal_open_time", known: str = "entry_close_time") -> DataFrame:
    """(fold, role, id columns): queries inside each window; history whose whole horizon had passed when the window began."""
    # folds are few; a range condition on them needs no shuffle of the observations
    pairs = observed.join(F.broadcast(folds), F.col(time) < F.col("test_end"))
    role = F.when(F.col(time) >= F.col("test_start"), "query").when(F.col(known) + horizon_ms <= F.col("test_start"), "history")
    return pairs.withColumn("role", role).where("role IS NOT NULL")


def evenly_spaced(rows: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """n rows at even distances in the order, the first and the last among them; all rows if there are not more."""
    at = running(rows, [], order).withColumnRenamed("_before", "_i").withColumnRenamed("_all", "_n")
    k = F.ceil(F.col("_i") * (n - 1) / (F.col("_n") - 1))
    hit = F.floor(k * (F.col("_n") - 1) / F.lit(n - 1)) == F.col("_i")
    return at.where((F.col("_n") <= n) | (hit & (k < n))).drop("_i", "_n")


def stratified_sample(rows: DataFrame, n: int, strata: Sequence[str | Column], order: Sequence[str]) -> DataFrame:
    """About n rows: the same number of each stratum, evenly spaced by rank with halves rounded to even; missing ones come from the rest in order."""
    keys = [f"_s{k}" for k in range(len(strata))]
    named = rows.withColumns({k: F.col(s) if isinstance(s, str) else s for k, s in zip(keys, strata)})
    groups = named.select(*keys).distinct().agg(F.greatest(F.floor(F.try_divide(F.lit(n), F.count("*"))), F.lit(1)).alias("_quota"))
    at = running(named, keys, order).withColumnRenamed("_before", "_i").withColumnRenamed("_all", "_n").crossJoin(F.broadcast(groups))
    spots = F.transform(F.sequence(F.lit(0), (F.least("_quota", "_n") - 1).cast("int")), lambda k: F.when(F.least("_quota", "_n") > 1, F.rint(k * (F.col("_n") - 1) / (F.least("_quota", "_n") - 1))).otherwise(0.0))
    taken = at.withColumn("_hit", F.array_contains(spots, F.col("_i").cast("double")))
    # every task keeps its first n before the last ranking
    return taken.orderBy(F.desc("_hit"), *order).limit(n).drop(*keys, "_i", "_n", "_quota", "_hit")


def spread(rows: DataFrame, most, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of each group at most `most` rows (a number or a column of the group), at even distances in the order, ends kept; one is the first."""
    at = running(rows.withColumn("_most", most if isinstance(most, Column) else F.lit(most)), by, order).withColumnRenamed("_before", "_i").withColumnRenamed("_all", "_n")
    m = F.least("_most", "_n")
    k = F.ceil(F.try_divide(F.col("_i") * (m - 1), F.col("_n") - 1))
    hit = F.when(m > 1, (F.floor(k * (F.col("_n") - 1) / (m - 1)) == F.col("_i")) & (k < m)).otherwise((m == 1) & (F.col("_i") == 0))
    return at.where(F.when(F.col("_n") <= F.col("_most"), F.lit(True)).otherwise(hit)).drop("_most", "_i", "_n")


def stratified_cap(rows: DataFrame, most: int, strata: Sequence[str], order: Sequence[str], key: Sequence[str]) -> DataFrame:
    """At most `most` rows: an equal quota of each stratum, evenly spaced, then evenly spaced ones of the rest until it is full.

    key: columns that name a row. Where strata alone exceed the cap, what they chose is spaced once more.
    """
    n = rows.count()
    if n <= most:
        return rows
    groups = rows.select(*strata).distinct().count()
    chosen = stored(spread(rows, max(1, most // groups), strata, order), "cap-strata")
    held = chosen.count()
    if held > most:
        return spread(chosen, most, [], order)
    if held == most:
        return chosen
    rest = rows.join(chosen.select(*(F.col(c).alias(f"_k_{c}") for c in key)), reduce(and_, (F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in key)), "left_anti")
    return chosen.unionByName(spread(rest, most - held, [], order).select(*chosen.columns))


def age_balanced_weights(rows: DataFrame, episode: str, bucket: str) -> DataFrame:
    """rows with `weight`: every age bucket weighs alike, and in it every episode, whatever its number of rows; the mean weight is 1."""
    per = rows.groupBy(bucket, episode).agg(F.count("*").alias("_rows"))
    buckets = per.groupBy(bucket).agg(F.count("*").alias("_episodes"))
    # the sum over a bucket is 1, so the mean follows from two counts
    mean = buckets.agg(F.count("*").alias("_b")).crossJoin(rows.agg(F.count("*").alias("_n")))

    def joined(left: DataFrame, right: DataFrame, *names: str) -> DataFrame:
        other = right.select(*(F.col(c).alias(f"_{c}_") if c in names else F.col(c) for c in right.columns))
        return left.join(other, reduce(and_, (F.col(f"_{c}_").eqNullSafe(F.col(c)) for c in names))).drop(*(f"_{c}_" for c in names))

    both = joined(joined(rows, per, bucket, episode), buckets, bucket)
    out = both.crossJoin(F.broadcast(mean)).withColumn("weight", 1.0 / (F.col("_rows") * F.col("_episodes")) / (F.col("_b") / F.col("_n")))
    return out.drop("_rows", "_episodes", "_b", "_n")


def require_disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    """An error if a key stands in both: what is learnt from must not be asked about."""
    both = a.select(key).join(b.select(key), key, "left_semi").limit(3).collect()
    if both:
        raise ContractError(f"in both parts: {', '.join(str(r[0]) for r in both)}")


def require_known(rows: DataFrame, column: str, known: Sequence[str]) -> None:
    """An error if a column holds another value than these; NULL is one."""
    odd = rows.where(~F.coalesce(F.col(column).isin(*known), F.lit(False))).select(column).distinct().limit(3).collect()
    if odd:
        raise ContractError(f"unknown {column}: {', '.join(str(r[0]) for r in odd)}")


def episode_weights(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn("weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy(key)))
