"""How good forecasts are: Brier scores, calibration, balanced errors, subgroups, bootstrap and selection."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def brier(scored: DataFrame, *by: str) -> DataFrame:
    """(label, score): Brier score, that of the group's own rate, and the skill over it."""
    miss = F.avg(F.pow(F.col("score") - F.col("label"), 2))
    rate = F.avg(F.col("label").cast("double"))
    return scored.groupBy(*by).agg(F.count("*").alias("n"), rate.alias("positive_rate"), miss.alias("brier")).withColumn("base_brier", F.col("positive_rate") * (1.0 - F.col("positive_rate"))).withColumn("skill", 1.0 - F.try_divide(F.col("brier"), F.col("base_brier")))


def calibration_bins(scored: DataFrame, bins: int = 5, *by: str) -> DataFrame:
    """Mean score and observed rate in equal bins of [0, 1]; 1 belongs to the last. Empty bins have no row."""
    at = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg(F.col("label").cast("double")).alias("observed_rate"))


def balanced_mean(rows: DataFrame, value: Column, episode: str, *by: str) -> DataFrame:
    """Mean of the episodes' means: an episode with many rows counts once."""
    per = rows.groupBy(*by, episode).agg(F.avg(value).alias("_m"))
    return per.groupBy(*by).agg(F.avg("_m").alias("balanced_mean"), F.count("*").alias("episodes"))


def balanced_ece(scored: DataFrame, episode: str, bins: int = 10) -> DataFrame:
    """Expected calibration error in which every episode weighs one."""
    weighted = scored.withColumn("_w", 1.0 / F.count(F.lit(1)).over(Window.partitionBy(episode)))
    at = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))
    per = weighted.groupBy(at.alias("bin")).agg(F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("score")).alias("s"), F.sum(F.col("_w") * F.col("label")).alias("y"))
    return per.agg((F.sum(F.abs(F.col("s") - F.col("y"))) / F.sum("w")).alias("ece"))


def subgroups(scored: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Error by each column of `groups` alone and over all, in one pass over the data."""
    name, value = F.lit("all"), F.lit("all")
    expanded = scored.withColumn("_error", F.pow(F.col("score") - F.col("label"), 2))
    sets = [[F.col(g)] for g in groups] + [[]]
    rows = expanded.groupingSets(sets, *(F.col(g) for g in groups)).agg(*(F.grouping(g).alias(f"_g_{g}") for g in groups), F.count("*").alias("n"), F.avg("_error").alias("brier"))
    for g in groups:
        name, value = F.when(F.col(f"_g_{g}") == 0, g).otherwise(name), F.when(F.col(f"_g_{g}") == 0, F.col(g).cast("string")).otherwise(value)
    return rows.select(name.alias("subgroup"), value.alias("value"), "n", "brier")


def interval_error(lower: Column, upper: Column, forecast: Column) -> Column:
    """0 inside the interval, else the distance to its nearer end."""
    return F.greatest(lower - forecast, forecast - upper, F.lit(0.0))


def pinball(value: Column, forecast: Column, q: float) -> Column:
    return F.greatest(q * (value - forecast), (q - 1) * (value - forecast))


def value_shares(rows: DataFrame, column: str, *by: str) -> DataFrame:
    """(by, column, n, share): how often each value stands, NULL values left out."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*(by or [F.lit(0)]))))


def paired(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, a, b) of two sets of predictions; an error where a key stands twice or only once."""
    both = a.groupBy(key).agg(F.count("*").alias("_na"), F.max(value).alias("a")).join(b.groupBy(key).agg(F.count("*").alias("_nb"), F.max(value).alias("b")), key, "full")
    single = (F.col("_na") == 1) & (F.col("_nb") == 1)
    return both.where(F.when(F.coalesce(single, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit("predictions do not pair")).cast("boolean"))).select(key, "a", "b")


def by_mode(rows: DataFrame, key: str | Sequence[str], mode: str, value: str, modes: Sequence[str]) -> DataFrame:
    """One row per key with the smallest value of each mode as a column; keys that lack a mode are left out."""
    return rows.groupBy(key).pivot(mode, list(modes)).agg(F.min(value)).dropna(subset=list(modes))


def quantile_calibration(rows: DataFrame, actual: str, forecasts: dict[float, str], *by: str) -> DataFrame:
    """(by, n, coverage_<q> and pinball_<q> for every quantile, interval_coverage, median_error) of quantile forecasts."""
    qs = sorted(forecasts)
    low, high, middle = forecasts[qs[0]], forecasts[qs[-1]], forecasts[min(qs, key=lambda q: abs(q - 0.5))]
    share = lambda test: F.avg(test.cast("double"))
    cover = [share(F.col(actual) <= F.col(forecasts[q])).alias(f"coverage_{round(q * 100)}") for q in qs]
    loss = [F.avg(pinball(F.col(actual), F.col(forecasts[q]), q)).alias(f"pinball_{round(q * 100)}") for q in qs]
    inside = share(F.col(actual).between(F.col(low), F.col(high))).alias("interval_coverage")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *cover, *loss, inside, F.percentile(F.abs(F.col(actual) - F.col(middle)), 0.5).alias("median_error"))


# quantiles of a Poisson distribution of mean one (fixed values): cumulative probabilities of 0 to 5
_POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)


#: a multiplicative generator modulo a prime (fixed values): plain whole numbers, so that any engine can repeat the draws
PRIME, FACTOR = 2**31 - 1, 48_271


def draw_factors(draws: int) -> list[int]:
    """By what an episode's number is multiplied in each draw."""
    return [pow(FACTOR, k, PRIME) for k in range(1, draws + 1)]


def paired_bootstrap(paired: DataFrame, episode: str, a: str, b: str, draws: int = 500, seed: int = 7) -> DataFrame:
    """Relative gain of b over a by episode-balanced means: estimate and 95 % interval from Poisson bootstrap weights.

    Each episode draws its weights from a number that follows from its MD5, so reruns agree. A task sums its episodes
    for all draws at once; no resample is laid out as rows.
    """
    per = paired.groupBy(episode).agg(F.avg(a).alias("a"), F.avg(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    factors = np.array(draw_factors(draws), np.int64)

    def summed(batches):
        total = np.zeros((draws + 1, 2))
        for batch in batches:
            for piece in (batch.slice(k, 4096) for k in range(0, batch.num_rows, 4096)):
                spot = (piece.column(0).to_numpy()[:, None] * factors[None] % PRIME) / float(PRIME)
                weight = np.ones((len(spot), draws + 1))
                weight[:, 1:] = np.searchsorted(_POISSON, spot, side="right")
                total += weight.T @ np.column_stack([piece.column(1).to_numpy(), piece.column(2).to_numpy()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws + 1, dtype=np.int32)), pa.array(total[:, 0]), pa.array(total[:, 1])], ["draw", "a", "b"])

    number = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(episode).cast("string")).cast("binary")), 1, 12), 16, 10).cast("long"), F.lit(PRIME - 1)) + 1
    sums = per.select(number.alias("h"), "a", "b").mapInArrow(summed, "draw int, a double, b double")
    gains = sums.groupBy("draw").agg((1.0 - F.try_divide(F.sum("b"), F.sum("a"))).alias("gain"))
    return gains.agg(F.max(F.when(F.col("draw") == 0, F.col("gain"))).alias("gain"), F.percentile(F.when(F.col("draw") > 0, F.col("gain")), 0.025).alias("low"), F.percentile(F.when(F.col("draw") > 0, F.col("gain")), 0.975).alias("high"))


def selected(metrics: DataFrame, columns: Sequence[str], tie: str = "config") -> DataFrame:
    """Configurations (one row each) by the mean of their ranks in every metric, smaller is better; ties share ranks, then go by name."""
    from tidemark.functions.columns import average_rank

    ranks = metrics.select(tie, *columns, *(average_rank(F.col(c), (F.lit(0),)).alias(f"_r_{c}") for c in columns))
    total = sum((F.col(f"_r_{c}") for c in columns), F.lit(0.0)) / float(len(columns))
    ranked = ranks.withColumn("mean_rank", total)
    return ranked.withColumn("selected", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("mean_rank", tie)) == 1).select(tie, *columns, "mean_rank", "selected")


def within_tolerance(metrics: DataFrame, baseline: str, columns: Sequence[str], worst_ratio: float, tie: str = "config") -> DataFrame:
    """Configurations whose every metric is at most `worst_ratio` times the baseline's."""
    base = metrics.where(F.col(tie) == baseline).select(*(F.col(c).alias(f"_b_{c}") for c in columns))
    test = F.lit(True)
    for c in columns:
        test = test & (F.col(c) <= F.col(f"_b_{c}") * worst_ratio)
    return metrics.crossJoin(F.broadcast(base)).withColumn("passes", test).select(tie, *columns, "passes")
