"""Column functions that several operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ("asset", "timeframe")


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero: what is not finite is missing."""
    return F.try_divide(a, b)


def mirrored_pct(price: Column, target: Column, sign: Column) -> Column:
    """Distance of a price from a target in percent, positive on the side that the sign points to."""
    return sign * (ratio(price, target) - 1.0) * 100.0


def log_distance(left: Column, right: Column, floor: float) -> Column:
    """|ln| of the ratio of two amounts, both held at zero from below and moved up by `floor`."""
    zero = F.lit(0.0)
    return F.abs(F.ln((F.greatest(left, zero) + floor) / (F.greatest(right, zero) + floor)))


def factor_distance(value: Column, target: Column, factor: float) -> Column:
    """How many times `factor` lies between two amounts."""
    least = F.lit(1e-12)
    return F.abs(F.ln(F.greatest(value, least) / F.greatest(target, least)) / F.ln(F.lit(factor)))


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


def missing_as_zero(value: Column) -> Column:
    return F.coalesce(F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value), F.lit(0.0))


def floor_to(value: Column, step: int) -> Column:
    return value - F.pmod(value, F.lit(step))


def epoch_ms(value: Column) -> Column:
    """Milliseconds from an epoch that may be in microseconds."""
    return F.when(value >= 100_000_000_000_000, F.floor(value / 1000)).otherwise(value).cast("long")


def iso_utc(ms: Column) -> Column:
    """Whole seconds as ISO-8601 with Z; counts from the epoch itself, so the session's zone does not matter."""
    second = F.floor(ms / 1000).cast("long")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(second / 86400).cast("int"))
    rest = F.pmod(second, F.lit(86400))
    return F.format_string("%sT%02d:%02d:%02dZ", day.cast("string"), F.floor(rest / 3600).cast("long"), F.floor(F.pmod(rest, F.lit(3600)) / 60).cast("long"), F.pmod(rest, F.lit(60)))


def _day(ms: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86_400_000).cast("int"))


def _day_ms(day: Column) -> Column:
    return F.date_diff(day, F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000


def months_before(ms: Column, months: int) -> Column:
    """The same time so many calendar months earlier; a day that month lacks is its last one. Twelve a year, so Feb 29 becomes Feb 28."""
    return _day_ms(F.add_months(_day(ms), -months)) + F.pmod(ms, F.lit(86_400_000))


def month_start(ms: Column, later: int = 0) -> Column:
    """When the month of a time began, or one `later` months on."""
    return _day_ms(F.add_months(F.trunc(_day(ms), "month"), later))


def bucketed(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """The label of the right-open interval that a value lies in; one label more than edges."""
    out = F.when(value < edges[0], labels[0])
    for edge, label in zip(edges[1:], labels[1:]):
        out = out.when(value < edge, label)
    return out.when(value.isNotNull(), labels[-1])


# The groups that errors are reported by.
AGE_EDGES, AGE_LABELS = (60, 360, 1_440, 10_080, 43_200), ("under_1h", "1h_6h", "6h_1d", "1d_7d", "7d_30d", "over_30d")
DISTANCE_EDGES, DISTANCE_LABELS = (1, 3, 7, 15, 30), ("under_1pct", "1_3pct", "3_7pct", "7_15pct", "15_30pct", "over_30pct")


def age_group(minutes: Column) -> Column:
    return bucketed(minutes, AGE_EDGES, AGE_LABELS)


def distance_group(pct: Column) -> Column:
    return bucketed(pct, DISTANCE_EDGES, DISTANCE_LABELS)


def age_bucket(bars: Column, buckets: Sequence[tuple[int, int, str]]) -> Column:
    """The label of the closed interval (first, last, label) that an age lies in; an age in none is an error."""
    out = F.raise_error(F.concat(F.lit("no bucket for the age "), F.coalesce(bars.cast("string"), F.lit("NULL")))).cast("string")
    for first, last, label in reversed(buckets):
        out = F.when(bars.between(first, last), label).otherwise(out)
    return out


def age_support(bars: Column, sampled: Sequence[int]) -> Column:
    """(status, lower, upper): whether an age is one of those that were sampled, lies between two, or outside; unknown where none was."""
    ages = F.array(*(F.lit(int(a)) for a in sorted({a for a in sampled if a > 0}))).cast("array<int>")
    lower, upper = F.array_max(F.filter(ages, lambda a: a <= bars)), F.array_min(F.filter(ages, lambda a: a >= bars))
    status = F.when(F.size(ages) == 0, "unknown").when(lower == upper, "exact_sampled_age").when(lower.isNotNull() & upper.isNotNull(), "between_sampled_ages").otherwise("outside_sampled_age")
    return F.struct(status.alias("status"), lower.alias("lower"), upper.alias("upper"))


def tertile(percent_rank: Column, labels: tuple[str, str, str] = ("low", "middle", "high")) -> Column:
    """Thirds of an average percent rank; both inner edges belong to the lower third."""
    return F.when(percent_rank <= 1 / 3, labels[0]).when(percent_rank <= 2 / 3, labels[1]).when(percent_rank.isNotNull(), labels[2])


def slug(number: float) -> str:
    """5.0 -> 5, 2.5 -> 2p5."""
    return f"{number:g}".replace(".", "p")


def average_rank(value: Column, partition: Sequence[str | Column] = ()) -> Column:
    """Rank from 1, ties sharing the mean of their places."""
    one = Window.partitionBy(*partition)
    return F.rank().over(one.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*partition, value)) - 1) / 2.0


def average_percent_rank(value: Column, partition: Sequence[str | Column] = ()) -> Column:
    return average_rank(value, partition) / F.count(F.lit(1)).over(Window.partitionBy(*partition))


def overlapped(candles: DataFrame, bars: int, block: int = 8192) -> DataFrame:
    """candles by `_block` of `block` bars, each with the `bars` bars before it, for which `_own` is false.

    A window over (series, _block) then sees all that it looks back on, and one long series is many partitions. A block
    is no shorter than the look-back, so a bar is in two blocks at most.
    """
    block = max(block, bars)
    own = F.expr(f"bar_index div {block}")
    late = F.pmod("bar_index", F.lit(block)) >= block - bars
    to = F.when(late, F.array(F.struct(own.alias("b"), F.lit(True).alias("o")), F.struct((own + 1).alias("b"), F.lit(False).alias("o")))).otherwise(F.array(F.struct(own.alias("b"), F.lit(True).alias("o"))))
    return candles.withColumn("_to", F.explode(to)).withColumns({"_block": F.col("_to.b"), "_own": F.col("_to.o")}).drop("_to")


def single(df: DataFrame, what: str) -> DataFrame:
    """df, with an error when it is read if it has more than one row: `what` must be one."""
    return df.limit(2).withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))).where(F.when(F.col("_rows") > 1, F.raise_error(F.lit(f"there must be one {what}")).cast("boolean")).otherwise(F.lit(True))).drop("_rows")


def rounded(df, digits: int = 6):
    """Every double rounded: what is compared with another engine carries no float noise. -0.0 is 0.0."""
    return df.select(*((F.round(F.col(f"`{c}`"), digits) + 0.0).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes))
