"""Places, running sums and exact quantiles of groups of any size.

A window over a group puts the whole group into one task. Here that is only done where the largest group has at most
LOCAL_ROWS rows, which is checked. Beyond it rows are dealt by ranges of (group, order): each range is summed on its
own, the sums of a group's ranges are added up over a table of one row per group and range, and every row gets its
range's offset. The results are the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.storage import stored

LOCAL_ROWS = 1_000_000


def running(rows: DataFrame, by: Sequence[str], order: Sequence[str], weight: str | None = None, previous: str | None = None, local_rows: int = LOCAL_ROWS, latest: str | None = None) -> DataFrame:
    """rows with `_before`, the sum of `weight` (rows, if None) over the earlier rows of its group, and `_all`, that of the group.

    previous: a column whose value in the row before is wanted as `_previous`, NULL in a group's first row; latest: one
    whose last value that is not NULL in the rows before is wanted as `_latest`. Rows equal in `order` come in any
    order. A NULL in `by` is a group of its own.
    """
    by, order = list(by), list(order)
    one = F.lit(1).cast("long") if weight is None else F.col(weight)
    largest = rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    keys = by if by else [F.lit(0)]
    if largest <= local_rows:
        group = Window.partitionBy(*keys)
        out = _inside(rows, group.orderBy(*order), one, previous, latest)
        return out.withColumn("_all", F.sum(one).over(group))

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.repartitionByRange(max(parts, 2), *by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    at = F.struct(*order)
    sums = dealt.groupBy("_part", *by).agg(F.sum(one).alias("_sum"), *([F.max_by(previous, at).alias("_last")] if previous else []), *([F.max_by(latest, F.when(F.col(latest).isNotNull(), at)).alias("_held")] if latest else []))
    # one row per group and range
    ranges = Window.partitionBy(*keys).orderBy("_part")
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_sum").over(Window.partitionBy(*keys)))
    if previous:
        offsets = offsets.withColumn("_last", F.lag("_last").over(ranges))
    if latest:
        offsets = offsets.withColumn("_held", F.last("_held", ignorenulls=True).over(ranges.rowsBetween(Window.unboundedPreceding, -1)))
    offsets = offsets.drop("_sum").select(*(F.col(c).alias(f"_of_{c}") for c in ["_part", *by]), "_offset", "_all", *(["_last"] if previous else []), *(["_held"] if latest else []))
    out = _inside(dealt, Window.partitionBy("_part", *by).orderBy(*order), one, previous, latest)
    same = F.lit(True)
    for c in ["_part", *by]:
        same = same & out[c].eqNullSafe(F.col(f"_of_{c}"))
    out = out.join(offsets, same).withColumn("_before", F.col("_before") + F.col("_offset"))
    if previous:
        # only a range's first row lacks one
        out = out.withColumn("_previous", F.when(F.col("_first"), F.col("_last")).otherwise(F.col("_previous"))).drop("_last")
    if latest:
        out = out.withColumn("_latest", F.coalesce("_latest", "_held")).drop("_held")
    return out.drop("_offset", "_part", "_first", *(f"_of_{c}" for c in ["_part", *by]))


def _inside(rows: DataFrame, order: Window, one, previous: str | None, latest: str | None = None) -> DataFrame:
    out = rows.withColumn("_before", F.coalesce(F.sum(one).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if previous:
        out = out.withColumn("_previous", F.lag(previous).over(order)).withColumn("_first", F.row_number().over(order) == 1)
    if latest:
        out = out.withColumn("_latest", F.last(latest, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    return out


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, value: str, key: str, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(key, value): for each row of left (unique in `key`) the value of the last row of right strictly before it, NULL where there is none.

    Both sides are one list in the order of time, so no row meets more than its neighbours, however long a series is.
    Of several rows of right at one time the largest value counts.
    """
    at = F.struct(F.col(right_time).alias("t"), F.col(value).alias("v"))
    rows = right.groupBy(*by, right_time).agg(F.max(value).alias(value)).select(*by, F.col(right_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(left.schema[key].dataType).alias(key), at.alias("_at"))
    asked = left.select(*by, F.col(left_time).alias("_t"), F.lit(0).alias("_side"), key, F.lit(None).cast(rows.schema["_at"].dataType).alias("_at"))
    # at one time those who ask come first, so only what is earlier is seen
    found = running(rows.unionByName(asked), by, ["_t", "_side"], latest="_at", local_rows=local_rows)
    return found.where("_side = 0").select(key, F.col("_latest.v").alias(value))


def by_value(rows: DataFrame, by: Sequence[str], value: str, *sums, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(by, value, n, sums, _before, _all): the distinct values of each group with how many rows have them; NULL values are left out."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), *sums)
    return running(counts, by, [value], "n", local_rows=local_rows)


def ranked(rows: DataFrame, by: Sequence[str], value: str, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """rows with `rank` (from 1, ties sharing the mean of their places), `percent_rank` (rank over the group's size) and `percentile` (the share of rows not above).

    All three are NULL where the value is.
    """
    places = by_value(rows, by, value, local_rows=local_rows).select(*(F.col(c).alias(f"_of_{c}") for c in [*by, value]), "n", "_before", "_all")
    same = rows[value] == F.col(f"_of_{value}")
    for c in by:
        same = same & rows[c].eqNullSafe(F.col(f"_of_{c}"))
    rank = F.col("_before") + (F.col("n") + 1) / 2.0
    out = rows.join(places, same, "left").withColumn("rank", rank).withColumn("percent_rank", rank / F.col("_all")).withColumn("percentile", (F.col("_before") + F.col("n")) / F.col("_all"))
    return out.select(*rows.columns, "rank", "percent_rank", "percentile")


def quantiles(rows: DataFrame, by: Sequence[str], value: str, qs: Sequence[float], local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(by, q0, q1, ..): exact quantiles of a column, linear between neighbours; NULLs are left out, a group of NULLs has none."""
    kept = rows.where(F.col(value).isNotNull())
    by = list(by)
    largest = kept.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= local_rows:
        return kept.groupBy(*by).agg(*(F.percentile(value, q).alias(f"q{k}") for k, q in enumerate(qs)))
    placed = by_value(kept, by, value, local_rows=local_rows)

    def read(q: float):
        spot = F.lit(q) * (F.col("_all") - 1)
        # ends of the gap that the quantile lies in
        at = lambda place: F.max(F.when((F.col("_before") <= place) & (place < F.col("_before") + F.col("n")), F.col(value)))
        low = F.floor(spot)
        return at(low) + (F.max(spot) - F.max(low)) * (at(F.ceil(spot)) - at(low))

    return placed.groupBy(*by).agg(*(read(q).alias(f"q{k}") for k, q in enumerate(qs)))
