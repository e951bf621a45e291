"""Real continuations brought to a live signal's scale: scenarios, projected candles, envelopes and rerankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import average_percent_rank, single
from tidemark.operators.stats import MAD_TO_STD

# With others other scenarios are chosen.
DURATION_WEIGHT, MOVE_WEIGHT = 0.55, 0.45
FAST, EXTREME = 0.25, 0.90
#: how much the rank of the match counts beside the place in the cohort, and beside the distance to its middle
RANK_SHARE, MIDDLE_RANK_SHARE = 0.18, 0.20
LEAST_COHORT = 12


def projected_moves(matched: DataFrame, live: DataFrame) -> DataFrame:
    """matched with the scale from each episode to the live move, the future peak in live units and the loss it means from the live price.

    live: one row with current_move_pct and direction_sign.
    """
    return projected_by_query(matched.crossJoin(F.broadcast(single(live.select(F.col("current_move_pct").alias("q_move"), F.col("direction_sign").alias("q_sign")), "live state"))))


def projected_by_query(rows: DataFrame) -> DataFrame:
    """As `projected_moves`, for matches that carry their own live state in q_move and q_sign."""
    scale = F.try_divide(F.col("q_move"), F.col("current_move_pct"))
    far = F.greatest(F.col("future_peak_move_pct"), F.lit(0.0))
    rows = rows.withColumn("scale", scale).withColumn("historical_future_pct", far).withColumn("projected_future_pct", F.greatest(far * scale, F.lit(0.0)))
    loss = F.greatest(F.col("projected_future_pct") - F.col("q_move"), F.lit(0.0)) * 100.0 / (100.0 + F.col("q_sign") * F.col("q_move"))
    return rows.withColumn("projected_adverse_pct", loss).drop("q_move", "q_sign")


def _cohort(projected: DataFrame, keys: Sequence) -> DataFrame:
    """The k matches of each query with their joint rank, its percentile and the distance to the cohort's middle. Small by construction: at most k rows."""
    rows = projected.withColumn("_duration", F.log1p(F.col("remaining_bars").cast("double"))).withColumn("_move", F.col("projected_future_pct"))
    joint = DURATION_WEIGHT * average_percent_rank(F.col("_duration"), keys) + MOVE_WEIGHT * average_percent_rank(F.col("_move"), keys)
    rows = rows.withColumn("joint_risk", F.round(joint, 12)).withColumn("match_percentile", average_percent_rank(F.col("match_score"), keys))
    every = Window.partitionBy(*keys)
    rows = rows.withColumn("joint_percentile", F.cume_dist().over(every.orderBy("joint_risk")))
    for c in ("_duration", "_move"):
        rows = rows.withColumn(f"{c}_mid", F.percentile(c, 0.5).over(every)).withColumn(f"{c}_sd", F.stddev_pop(c).over(every))
        rows = rows.withColumn(f"{c}_mad", F.percentile(F.abs(F.col(c) - F.col(f"{c}_mid")), 0.5).over(every) * MAD_TO_STD)
    off = lambda c: F.abs(F.col(c) - F.col(f"{c}_mid")) / F.greatest(F.col(f"{c}_mad"), F.col(f"{c}_sd"), F.lit(1e-6))
    near = lambda p: F.abs(F.col("joint_percentile") - p) + RANK_SHARE * F.col("match_percentile")
    return rows.withColumn("cohort", F.count(F.lit(1)).over(every)).withColumns({"fast_score": near(FAST), "normal_score": off("_duration") + off("_move") + MIDDLE_RANK_SHARE * F.col("match_percentile"), "extreme_score": near(EXTREME)})


def scenarios(projected: DataFrame, least: int = LEAST_COHORT, by: Sequence[str] = ()) -> DataFrame:
    """Three different episodes, for each `by` where given: near the lower quarter of joint risk, in the middle, and near its upper tenth. No rows for a cohort below `least`.

    They are chosen in this order, each among what is left; ties go to the better match. Ranking everyone three times
    and excluding by rank does it in one pass: a name takes the first row that no earlier name took.
    """
    keys = [F.col(c) for c in by] or [F.lit(0)]
    rows = _cohort(projected, keys).where(F.col("cohort") >= least)
    names = ("fast", "normal", "extreme")
    every = Window.partitionBy(*keys)
    for n in names:
        rows = rows.withColumn(f"_{n}", F.row_number().over(every.orderBy(F.round(f"{n}_score", 12), "match_score", "episode_id")))
    fast = F.col("_fast") == 1
    # rank among the rest: one less if the excluded row stood before
    rows = rows.withColumn("_n_fast", F.max(F.when(fast, F.col("_normal"))).over(every)).withColumn("_e_fast", F.max(F.when(fast, F.col("_extreme"))).over(every))
    normal = ~fast & (F.col("_normal") == F.when(F.col("_n_fast") == 1, 2).otherwise(1))
    rows = rows.withColumn("_is_normal", normal).withColumn("_e_normal", F.max(F.when(F.col("_is_normal"), F.col("_extreme"))).over(every))
    first = F.when(F.array_contains(F.array("_e_fast", "_e_normal"), 1), F.when(F.array_contains(F.array("_e_fast", "_e_normal"), 2), 3).otherwise(2)).otherwise(1)
    name = F.when(fast, "fast").when(F.col("_is_normal"), "normal").when(F.col("_extreme") == first, "extreme")
    tail = F.sum(F.lit(1)).over(every.orderBy(F.desc("joint_risk")).rangeBetween(Window.unboundedPreceding, 0)) / F.col("cohort")
    return rows.withColumn("scenario", name).withColumn("tail_share", tail).where("scenario IS NOT NULL").select(
        *by, "scenario", "episode_id", "asset", "timeframe", "direction", "offset_bars", "remaining_bars", "current_move_pct", "future_peak_move_pct", "scale",
        "projected_future_pct", "projected_adverse_pct", "joint_risk", "joint_percentile", "tail_share", "match_score", "cohort",
    )


def candles(chosen: DataFrame, path_rows: DataFrame, live: DataFrame, digits: int = 6) -> DataFrame:
    """(scenario, step, open_time, open, high, low, close): what followed the chosen state, on the live signal's scale.

    Mirroring swaps highs and lows, so all four prices are projected first and the extremes taken then.
    live: one row with wick_target, direction_sign, start_ms, interval_ms.
    """
    one = single(live.select(F.col("wick_target").alias("q_target"), F.col("direction_sign").alias("q_sign"), F.col("start_ms").alias("q_start"), F.col("interval_ms").alias("q_interval")), "live signal")
    # a handful of scenarios
    rows = path_rows.join(F.broadcast(chosen.select("scenario", "episode_id", F.col("offset_bars").alias("_at"), "scale")), "episode_id").where(F.col("offset_bars") > F.col("_at")).crossJoin(F.broadcast(one))
    price = lambda c: F.col("q_target") * (1.0 + F.col("q_sign") * F.col("scale") * F.col(f"normalized_{c}_pct") / 100.0)
    rows = rows.select("scenario", (F.col("offset_bars") - F.col("_at")).alias("step"), "q_start", "q_interval", *(price(c).alias(f"_{c}") for c in ("open", "high", "low", "close")))
    four = ("_open", "_high", "_low", "_close")
    return rows.select("scenario", "step", (F.col("q_start") + (F.col("step") - 1) * F.col("q_interval")).alias("open_time"), F.bround("_open", digits).alias("open"), F.bround(F.greatest(*four), digits).alias("high"), F.bround(F.least(*four), digits).alias("low"), F.bround("_close", digits).alias("close"))


def joined_to_live(drawn: DataFrame, live: DataFrame, digits: int = 6) -> DataFrame:
    """drawn (`candles`) whose first candle of each scenario opens where the live series stands; its range takes that in.

    live: one row with wick_target, direction_sign, current_move_pct.
    """
    close = F.bround(F.col("wick_target") * (1.0 + F.col("direction_sign") * F.col("current_move_pct") / 100.0), digits)
    rows = drawn.crossJoin(F.broadcast(single(live.select(close.alias("_close")), "live state")))
    first = lambda c, value: F.when(F.col("step") == 1, value).otherwise(F.col(c))
    return rows.withColumns({"open": first("open", F.col("_close")), "high": first("high", F.greatest("high", "_close")), "low": first("low", F.least("low", "_close"))}).drop("_close")


def path_metrics(projected: DataFrame, live: DataFrame) -> DataFrame:
    """Peak and loss of the candles as they are shown. live: one row with wick_target, direction_sign, current_move_pct."""
    one = live.select(F.col("wick_target").alias("t"), F.col("direction_sign").alias("s"), F.col("current_move_pct").alias("m"))
    one = single(one, "live state")
    rows = projected.crossJoin(F.broadcast(one))
    far = F.when(F.col("s") == 1, (F.col("high") / F.col("t") - 1.0) * 100.0).otherwise((1.0 - F.col("low") / F.col("t")) * 100.0)
    peak = rows.groupBy("scenario", "s", "m").agg(F.greatest(F.max(far), F.lit(0.0)).alias("peak"), F.count("*").alias("bars"))
    return peak.select("scenario", "bars", F.bround("peak", 8).alias("projected_future_pct"), F.bround(F.greatest(F.col("peak") - F.col("m"), F.lit(0.0)) * 100.0 / (100.0 + F.col("s") * F.col("m")), 8).alias("projected_adverse_pct"))


def envelope(path_rows: DataFrame, matched: DataFrame, least_active: int = 6) -> DataFrame:
    """Median candle and 10-90 range of the matched continuations by step, as long as enough of them are still under way."""
    chosen = matched.select("episode_id", F.col("offset_bars").alias("_at"), "scale")
    rows = path_rows.join(F.broadcast(chosen), "episode_id").where(F.col("offset_bars") > F.col("_at"))
    value = lambda c: (F.col(f"normalized_{c}_pct") * F.col("scale")).alias(c)
    steps = rows.select((F.col("offset_bars") - F.col("_at")).alias("step"), *map(value, ("open", "high", "low", "close"))).groupBy("step").agg(
        F.count("*").alias("active"), *(F.percentile(c, 0.5).alias(c) for c in ("open", "high", "low", "close")), F.percentile("close", 0.1).alias("close_p10"), F.percentile("close", 0.9).alias("close_p90")
    )
    total = matched.agg((F.greatest(F.lit(float(least_active)), F.count("*") / 4.0)).alias("_least"))
    first_thin = steps.crossJoin(F.broadcast(total)).groupBy().agg(F.min(F.when(F.col("active") < F.col("_least"), F.col("step"))).alias("_stop"))
    kept = steps.crossJoin(F.broadcast(first_thin)).where(F.col("_stop").isNull() | (F.col("step") < F.col("_stop")))
    four = ("open", "high", "low", "close")
    return kept.select("step", "active", "open", F.greatest(*four).alias("high"), F.least(*four).alias("low"), "close", "close_p10", "close_p90")


def median_duration_pick(matched: DataFrame) -> DataFrame:
    """The match whose remaining duration is nearest to the median one; ties to the better score."""
    mid = matched.agg(F.percentile("remaining_bars", 0.5).alias("_mid"))
    return matched.crossJoin(F.broadcast(mid)).orderBy(F.abs(F.col("remaining_bars") - F.col("_mid")), "match_score", "episode_id").limit(1).drop("_mid")


def context_reranked(base: DataFrame, features: DataFrame, query: DataFrame, scales: DataFrame, columns: Sequence[str], weight: float, k: int, key: str = "candidate_id") -> DataFrame:
    """base (query_id, key, match_score) reranked by a context distance that is brought to the base's median first.

    features: (key, columns); query: (query_id, columns); scales: (name, scale). A single difference counts at most 12.
    """
    table = scales.where(F.col("name").isin(*columns)).groupBy().agg(*(F.max(F.when(F.col("name") == c, F.col("scale"))).alias(f"s_{c}") for c in columns))
    rows = base.join(features.select(key, *columns), key).join(query.select("query_id", *(F.col(c).alias(f"q_{c}") for c in columns)), "query_id").crossJoin(F.broadcast(table))
    total = F.lit(0.0)
    for c in columns:
        total = total + F.least(F.abs(F.col(c) - F.col(f"q_{c}")) / F.col(f"s_{c}"), F.lit(12.0))
    own = Window.partitionBy("query_id")
    rows = rows.withColumn("_context", total / float(len(columns)))
    fair = F.col("_context") * F.greatest(F.percentile("match_score", 0.5).over(own), F.lit(1e-9)) / F.greatest(F.percentile("_context", 0.5).over(own), F.lit(1e-9))
    out = rows.withColumn("context_score", fair).withColumn("final_score", (1.0 - weight) * F.col("match_score") + weight * F.col("context_score"))
    place = F.row_number().over(own.orderBy("final_score", key))
    return out.withColumn("place", place).where(F.col("place") <= k).select("query_id", key, "match_score", "context_score", "final_score", "place")


def medoid(curves: DataFrame, key: str = "episode_id") -> DataFrame:
    """One row: the curve with the least mean distance to the weighted mean curve, ties to the smaller key.

    curves: (key, step, value, weight), long.
    """
    mean = curves.groupBy("step").agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("_mean"))
    far = curves.join(mean, "step").groupBy(key).agg(F.avg(F.abs(F.col("value") - F.col("_mean"))).alias("distance"))
    return far.orderBy("distance", key).limit(1)


def local_quantiles(near: DataFrame, qs: Sequence[float], value: str = "value") -> DataFrame:
    """Weighted quantiles of the neighbours' values, weights falling exponentially with distance in units of the median, never crossing."""
    from tidemark.operators.stats import weighted_quantile_linear

    unit = F.greatest(F.percentile("distance", 0.5).over(Window.partitionBy("query_id")), F.lit(0.05))
    rows = near.withColumn("weight", F.exp(-F.least(F.col("distance") / unit, F.lit(50.0)))).select("query_id", "candidate_id", F.col(value).alias("value"), "weight")
    out = None
    for q in sorted(qs):
        one = weighted_quantile_linear(rows, q, ["query_id"], "candidate_id").withColumnRenamed("quantile", f"p{round(q * 100)}")
        out = one if out is None else out.join(one, "query_id")
    names = [f"p{round(q * 100)}" for q in sorted(qs)]
    return out.select("query_id", *(F.greatest(*names[: k + 1]).alias(n) if k else F.col(n) for k, n in enumerate(names)))


def routes(matched: DataFrame, forecasts: DataFrame, adverse_weight: float = 0.5, wait_weight: float = 0.5) -> DataFrame:
    """A different real episode for each forecast (route, order, wait_bars, adverse_pct, adverse_first), best first.

    Score: log error of the wait, relative error of the adverse move, and a tenth of the match distance in units of its
    median; a route that must go against first adds 100 where the episode peaks only in its last bar. Routes are few:
    one step per route, each over at most k matches.
    """
    mid = matched.agg(F.greatest(F.percentile("match_score", 0.5), F.lit(1e-9)).alias("_mid"))
    pool = matched.crossJoin(F.broadcast(mid))
    wanted = forecasts.select("route", "order", F.col("wait_bars").alias("w"), F.col("adverse_pct").alias("a"), "adverse_first")
    pairs = pool.crossJoin(F.broadcast(wanted))
    wait = F.abs(F.ln((F.col("remaining_bars") + 1.0) / (F.col("w") + 1.0)))
    loss = F.abs(F.col("projected_adverse_pct") - F.col("a")) / F.greatest(F.col("a"), F.lit(0.25))
    late = F.when(F.col("adverse_first") & (F.col("remaining_bars") <= 1), 100.0).otherwise(0.0)
    pairs = pairs.withColumn("route_score", wait_weight * wait + adverse_weight * loss + 0.10 * F.col("match_score") / F.col("_mid") + late)
    out = None
    for r in sorted(forecasts.select("route", "order").collect(), key=lambda r: r.order):
        free = pairs.where(F.col("route") == r.route)
        if out is not None:
            free = free.join(out.select("episode_id"), "episode_id", "left_anti")
        one = free.orderBy("route_score", "episode_id").limit(1).select("route", "episode_id", "offset_bars", "remaining_bars", "projected_adverse_pct", "route_score")
        out = one if out is None else out.unionByName(one)
    return out
