"""Times the headline queries and prints one line of JSON.

The queries of the catalogue run over $BENCH_SF_DIR. Others stand beside published figures, which are for one series of
527,965 (8,279 signals) and of 2,638,312 candles (63,086 signals): signals and their traces, outcome labels, and the
best of 2.8 million candidate states, over tables made by formulas. `counts` says how many there are here.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.storage import stored
from tidemark.operators import match, outcomes, signals, trace
from tidemark.operators.first_hit import blocked

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "candle_rollup", "strict_signals", "trace_status", "panel_labels", "episode_library", "candidate_states", "observations", "horizon_adverse_bounds", "competing_outcomes",
    "rolling_features", "sequence_fingerprint", "robust_scales_a", "weighted_quantile_interp", "auc", "knn_topk", "best_alignment_adaptive", "scenarios", "project_flagship",
)


#: widths of the candles' bodies, and adverse thresholds in percent
BODY = {5: 5.3, 1: 3.6}
THRESHOLDS = (1.0, 3.0, 7.0, 15.0, 30.0)


def series(spark: SparkSession, n: int, minutes: int) -> DataFrame:
    """n gapless candles whose path is a sum of waves and whose details come from a hash.

    Bodies and wicks are such that about 1.6 % of five-minute and 2.4 % of one-minute candles are signals, as published.
    """
    noise = lambda k: F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(1_000_003)) / 1_000_003.0
    level = lambda t: 2000 + 300 * F.sin(t / 90_000.0) + 60 * F.sin(t / 3_100.0) + 9 * F.sin(t / 170.0)
    rows = spark.range(n).select(
        F.lit("SYN").alias("asset"), F.lit(f"{minutes}m").alias("timeframe"), F.lit(minutes).alias("interval_minutes"), F.col("id").alias("bar_index"), (F.col("id") * minutes * 60_000).alias("open_time"),
        ((F.col("id") + 1) * minutes * 60_000 - 1).alias("close_time"), level(F.col("id")).alias("open"), (level(F.col("id")) + BODY[minutes] * (noise(1) - 0.5)).alias("close"), noise(3).alias("u"), noise(4).alias("d"), (100 + 900 * noise(5)).alias("volume"),
    )
    spread = lambda c: 3 * F.pow(c, 3)
    return rows.select("asset", "timeframe", "interval_minutes", "bar_index", "open_time", "close_time", "open", (F.greatest("open", "close") + spread(F.col("u"))).alias("high"), (F.least("open", "close") - spread(F.col("d"))).alias("low"), "close", "volume")


def states_table(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    noise = lambda k: F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(1_000_003)) / 1_000_003.0
    states = spark.range(2_793_520).select(
        F.pmod("id", F.lit(28_829)).alias("episode_id"), (F.col("id") / 28_829).cast("long").alias("offset_bars"), (noise(1) * 12).alias("current_move_pct"), (noise(1) * 12 + noise(2) * 5).alias("peak_move_pct"),
        (noise(2) * 5).alias("drawdown_pct"), (noise(3) * 900).cast("long").alias("remaining_bars"), (noise(4) * 20).alias("future_peak_move_pct"),
    )
    scores = spark.range(28_829).select(F.col("id").alias("episode_id"), (noise(5) * 6).alias("adaptive"), F.lit(0.0).alias("shape"), F.lit(0.35).alias("category"))
    live = spark.createDataFrame([(3.0, 4.0, 1.0, 120.0)], "current_move_pct double, peak_move_pct double, drawdown_pct double, elapsed_bars double")
    return stored(states, "states"), stored(scores, "scores"), live


def main() -> None:
    from tidemark.plans.catalogue import QUERIES

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(make) -> float:
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - began, 3)

    QUERIES["trace_status"](spark, SF_DIR).count()  # a warm JVM, as the published figures have no start-up in them
    seconds = {name: timed(lambda name=name: QUERIES[name](spark, SF_DIR)) for name in HEADLINE}
    counts = {}
    for size, n, minutes in (("5m_528k_rows", 527_965, 5), ("1m_2638k_rows", 2_638_312, 1)):
        candles = stored(series(spark, n, minutes), "bench")
        day = 24 * 60 // minutes

        def found(candles=candles, minutes=minutes, day=day) -> DataFrame:
            made = stored(signals.detect(candles, 60 // minutes), "signals")
            return trace.trace(made, candles, 180 * day, blocked(candles))

        if minutes == 5:
            # a warm JVM, as the published figures have no compilation in them
            timed(lambda: trace.status_counts(found(stored(series(spark, 20_000, 5), "warm"))))
        seconds[f"detect_trace_{size}"] = timed(lambda: trace.status_counts(found()))
        # outcome labels: about as many observations as published, one bar after the signal
        blocks = blocked(candles)
        kept = stored(found(), "traced")
        counts[f"signals_{size}"] = kept.count()
        some = kept if minutes == 5 else kept.where(F.pmod(F.xxhash64("signal_id"), F.lit(2)) == 0)
        observed = stored(outcomes.observations(some, candles, [1], blocks), "observed")
        counts[f"observations_{size}"] = observed.count()

        def labels(observed=observed, blocks=blocks, day=day) -> DataFrame:
            t = stored(outcomes.touches(observed, blocks, 30 * day, THRESHOLDS), "touched")
            return outcomes.adverse_bounds(observed, t, blocks, [day, 7 * day, 30 * day]).join(outcomes.outcomes_wide(t, [day, 7 * day, 30 * day], THRESHOLDS), "observation_id")

        seconds[f"outcome_labels_{size}"] = timed(labels)

    # the best 80 of 28,829 episodes by their 2.8 million candidate states
    states, scores, live = states_table(spark)
    counts["candidate_states"] = states.count()
    seconds["top_k_2800k_states"] = timed(lambda: match.top(match.best_alignments(match.scored_states(states, scores, live)), 80))
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "counts": counts, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
