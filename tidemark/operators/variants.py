"""Neighbours under many settings at once: weights of feature blocks, and shares of the history.

A pair's squared distance is a weighted sum of the squared distances of its blocks, so one scan that measures each
block once serves all weightings. A smaller history is a nested sample, those whose place is below a share, so the same
scan serves all sizes too.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import stats
from tidemark.operators.crossing import best_of, block_counts, chunks, meet

BLOCKS = ("state", "context", "pre", "recent", "episode")


def configurations() -> dict[str, dict[str, float]]:
    """The weightings that are compared (fixed values): the state alone, with its context, and with views of the sequence."""
    views = BLOCKS[2:]
    out = {"state": {"state": 1.0}}
    out |= {f"context_{w:g}": {"state": 1.0, "context": w} for w in (0.25, 0.5, 1.0, 2.0)}
    out |= {f"context_{c:g}_views_{w:g}": {"state": 1.0, "context": c} | dict.fromkeys(views, w) for c in (0.5, 1.0) for w in (0.25, 0.5, 1.0, 2.0)}
    out |= {f"context_1_{v}_{w:g}": {"state": 1.0, "context": 1.0, v: w} for v in views for w in (0.5, 1.0)}
    out |= {f"context_1_recent_episode_{w:g}": {"state": 1.0, "context": 1.0, "recent": w, "episode": w} for w in (0.5, 1.0)}
    return out


def block_vectors(values: DataFrame, history: DataFrame, names: Mapping[str, Sequence[str]], key: str = "observation_id", limit: float = 8.0) -> DataFrame:
    """(key, one array per block) of long (key, block, name, value), scaled by the history's medians and deviations.

    history: the keys that scales are learnt from. A value is held within +-limit and divided by the root of its
    block's width, so blocks weigh alike; a missing one stands at the center.
    """
    scales = stats.robust_scales(values.join(history.select(key), key), "first_usable", "block")
    rows = stats.scaled(values, scales, limit, "block").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("/", "block", "name"), "value"))).alias("_v"))
    one = lambda b, n: F.coalesce(F.try_element_at("_v", F.lit(f"{b}/{n}")), F.lit(0.0)) / float(len(names[b])) ** 0.5
    return rows.select(key, *(F.array(*(one(b, n) for n in names[b])).alias(b) for b in names))


def sample_place(group: str, salt: str = "history") -> Column:
    """Where a group stands in nested samples, 0 to 1: its rows are in or out together."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}:"), F.col(group).cast("string")).cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def search(queries: DataFrame, history: DataFrame, variants: Mapping[str, tuple[Mapping[str, float], float]], k: int, blocks: tuple[int, int] | None = None) -> DataFrame:
    """(query_id, variant, observation_id, signal_id, distance, place): the k nearest groups of each query under each variant.

    queries: (query_id, block arrays); history: (observation_id, signal_id, place, block arrays), place as from
    `sample_place`. A variant is its blocks' weights and the share of the history that it sees. A group (signal_id)
    stands with its nearest row, ties by observation_id; equal groups go by signal_id.
    """
    asked, held = queries.select("query_id", *BLOCKS), history.select("observation_id", "signal_id", F.col("place").alias("spot"), *BLOCKS)
    counts = blocks or block_counts(asked, held)
    matrix = lambda rows, b: np.array(rows[b].tolist(), float).reshape(len(rows), -1)

    def nearest(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values(["signal_id", "observation_id"]).reset_index(drop=True)
        groups, starts = np.unique(held["signal_id"].to_numpy(object), return_index=True)
        ends = np.append(starts[1:], len(held))
        # a group's rows share their place
        spots, ids = held["spot"].to_numpy()[starts], held["observation_id"].to_numpy()
        theirs = {b: matrix(held, b) for b in BLOCKS}
        out = []
        for piece in chunks(asked, len(held) * (len(BLOCKS) + 2)):
            far = {}
            for b in BLOCKS:
                own, far[b] = matrix(piece, b), np.zeros((len(piece), len(held)))
                for j in range(own.shape[1]):
                    far[b] += (own[:, j][:, None] - theirs[b][:, j][None]) ** 2
            for name, (weights, share) in variants.items():
                distance = np.sqrt(sum(w * w * far[b] for b, w in weights.items()))
                least = np.minimum.reduceat(distance, starts, axis=1)
                least[:, spots >= share] = np.inf
                rows, cols = best_of(groups, piece["query_id"].to_numpy(), least, k)
                at = [starts[c] + int(np.argmin(distance[r, starts[c] : ends[c]])) for r, c in zip(rows, cols)]
                out.append(pd.DataFrame({"query_id": piece["query_id"].to_numpy()[rows], "variant": name, "observation_id": ids[at], "signal_id": groups[cols], "distance": least[rows, cols]}))
        return pd.concat(out)

    met = meet(asked, held, nearest, "query_id string, variant string, observation_id string, signal_id string, distance double", counts, candidate_id="observation_id")
    # a group's rows can lie in several blocks
    own = met.groupBy("query_id", "variant", "signal_id").agg(F.min(F.struct("distance", "observation_id")).alias("b")).select("query_id", "variant", "signal_id", "b.observation_id", "b.distance")
    place = F.row_number().over(Window.partitionBy("query_id", "variant").orderBy("distance", "signal_id"))
    return own.withColumn("place", place).where(F.col("place") <= k)


def forecasts(found: DataFrame, bounds: DataFrame, waits: DataFrame) -> DataFrame:
    """(query_id, variant, horizon_bars, fill, adverse_pct, wait_bars): rate of fills, median adverse move and median wait of the neighbours.

    Where no neighbour is filled the wait is the horizon.
    """
    known = found.select("query_id", "variant", "observation_id").join(bounds, "observation_id").join(waits, "observation_id", "left")
    wait = F.percentile(F.when(F.col("target_hit"), F.col("target_bars").cast("double")), 0.5)
    return known.groupBy("query_id", "variant", "horizon_bars").agg(F.avg(F.col("target_hit").cast("double")).alias("fill"), F.percentile("max_adverse_upper_pct", 0.5).alias("adverse_pct"), F.coalesce(wait, F.col("horizon_bars").cast("double")).alias("wait_bars"))


def errors(told: DataFrame, queries: DataFrame, bounds: DataFrame, waits: DataFrame) -> DataFrame:
    """(variant, horizon_bars, queries, fill_brier, adverse_error_pct, wait_error_bars): means over the signals' means, so that a signal counts once.

    queries: (query_id, signal_id). Waits are only compared for queries that were filled.
    """
    actual = queries.join(bounds.withColumnRenamed("observation_id", "query_id"), "query_id").join(waits.withColumnRenamed("observation_id", "query_id"), "query_id", "left")
    rows = told.join(actual.select("query_id", "horizon_bars", "signal_id", F.col("target_hit").cast("double").alias("hit"), "max_adverse_upper_pct", "target_bars"), ["query_id", "horizon_bars"])
    rows = rows.select("variant", "horizon_bars", "signal_id", F.pow(F.col("fill") - F.col("hit"), 2).alias("f"), F.abs(F.col("adverse_pct") - F.col("max_adverse_upper_pct")).alias("a"), F.when(F.col("hit") == 1, F.abs(F.col("wait_bars") - F.col("target_bars"))).alias("w"))
    per = rows.groupBy("variant", "horizon_bars", "signal_id").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in "faw"))
    return per.groupBy("variant", "horizon_bars").agg(F.sum("n").alias("queries"), F.avg("f").alias("fill_brier"), F.avg("a").alias("adverse_error_pct"), F.avg("w").alias("wait_error_bars"))


def chosen(measured: DataFrame, baseline: str, tolerance: float) -> DataFrame:
    """measured with the mean and worst ratio of its errors to the baseline's, and which variant is selected at each horizon.

    Selected is the least mean ratio among those whose worst is within 1 + tolerance, ties by name.
    """
    names = ("fill_brier", "adverse_error_pct", "wait_error_bars")
    base = measured.where(F.col("variant") == baseline).select("horizon_bars", *(F.col(n).alias(f"_{n}") for n in names))
    # one row per variant and horizon
    rows = measured.join(base, "horizon_bars")
    ratios = [F.when(F.col("variant") == baseline, 1.0).otherwise(F.col(n) / F.greatest(F.col(f"_{n}"), F.lit(1e-12))) for n in names]
    rows = rows.withColumn("mean_error_ratio", (ratios[0] + ratios[1] + ratios[2]) / 3.0).withColumn("worst_error_ratio", F.greatest(*ratios))
    passes = F.col("worst_error_ratio") <= 1.0 + tolerance
    first = F.row_number().over(Window.partitionBy("horizon_bars").orderBy(F.when(passes, 0).otherwise(1), "mean_error_ratio", "variant")) == 1
    return rows.withColumn("selected", first & passes).drop(*(f"_{n}" for n in names))
