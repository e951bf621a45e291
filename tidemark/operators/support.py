"""How well a forecast by neighbours is supported, measured against neighbourhoods of calibration observations.

What is fitted is four tables: scales, the history's vectors, its outcomes, and the distances of the calibration
neighbourhoods. They can be saved and read back, see `sources.artifacts`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import clip
from tidemark.functions.storage import stored
from tidemark.operators import knn, stats

LEVELS = 5
#: below so many effective neighbours, or from this percentile on, support is low (fixed values)
LEAST_EFFECTIVE, FAR_PERCENTILE = 8.0, 0.80
LIMIT = 8.0


def _vectors(facts: DataFrame, scales: DataFrame, names: Sequence[str]) -> DataFrame:
    """facts with `vector`: each column scaled, held within +-LIMIT, and divided by the root of their number."""
    wide = scales.groupBy().agg(*(F.max(F.when(F.col("name") == n, F.col(c))).alias(f"_{c}_{n}") for n in names for c in ("center", "scale")))
    one = lambda n: clip(F.coalesce((F.col(n) - F.col(f"_center_{n}")) / F.col(f"_scale_{n}"), F.lit(0.0)), -LIMIT, LIMIT) / float(len(names)) ** 0.5
    return facts.crossJoin(F.broadcast(wide)).withColumn("vector", F.array(*map(one, names)))


def _neighbourhoods(asked: DataFrame, history: DataFrame, known: DataFrame, pool: int, k: int) -> DataFrame:
    """Weighed neighbours of each query with their outcomes. asked: (query_id, own_asset, vector)."""
    near = knn.first_of_groups(knn.distances(asked.select("query_id", "vector"), history.select(F.col("observation_id").alias("candidate_id"), F.col("signal_id").alias("group_id"), "vector"), pool), k)
    facts = history.select(F.col("observation_id").alias("candidate_id"), "asset").join(known.withColumnRenamed("observation_id", "candidate_id"), "candidate_id")
    # without an outcome a neighbour says nothing
    return knn.weights(near.join(facts, "candidate_id"), "exponential").join(asked.select("query_id", "own_asset"), "query_id")


def fitted(parted: DataFrame, facts: DataFrame, names: Sequence[str], known: DataFrame, pool: int, k: int) -> dict[str, DataFrame]:
    """The artifact's tables. parted: observations with `part` (history or calibration), signal_id and asset; known: (observation_id, label, value)."""
    rows = stored(parted.select("observation_id", "signal_id", "asset", "part").join(facts, "observation_id"), "support-facts")
    scales = stored(stats.robust_scales(stats.long(rows.where("part = 'history'"), names)), "support-scales")
    history = stored(_vectors(rows.where("part = 'history'"), scales, names).select("observation_id", "signal_id", "asset", "vector"), "support-history")
    asked = _vectors(rows.where("part = 'calibration'"), scales, names).select(F.col("observation_id").alias("query_id"), F.col("asset").alias("own_asset"), "vector")
    calibration = knn.support(_neighbourhoods(asked, history, known, pool, k)).select("query_id", "median_distance", "nearest_distance")
    return {"scales": scales, "history": history, "outcomes": known.join(history.select("observation_id"), "observation_id", "left_semi"), "calibration": calibration}


def supported(held: Mapping[str, DataFrame], facts: DataFrame, names: Sequence[str], pool: int, k: int) -> DataFrame:
    """One row per query: what its neighbours say, how many count, how near they are among calibration neighbourhoods, and its level.

    facts: (observation_id, asset, names). low_support: few effective neighbours, or farther than four fifths of the
    calibration neighbourhoods. Queries without neighbours have no row.
    """
    asked = stored(_vectors(facts, held["scales"], names).select(F.col("observation_id").alias("query_id"), F.col("asset").alias("own_asset"), "vector"), "support-asked")
    near = stored(_neighbourhoods(asked, held["history"], held["outcomes"], pool, k), "support-near")
    found = stored(knn.support(near), "support-found")
    share = lambda x: F.sum(F.col("weight") * x) / F.sum("weight")
    told = near.groupBy("query_id").agg(share(F.col("label")).alias("fill_probability"), share((F.col("asset") == F.col("own_asset")).cast("double")).alias("same_asset_share"))
    middle = stats.weighted_quantile_step(near.select("query_id", "value", "weight"), 0.5, ["query_id"]).withColumnRenamed("quantile", "adverse_p50")
    at = lambda column, name: knn.support_levels(found, held["calibration"], column, LEVELS).select("query_id", F.col("percentile").alias(name), *(["level"] if name == "median_percentile" else []))
    rows = found.join(told, "query_id").join(middle, "query_id").join(at("median_distance", "median_percentile"), "query_id").join(at("nearest_distance", "nearest_percentile"), "query_id")
    low = (F.col("effective_neighbours") < LEAST_EFFECTIVE) | (F.col("median_percentile") >= FAR_PERCENTILE)
    return rows.select("query_id", "raw_neighbours", "effective_neighbours", "agreement", "same_asset_share", "fill_probability", "adverse_p50", "median_percentile", "nearest_percentile", "level", low.alias("low_support"))
