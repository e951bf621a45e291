"""Walk-forward forecasts by neighbours: every fold is scaled by, and learns from, what was known when its window began."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import knn, stats

# With others the neighbours are other ones.
FEATURE_WEIGHTS = {
    "body_pct_of_range": 1.0, "dominant_wick_pct_of_range": 1.0, "opposite_wick_pct_of_range": 0.8, "range_pct_of_close": 0.7,
    "log_range_vs_prior_20_median": 0.7, "log_volume_vs_prior_20_mean": 0.5, "aligned_prior_1h_return_pct": 0.5,
}
CATEGORY_PENALTIES = {"asset": 0.35, "timeframe": 0.25, "direction": 0.15}


def roles(rows: DataFrame, folds: DataFrame, time: str = "open_time", known: str = "known_ms") -> DataFrame:
    """rows with a label by fold and role: queries inside the window; history whose label was known when the window began."""
    # folds are few; a range condition on them needs no shuffle of the rows
    pairs = rows.where("label IS NOT NULL").join(F.broadcast(folds), (F.col(time) < F.col("test_end")) & ((F.col(known) <= F.col("test_start")) | (F.col(time) >= F.col("test_start"))))
    return pairs.withColumn("role", F.when(F.col(time) >= F.col("test_start"), "query").otherwise("history"))


def predict(rows: DataFrame, folds: DataFrame, k: int = 75, least_train: int = 400, features: Mapping[str, float] = FEATURE_WEIGHTS, categories: Mapping[str, float] = CATEGORY_PENALTIES) -> DataFrame:
    """(fold, query_id, label, score, base_score, n_train) for the queries of all folds with at least `least_train` rows of history.

    rows: (id, open_time, known_ms, label, features, categories). Features are scaled by the fold's own history and
    weighed; another category adds the square of its penalty to the squared distance. base_score is the history's rate.
    """
    named = roles(rows, folds)
    sizes = named.groupBy("fold").agg(F.count_if(F.col("role") == "history").alias("n_train"), F.count_if(F.col("role") == "query").alias("n_test"), F.avg(F.when(F.col("role") == "history", F.col("label"))).alias("base_score"))
    usable = sizes.where((F.col("n_train") >= least_train) & (F.col("n_test") > 0)).select("fold", "n_train", "base_score")
    named = named.join(usable, "fold")
    long = stats.long(named.where("role = 'history'"), list(features), "fold")
    scales = stats.robust_scales(long, "first_usable", "fold")
    wide = scales.groupBy("fold").agg(*(F.max(F.when(F.col("name") == n, F.col(x))).alias(f"_{x}_{n}") for n in features for x in ("center", "scale")))
    vector = F.array(*((F.col(n) - F.col(f"_center_{n}")) / F.col(f"_scale_{n}") * w for n, w in features.items()))
    placed = named.join(wide, "fold").select("fold", "role", "id", "label", "n_train", "base_score", vector.alias("vector"), F.array(*(F.col(c).cast("string") for c in categories)).alias("categories"))
    asked = placed.where("role = 'query'").withColumnRenamed("id", "query_id")
    history = placed.where("role = 'history'").select("fold", F.col("id").alias("candidate_id"), F.col("id").alias("group_id"), "vector", "categories", F.col("label").alias("_y"))
    near = knn.distances(asked, history, k, by=["fold"], penalties=list(categories.values()))
    voted = knn.weights(near, "offset").join(history.select("fold", "candidate_id", "_y"), ["fold", "candidate_id"])
    scores = voted.groupBy("fold", "query_id").agg((F.sum(F.col("weight") * F.col("_y")) / F.sum("weight")).alias("score"))
    return asked.select("fold", "query_id", "label", "base_score", "n_train").join(scores, ["fold", "query_id"]).select("fold", "query_id", "label", "score", "base_score", "n_train")


def fold_metrics(predicted: DataFrame) -> DataFrame:
    """Per fold: sizes, rate, Brier score, that of the history's rate, and the skill over it."""
    miss = lambda c: F.avg(F.pow(F.col(c) - F.col("label"), 2))
    out = predicted.groupBy("fold").agg(F.max("n_train").alias("n_train"), F.count("*").alias("n_test"), F.avg("label").alias("positive_rate"), miss("score").alias("brier"), miss("base_score").alias("base_brier"))
    return out.withColumn("skill", 1.0 - F.try_divide(F.col("brier"), F.col("base_brier")))
