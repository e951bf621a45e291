"""Supervised forecasts of an observation: chance of a touch, adverse move and waiting time, by horizon."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit(rows: DataFrame, columns: Sequence[str], horizons: Sequence[int], trees: int = 20, seed: int = 17) -> dict[str, PipelineModel]:
    """One forest per horizon for hit_<h> (0/1) and one boosted regressor for adverse_<h>; rows with a NULL target are left out of its model, and a target without rows has none."""
    vector = VectorAssembler(inputCols=list(columns), outputCol="_x")
    models = {}
    targets = [f"{n}_{h}" for h in horizons for n in ("hit", "adverse")]
    counts = rows.agg(*(F.count(t).alias(t) for t in targets)).first()
    for h in horizons:
        forest = RandomForestClassifier(featuresCol="_x", labelCol=f"hit_{h}", numTrees=trees, maxDepth=6, seed=seed, probabilityCol=f"_p_{h}", rawPredictionCol=f"_r_{h}", predictionCol=f"_c_{h}")
        # the absolute error, as large moves are few
        boosted = GBTRegressor(featuresCol="_x", labelCol=f"adverse_{h}", maxIter=trees, maxDepth=3, lossType="absolute", seed=seed, predictionCol=f"_a_{h}")
        for name, stage in ((f"hit_{h}", forest), (f"adverse_{h}", boosted)):
            if counts[name]:
                models[name] = Pipeline(stages=[vector, stage]).fit(rows.where(F.col(name).isNotNull()))
    return models


def predict(rows: DataFrame, models: dict[str, PipelineModel], horizons: Sequence[int]) -> DataFrame:
    """rows with chance_<h> and adverse_forecast_<h>, neither falling as the horizon grows; NULL where there is no model."""
    out = rows
    for h in horizons:
        for name, column in ((f"hit_{h}", f"_p_{h}"), (f"adverse_{h}", f"_a_{h}")):
            out = models[name].transform(out).drop("_x") if name in models else out.withColumn(column, F.lit(None).cast("double"))
    two = lambda h: F.coalesce(F.get(vector_to_array(f"_p_{h}"), 1), F.lit(0.0)) if f"hit_{h}" in models else F.col(f"_p_{h}")
    chance = [two(h) for h in horizons]
    loss = [F.when(F.col(f"_a_{h}").isNotNull(), F.greatest(F.col(f"_a_{h}"), F.lit(0.0))) for h in horizons]
    up = lambda values, k: F.greatest(*values[: k + 1]) if k else values[0]
    return out.select(*rows.columns, *(up(chance, k).alias(f"chance_{h}") for k, h in enumerate(horizons)), *(up(loss, k).alias(f"adverse_forecast_{h}") for k, h in enumerate(horizons)))


def save(models: dict[str, PipelineModel], path: str) -> None:
    """Each model below `path`, in the shared file system."""
    for name, model in models.items():
        model.write().overwrite().save(f"{path}/{name}")


def load(path: str, horizons: Sequence[int]) -> dict[str, PipelineModel]:
    return {name: PipelineModel.load(f"{path}/{name}") for h in horizons for name in (f"hit_{h}", f"adverse_{h}")}


def ranges(calibration: DataFrame, horizon: int, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """One row: quantiles of the residuals of the adverse forecast on rows that no model was fitted to."""
    miss = F.col(f"adverse_{horizon}") - F.col(f"adverse_forecast_{horizon}")
    return calibration.agg(F.percentile(miss, low).alias("low"), F.percentile(miss, high).alias("high"), F.count(miss).alias("n"))
