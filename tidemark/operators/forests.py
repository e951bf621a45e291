"""Quantile forests and stacked forecasts on `pyspark.ml` trees.

A quantile forest weighs training rows by the leaves they share with a query; leaves are joined as rows (tree, leaf),
and a leaf stands as its distinct values with their shares, so a large leaf of few values is few rows. A stack learns
from base forecasts that are out of fold: each row is forecast by models that never saw a row of its group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.storage import stored
from tidemark.operators import stats

#: of the regression that combines chances
PENALTY = 0.05


def fit_forest(rows: DataFrame, columns: Sequence[str], target: str, trees: int = 30, depth: int = 6, least_rows: int = 10, seed: int = 17) -> PipelineModel | None:
    """A regression forest of rows that have the target; None where there are none."""
    known = rows.where(F.col(target).isNotNull())
    if known.isEmpty():
        return None
    forest = RandomForestRegressor(featuresCol="_x", labelCol=target, numTrees=trees, maxDepth=depth, minInstancesPerNode=least_rows, seed=seed, leafCol="_leaves", predictionCol="_p")
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="_x"), forest]).fit(known)


def leaves(model: PipelineModel, rows: DataFrame, *keep: str) -> DataFrame:
    """(keep, tree, leaf): the leaf of every tree that each row falls into."""
    return model.transform(rows).select(*keep, F.posexplode(vector_to_array("_leaves")).alias("tree", "leaf"))


def leaf_values(train: DataFrame, target: str) -> DataFrame:
    """(tree, leaf, value, share): the distinct values of each leaf and the part of its rows that have them."""
    counts = train.groupBy("tree", "leaf", F.col(target).alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("tree", "leaf"))).drop("n")


def forest_quantiles(asked: DataFrame, values: DataFrame, qs: Sequence[float], key: str = "query_id") -> DataFrame:
    """(key, q<percent>..): the values at which the leaves' weights reach each q. asked: (key, tree, leaf); values: as from `leaf_values`.

    A training row weighs the mean, over the trees, of one over the size of the leaf that it shares with the query.
    """
    trees = values.agg(F.max("tree").alias("t")).first().t
    if trees is None:
        return asked.select(key, *(F.lit(None).cast("double").alias(f"q{round(q * 100)}") for q in qs)).limit(0)
    met = stored(asked.join(values, ["tree", "leaf"]).groupBy(key, "value").agg((F.sum("share") / float(trees + 1)).alias("weight")), "forest-weights")
    out = None
    for q in qs:
        # sums of shares can end a little below one
        one = stats.weighted_quantile_step(met, q - 1e-12, [key]).withColumnRenamed("quantile", f"q{round(q * 100)}")
        out = one if out is None else out.join(one, key)
    return out


def fold_of(group: str, folds: int) -> Column:
    """Which fold a group belongs to; rows of a group are never parted."""
    return F.pmod(F.crc32(F.col(group).cast("string").cast("binary")), F.lit(folds)).cast("int")


def row_weights(rows: DataFrame, group: str, age: str | None = None) -> Column:
    """One over the rows of the group; with `age`, also over those of the age group relative to an even share, so that no age dominates."""
    weight = 1.0 / F.count(F.lit(1)).over(Window.partitionBy(group))
    if age is None:
        return weight
    counts = {r[0]: r.n for r in rows.groupBy(age).agg(F.count("*").alias("n")).collect()}
    even = sum(counts.values()) / max(1, len(counts))
    share = F.lit(1.0)
    for value, n in counts.items():
        share = F.when(F.col(age).eqNullSafe(F.lit(value)), even / n).otherwise(share)
    return weight * share


@dataclass
class Stack:
    """Base models by (system, target), meta models by target, and the columns each reads."""

    base: dict[tuple[str, str], PipelineModel]
    meta: dict[str, PipelineModel]
    support: tuple[str, ...]


def _base(rows: DataFrame, systems: Mapping[str, Sequence[str]], targets: Mapping[str, str], trees: int, depth: int, seed: int) -> dict[tuple[str, str], PipelineModel]:
    out = {}
    for system, columns in systems.items():
        vector = VectorAssembler(inputCols=list(columns), outputCol="_x")
        for target, kind in targets.items():
            known = rows.where(F.col(target).isNotNull())
            shared = {"featuresCol": "_x", "labelCol": target, "numTrees": trees, "maxDepth": depth, "seed": seed, "weightCol": "_weight", "predictionCol": "_y"}
            tree = RandomForestClassifier(probabilityCol="_p", rawPredictionCol="_r", **shared) if kind == "chance" else RandomForestRegressor(**shared)
            if not known.isEmpty():
                out[system, target] = Pipeline(stages=[vector, tree]).fit(known)
    return out


def _forecast(rows: DataFrame, model: PipelineModel | None, name: str, chance: bool) -> DataFrame:
    if model is None:
        return rows.withColumn(name, F.lit(None).cast("double"))
    value = F.coalesce(F.get(vector_to_array("_p"), 1), F.lit(0.0)) if chance else F.col("_y")
    out = model.transform(rows).withColumn(name, value)
    return out.select(*rows.columns, name)


def base_forecasts(rows: DataFrame, models: Mapping[tuple[str, str], PipelineModel], systems: Sequence[str], targets: Mapping[str, str]) -> DataFrame:
    """rows with <system>_<target>; NULL where there is no model."""
    out = rows
    for system in systems:
        for target, kind in targets.items():
            out = _forecast(out, models.get((system, target)), f"{system}_{target}", kind == "chance")
    return out


def out_of_fold(rows: DataFrame, systems: Mapping[str, Sequence[str]], targets: Mapping[str, str], group: str, folds: int = 3, trees: int = 10, depth: int = 5, seed: int = 17) -> DataFrame:
    """rows with <system>_<target> from models of the other folds: none of them saw a row of the same group."""
    named = stored(rows.withColumn("_fold", fold_of(group, folds)).withColumn("_weight", row_weights(rows, group)), "fold-rows")
    out = None
    for k in range(folds):
        models = _base(named.where(F.col("_fold") != k), systems, targets, trees, depth, seed + k)
        one = base_forecasts(named.where(F.col("_fold") == k), models, list(systems), targets)
        out = one if out is None else out.unionByName(one)
    return out.drop("_fold", "_weight")


def attach_support(rows: DataFrame, support: DataFrame, key: str) -> DataFrame:
    """rows with the support of each by its key; an error where a row has none or several."""
    counted = support.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    both = rows.join(counted, key, "left")
    return both.where(F.when(F.coalesce(F.col("_n") == 1, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no single support row for "), F.col(key).cast("string"))).cast("boolean"))).drop("_n")


def _inputs(systems: Sequence[str], targets: Sequence[str], support: Sequence[str]) -> list[str]:
    return [f"{s}_{t}" for s in systems for t in targets] + list(support)


def _filled(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rows with what is missing or not finite as 0."""
    return rows.withColumns({c: F.when(F.isnan(F.col(c)) | (F.abs(F.col(c)) == float("inf")), 0.0).otherwise(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in columns})


def fit_stack(rows: DataFrame, systems: Mapping[str, Sequence[str]], targets: Mapping[str, str], group: str, support: Sequence[str] = (), folds: int = 3, trees: int = 10, depth: int = 5, rounds: int = 10, seed: int = 17) -> Stack:
    """Base models of all rows, and a model per target over out-of-fold forecasts (and support columns), each group weighing one.

    Chances are combined by a penalised logistic regression, amounts by boosted trees of the absolute error.

    targets: name -> chance (0/1) or amount. A target without rows has no model; one with a single value is forecast
    by its base models alone.
    """
    known = stored(out_of_fold(rows, systems, targets, group, folds, trees, depth, seed), "out-of-fold")
    weighted = known.withColumn("_weight", row_weights(known, group))
    columns = _inputs(list(systems), list(targets), support)
    vector = VectorAssembler(inputCols=columns, outputCol="_x")
    meta = {}
    for target, kind in targets.items():
        learnt = _filled(weighted.where(F.col(target).isNotNull()), columns)
        if learnt.select(target).distinct().limit(2).count() < 2:
            continue
        shared = {"featuresCol": "_x", "labelCol": target, "weightCol": "_weight", "predictionCol": "_y"}
        if kind == "chance":
            # few inputs that are chances already: a penalised regression keeps them calibrated where trees would not
            top = LogisticRegression(regParam=PENALTY, probabilityCol="_p", rawPredictionCol="_r", **shared)
        else:
            top = GBTRegressor(lossType="absolute", maxIter=rounds, maxDepth=2, stepSize=0.1, minInstancesPerNode=25, seed=seed, **shared)
        meta[target] = Pipeline(stages=[vector, top]).fit(learnt)
    base = _base(rows.withColumn("_weight", row_weights(rows, group)), systems, targets, trees, depth, seed)
    return Stack(base, meta, tuple(support))


def predict_stack(rows: DataFrame, stack: Stack, systems: Sequence[str], targets: Mapping[str, str]) -> DataFrame:
    """rows with <system>_<target> of the base models and stacked_<target>; chances within 0 and 1, amounts not below 0."""
    told = base_forecasts(rows, stack.base, systems, targets)
    out = _filled(told, _inputs(systems, list(targets), stack.support))
    names = []
    for target, kind in targets.items():
        name = f"stacked_{target}"
        names.append(name)
        if target in stack.meta:
            out = _forecast(out, stack.meta[target], name, kind == "chance")
        else:
            out = out.withColumn(name, F.col(f"{systems[0]}_{target}"))
        bounded = F.greatest(F.col(name), F.lit(0.0))
        out = out.withColumn(name, F.least(bounded, F.lit(1.0)) if kind == "chance" else bounded)
    return out.select(*told.columns, *names)
