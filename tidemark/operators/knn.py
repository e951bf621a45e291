"""Exact nearest neighbours and what they say.

Queries and candidates are cut into blocks by a hash of their ids; every block of queries meets every block of
candidates in one task, which keeps the best of each query, and only those meet. No number of queries is too large:
more of them make more blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranks import running

QUERY_BLOCK = 16_384
#: rows that a task keeps: the nearest of all the queries of a block
_KEPT = 1 << 19
#: rows of a block of candidates: as few as fill the tasks, within these
CANDIDATE_BLOCK = (1_024, 65_536)
#: what is added to a distance before it is inverted (fixed value)
OFFSET = 0.20
#: distances, and numbers of differences, held at once
_CELLS = 1 << 20


def _most(rows: DataFrame, by: Sequence[str]) -> int:
    return rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def _dealt(rows: DataFrame, own: str, id_col: str, blocks: int, other: str, copies: int) -> DataFrame:
    """rows with the number of their block, once for each block of the other side."""
    block = F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int")
    out = rows.withColumn(own, block).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    # named anew: both sides can come from the same table
    return out.select(*(F.col(c).alias(c) for c in out.columns))


def distances(queries: DataFrame, candidates: DataFrame, depth: int, metric: str = "euclidean", by: Sequence[str] = (), query_block: int = QUERY_BLOCK, penalties: Sequence[float] = ()) -> DataFrame:
    """(by, query_id, candidate_id, group_id, distance, place) of the `depth` nearest candidates of each query, ties by candidate_id.

    queries: (by, query_id, vector); candidates: (by, candidate_id, group_id, vector). Only rows of the same `by` meet,
    and candidates with the query's own id are left out, as are queries and candidates without a vector. metric:
    euclidean, manhattan_mean or cosine. penalties: both sides have `categories` (array<string>); each that differs adds
    the square of its penalty to the squared distance (euclidean only).
    """
    if penalties and metric != "euclidean":
        raise ValueError("penalties need the euclidean metric")
    extra = ["categories"] if penalties else []
    by = list(by)
    queries = queries.where("vector IS NOT NULL").select(*by, "query_id", "vector", *extra)
    candidates = candidates.where("vector IS NOT NULL").select(*by, "candidate_id", "group_id", "vector", *extra)
    kind = dict(queries.dtypes) | dict(candidates.dtypes)
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the largest group decides: blocks of the others are smaller
    most = _most(candidates, by)
    nq = max(1, -(-_most(queries, by) // max(1, min(query_block, _KEPT // depth))))
    nc = max(1, -(-most // min(max(most // tasks, CANDIDATE_BLOCK[0]), CANDIDATE_BLOCK[1])))

    def near(key: tuple, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        names = [*by, "query_id", "candidate_id", "group_id", "distance"]
        if not len(asked) or not len(held):
            return pd.DataFrame({n: [] for n in names})
        ids, matrix = asked.query_id.to_numpy(), np.array(asked.vector.tolist(), np.float64).reshape(len(asked), -1)
        own_kinds = np.array(asked.categories.tolist(), object) if penalties else None
        # the nearest so far of each run of queries: no more than a run's new rows stand beside them
        best: dict[int, pd.DataFrame] = {}
        for at in range(0, len(held), 2048):
            pdf = held.iloc[at : at + 2048]
            x, own, group = np.array(pdf.vector.tolist(), np.float64), pdf.candidate_id.to_numpy(), pdf.group_id.to_numpy()
            kinds = np.array(pdf.categories.tolist(), object) if penalties else None
            width = max(1, x.shape[1])
            # as many queries for a short piece as for a full one: runs are the same for all pieces
            step = max(1, _CELLS // (2048 * width if metric == "manhattan_mean" else 2048))
            for begin in range(0, len(ids), step):
                q = matrix[begin : begin + step]
                slack = 0.0
                if metric == "euclidean":
                    # squares by products, which need no table of differences; who is near enough is measured again below
                    size = (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None]
                    d, slack = size - 2 * (q @ x.T), 1e-9 * (size.max() + 1)
                    for j, p in enumerate(penalties):
                        d += (own_kinds[begin : begin + step, None, j] != kinds[None, :, j]) * p**2
                elif metric == "manhattan_mean":
                    d = np.abs(q[:, None, :] - x[None]).mean(axis=2)
                else:
                    d = 1 - (q @ x.T) / np.maximum(np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None], 1e-12)
                d = np.where(ids[begin : begin + step, None] == own[None], np.inf, d)
                k = min(depth, d.shape[1])
                # ties at the edge stay until they are measured and ordered by id
                edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k] + slack
                rows, cols = np.nonzero((d <= edge) & np.isfinite(d))
                distance = d[rows, cols]
                if metric == "euclidean":
                    # many ties make many pairs: their differences are held in pieces
                    for i in range(0, len(rows), max(1, _CELLS // width)):
                        r, c = rows[i : i + max(1, _CELLS // width)], cols[i : i + max(1, _CELLS // width)]
                        other = sum(((own_kinds[begin + r, j] != kinds[c, j]) * p**2 for j, p in enumerate(penalties)), 0.0)
                        distance[i : i + len(r)] = np.sqrt(((q[r] - x[c]) ** 2).sum(axis=1) + other)
                new = pd.DataFrame({"query_id": ids[begin + rows], "candidate_id": own[cols], "group_id": group[cols], "distance": distance})
                new = pd.concat([best[begin], new]) if begin in best else new
                best[begin] = new.sort_values(["query_id", "distance", "candidate_id"], kind="stable").groupby("query_id").head(depth)
        best = pd.concat(best.values())
        for name, value in zip(by, key):
            best[name] = value
        return best[names]

    schema = ", ".join([f"{c} {kind[c]}" for c in (*by, "query_id", "candidate_id", "group_id")] + ["distance double"])
    keys = [*by, "_q", "_c"]
    met = _dealt(queries, "_q", "query_id", nq, "_c", nc).groupBy(*keys).cogroup(_dealt(candidates, "_c", "candidate_id", nc, "_q", nq).groupBy(*keys)).applyInPandas(near, schema)
    place = F.row_number().over(Window.partitionBy(*by, "query_id").orderBy("distance", "candidate_id"))
    return met.withColumn("place", place).where(F.col("place") <= depth)


def first_of_groups(near: DataFrame, k: int) -> DataFrame:
    """The nearest candidate of each group, the k nearest of these: (query_id, candidate_id, group_id, distance, place)."""
    by_group = Window.partitionBy("query_id", "group_id").orderBy("distance", "candidate_id")
    order = Window.partitionBy("query_id").orderBy("distance", "candidate_id")
    return near.withColumn("_n", F.row_number().over(by_group)).where("_n = 1").drop("_n", "place").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def require_k(found: DataFrame, k: int) -> DataFrame:
    """found, with an error when it is read if a query in it has fewer than k neighbours."""
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    few = F.raise_error(F.concat(F.lit("fewer neighbours than wanted: "), F.col("query_id").cast("string"))).cast("boolean")
    return found.withColumn("_n", n).where(F.when(F.col("_n") < k, few).otherwise(F.lit(True))).drop("_n")


def search_depth(k: int, least: int = 512) -> int:
    """How far to look before groups are made distinct; fewer than k groups can come out."""
    return max(8 * k, least)


def within_radius(pool: DataFrame, k: int, radius: float | None) -> DataFrame:
    """The k nearest within the radius; the single nearest, flagged, where none is."""
    capped = pool.where(F.col("place") <= k)
    if radius is None:
        return capped.withColumn("radius_failed", F.lit(False))
    any_near = F.max((F.col("distance") <= radius).cast("int")).over(Window.partitionBy("query_id")) == 1
    return capped.withColumn("radius_failed", ~any_near).where(F.when(F.col("radius_failed"), F.col("place") == 1).otherwise(F.col("distance") <= radius))


def radius_of(pool: DataFrame, quantile: float) -> float:
    return pool.agg(F.percentile("distance", quantile)).first()[0]


def weights(near: DataFrame, weighting: str) -> DataFrame:
    """near with `weight`: uniform, falling with the distance in units of the query's median distance, or (offset) with the distance itself."""
    unit = F.greatest(F.percentile("distance", 0.5).over(Window.partitionBy("query_id")), F.lit(1e-9))
    d = F.col("distance") / unit
    forms: dict[str, Column] = {"uniform": F.lit(1.0), "inverse": 1.0 / (d + 0.05), "inverse_square": 1.0 / F.pow(d + 0.05, 2), "exponential": F.exp(-d), "offset": 1.0 / (F.col("distance") + OFFSET)}
    return near.withColumn("weight", forms[weighting])


def vote(weighted: DataFrame, label: str = "label") -> DataFrame:
    return weighted.groupBy("query_id").agg((F.sum(F.col("weight") * F.col(label)) / F.sum("weight")).alias("prediction"), F.count("*").alias("neighbours"))


def support(weighted: DataFrame, value: str = "value") -> DataFrame:
    """How well a neighbourhood supports its forecast: sizes, distances, agreement and dispersion of `value`, label in `label`."""
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy("query_id"))
    rows = weighted.withColumn("_w", share).withColumn("_mean", F.sum(share * F.col(value)).over(Window.partitionBy("query_id")))
    fill = F.sum(F.col("_w") * F.col("label"))
    return rows.groupBy("query_id").agg(
        F.count("*").alias("raw_neighbours"), (1.0 / F.sum(F.col("_w") * F.col("_w"))).alias("effective_neighbours"), F.min("distance").alias("nearest_distance"), F.percentile("distance", 0.5).alias("median_distance"),
        F.stddev_pop("distance").alias("distance_dispersion"), F.greatest(fill, 1.0 - fill).alias("agreement"), F.sqrt(F.sum(F.col("_w") * F.pow(F.col(value) - F.col("_mean"), 2))).alias("value_dispersion"),
    )


def outcome_summary(matched: DataFrame, bounds: DataFrame, outcomes: DataFrame, waits: DataFrame, classes: Sequence[str], least: int = 12) -> tuple[DataFrame, DataFrame]:
    """What became of each query's neighbours, by horizon; only those whose outcome is known count, and at least `least` of them.

    matched: (query_id, observation_id); bounds as of `outcomes.adverse_bounds`, outcomes long, waits (observation_id,
    target_bars). Gives (query_id, horizon_bars, neighbours, fill_probability, adverse and wait quantiles) and
    (query_id, horizon_bars, threshold_pct, outcome, share) for every class, those that no neighbour has with share 0.
    """
    known = matched.join(bounds, "observation_id").where(F.col("fully_observed") | F.col("target_hit")).join(waits, "observation_id", "left")
    middle = (F.col("max_adverse_lower_pct") + F.col("max_adverse_upper_pct")) / 2
    wait = F.when(F.col("target_hit"), F.col("target_bars").cast("double"))
    q = lambda c, p, name: F.percentile(c, p).alias(name)
    told = known.groupBy("query_id", "horizon_bars").agg(
        F.count("*").alias("neighbours"), F.avg(F.col("target_hit").cast("double")).alias("fill_probability"), q(middle, 0.5, "adverse_p50"), q("max_adverse_upper_pct", 0.8, "adverse_p80"), q("max_adverse_upper_pct", 0.9, "adverse_p90"),
        q(wait, 0.1, "wait_bars_p10"), q(wait, 0.5, "wait_bars_p50"), q(wait, 0.9, "wait_bars_p90"),
    ).where(F.col("neighbours") >= least)
    both = known.select("query_id", "horizon_bars", "observation_id").join(outcomes, ["observation_id", "horizon_bars"]).join(told.select("query_id", "horizon_bars", "neighbours"), ["query_id", "horizon_bars"])
    counts = both.groupBy("query_id", "horizon_bars", "threshold_pct", "neighbours").agg(*(F.count_if(F.col("outcome") == c).alias(c) for c in classes))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("outcome"), (F.col(c) / F.col("neighbours")).alias("share")) for c in classes)))
    return told, counts.select("query_id", "horizon_bars", "threshold_pct", pairs.alias("o")).select("query_id", "horizon_bars", "threshold_pct", "o.*")


def support_levels(supported: DataFrame, calibration: DataFrame, column: str = "median_distance", levels: int = 5) -> DataFrame:
    """Where each neighbourhood stands among calibration ones: the share that is not above it, and one of `levels` equal levels.

    A neighbourhood without a value has neither.
    """
    ref = calibration.select(F.col(column).alias("_v"), F.lit(1).alias("_ref"))
    both = supported.select(F.col(column).alias("_v"), F.lit(0).alias("_ref")).unionByName(ref).where("_v IS NOT NULL")
    # values as one list: reference rows up to each value, ties included
    places = running(both.groupBy("_v").agg(F.sum("_ref").alias("_n")), [], ["_v"], "_n").select("_v", ((F.col("_before") + F.col("_n")) / F.col("_all")).alias("percentile"))
    found = supported.select("query_id", F.col(column).alias("_v")).join(places, "_v", "left")
    return found.select("query_id", "percentile", F.least(F.floor(F.col("percentile") * levels), F.lit(levels - 1)).cast("int").alias("level"))
