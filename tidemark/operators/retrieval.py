"""Two-stage retrieval: pools by cheap distances, then one ranking of the pool by all of them.

Queries meet candidates in blocks; a task measures every distance of a pair at once and keeps the candidates that are
among the nearest by any of them, so the pools are exact and every row of a pool has all distances. A mode names one
distance, or two with their shares: these are brought to one median over the query's pool before they are added.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.storage import stored
from tidemark.operators import stats
from tidemark.operators.crossing import best_of, block_counts, chunks, meet

DISTANCES = ("scalar", "embedding", "forecast")
#: modes and the shares of their distances (fixed values)
MODES: Mapping[str, Mapping[str, float]] = {
    "scalar": {"scalar": 1.0}, "neural": {"embedding": 1.0}, "hybrid": {"scalar": 0.35, "embedding": 0.65}, "forecast": {"forecast": 1.0}, "forecast_hybrid": {"scalar": 0.30, "forecast": 0.70},
}


def pools(queries: DataFrame, candidates: DataFrame, size: int, blocks: tuple[int, int] | None = None) -> DataFrame:
    """(query_id, candidate_id, group_id, distances, place_<distance>): candidates among the `size` nearest by any distance.

    Both sides have `scalar` (scaled and weighed features, compared by the sum of differences), `embedding` (compared by
    the cosine) and `forecast` (a query's forecast against a candidate's outcome, by the mean difference), as arrays.
    A query's own id is left out; ties go by candidate_id.
    """
    asked, held = queries.select("query_id", *DISTANCES), candidates.select("candidate_id", "group_id", *DISTANCES)
    matrix = lambda rows, c: np.array(rows[c].tolist(), float).reshape(len(rows), -1)

    def nearest(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        ids, out = held["candidate_id"].to_numpy(), []
        theirs = {c: matrix(held, c) for c in DISTANCES}
        unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        theirs["embedding"] = unit(theirs["embedding"])
        for piece in chunks(asked, len(held) * 4):
            own = ids[None] == piece["query_id"].to_numpy()[:, None]
            far = {"embedding": np.maximum(1.0 - unit(matrix(piece, "embedding")) @ theirs["embedding"].T, 0.0)}
            for c in ("scalar", "forecast"):
                mine = matrix(piece, c)
                far[c] = sum(np.abs(mine[:, j][:, None] - theirs[c][:, j][None]) for j in range(mine.shape[1])) / (mine.shape[1] if c == "forecast" else 1)
            picked = np.zeros(own.shape, bool)
            for c in DISTANCES:
                rows, cols = best_of(ids, piece["query_id"].to_numpy(), np.where(own, np.inf, far[c]), size)
                picked[rows, cols] = True
            rows, cols = np.nonzero(picked)
            out.append(pd.DataFrame({"query_id": piece["query_id"].to_numpy()[rows], "candidate_id": ids[cols], "group_id": held["group_id"].to_numpy()[cols]} | {c: far[c][rows, cols] for c in DISTANCES}))
        return pd.concat(out)

    kind = lambda rows, c: rows.schema[c].dataType.simpleString()
    schema = f"query_id {kind(asked, 'query_id')}, candidate_id {kind(held, 'candidate_id')}, group_id {kind(held, 'group_id')}, " + ", ".join(f"{c} double" for c in DISTANCES)
    met = meet(asked, held, nearest, schema, blocks or block_counts(asked, held), candidate_id="candidate_id")
    own = Window.partitionBy("query_id")
    placed = met.withColumns({f"place_{c}": F.row_number().over(own.orderBy(c, "candidate_id")) for c in DISTANCES})
    return stored(placed.where(F.least(*(F.col(f"place_{c}") for c in DISTANCES)) <= size), "pools")


def ranked(pool: DataFrame, size: int, k: int, modes: Mapping[str, Mapping[str, float]] = MODES) -> DataFrame:
    """(mode, query_id, candidate_id, group_id, distance, place): the k nearest groups of each mode, each by its nearest candidate."""
    out = None
    for name, shares in modes.items():
        inside = pool.where(F.least(*(F.col(f"place_{c}") for c in shares), F.lit(size + 1)) <= size)
        own = Window.partitionBy("query_id")
        if len(shares) == 1:
            distance = F.col(next(iter(shares)))
        else:
            distance = sum((share * F.col(c) / F.greatest(F.percentile(c, 0.5).over(own), F.lit(1e-6)) for c, share in shares.items()), F.lit(0.0))
        rows = inside.withColumn("distance", distance).select(F.lit(name).alias("mode"), "query_id", "candidate_id", "group_id", "distance")
        first = F.row_number().over(Window.partitionBy("query_id", "group_id").orderBy("distance", "candidate_id"))
        place = F.row_number().over(own.orderBy("distance", "candidate_id"))
        one = rows.withColumn("_n", first).where("_n = 1").drop("_n").withColumn("place", place).where(F.col("place") <= k)
        out = one if out is None else out.unionByName(one)
    return out


def weighed(found: DataFrame) -> DataFrame:
    """found with `weight`, falling exponentially with the distance in units of the median of what was found."""
    warmth = F.greatest(F.percentile("distance", 0.5).over(Window.partitionBy("mode", "query_id")), F.lit(1e-4))
    return found.withColumn("weight", F.exp(-F.col("distance") / warmth) + 1e-6)


def quantiles(found: DataFrame, value: str, qs: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """(mode, query_id, p<percent>..): weighted quantiles of the neighbours' outcomes. found: with `weight` and the outcome."""
    rows = found.select("mode", "query_id", "candidate_id", F.col(value).alias("value"), "weight")
    out = None
    for q in qs:
        one = stats.weighted_quantile_linear(rows, q, ["mode", "query_id"], "candidate_id").withColumnRenamed("quantile", f"p{round(q * 100)}")
        out = one if out is None else out.join(one, ["mode", "query_id"])
    return out
