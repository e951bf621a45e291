"""The past states that come closest to a live one: a weighted distance, the best alignment per episode, the k best."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import factor_distance, log_distance, ratio, single
from tidemark.operators.crossing import best_of, block_counts, chunks, medians, meet
from tidemark.operators.signals import FEATURES
from tidemark.operators.stats import long, robust_scales

# With others the ranking is another one.
FEATURE_WEIGHTS = {
    "body_pct_of_range": 0.8, "dominant_wick_pct_of_range": 0.8, "opposite_wick_pct_of_range": 0.8, "range_pct_of_close": 0.6,
    "range_vs_prior_20_median": 0.6, "volume_vs_prior_20_mean": 0.5, "aligned_prior_1h_return_pct": 0.5,
}
#: weight and floor of each state's log distance
STATE_WEIGHTS = {"current_move_pct": (1.8, 0.30), "peak_move_pct": (1.2, 0.30), "drawdown_pct": (1.2, 0.30), "elapsed_bars": (0.4, 3.0)}
CATEGORY_PENALTIES = {"asset": 0.35, "timeframe": 0.25, "direction": 0.10}
FEATURE_SHARE = 0.5
SHAPE_POINTS = {"body_pct_of_range": 0.75, "dominant_wick_pct_of_range": 3.0, "opposite_wick_pct_of_range": 3.0}
SHAPE_FACTORS = {"range_pct_of_close": 1.5, "range_vs_prior_20_median": 1.5, "volume_vs_prior_20_mean": 2.0}
SHAPE_RETURN = 1.0
SHAPE_POOL, SHAPE_MULTIPLIER, SHAPE_BLEND = 240, 1.5, 0.30
COMPONENTS = ("move_part", "peak_part", "drawdown_part", "age_part", "adaptive_part", "shape_part", "category_part")


def _with_query(df: DataFrame, query: DataFrame) -> DataFrame:
    """df with the one query row's columns as q_<name>; more than one query is an error."""
    return df.crossJoin(F.broadcast(single(query.select(*(F.col(c).alias(f"q_{c}") for c in query.columns)), "query")))


def shape_distance() -> Column:
    """Root mean square of seven differences, each in units of what still counts as alike; which wick it is plays no part."""
    q = lambda c: F.col(f"q_{c}")
    parts = [F.abs(F.col(c) - q(c)) * 100.0 / s for c, s in SHAPE_POINTS.items()]
    parts += [factor_distance(F.col(c), q(c), f) for c, f in SHAPE_FACTORS.items()]
    parts.append(F.abs(F.col(FEATURES[-1]) - q(FEATURES[-1])) / SHAPE_RETURN)
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return F.sqrt(total / float(len(parts)))


def shape_pool(events: DataFrame, query: DataFrame, size: int = SHAPE_POOL) -> DataFrame:
    """The `size` episodes of the most similar candle, (.., shape_distance)."""
    return _with_query(events, query).withColumn("shape_distance", shape_distance()).drop(*(f"q_{c}" for c in query.columns)).orderBy("shape_distance", "episode_id").limit(size)


def event_scores(events: DataFrame, query: DataFrame, mode: str = "adaptive", blend: float = SHAPE_BLEND) -> DataFrame:
    """(episode_id, adaptive, shape, category): distances of the signals. Scales are those of the events given, and change with them."""
    if mode == "archetype":
        return shape_pool(events, query).select("episode_id", F.lit(0.0).alias("adaptive"), (F.col("shape_distance") * SHAPE_MULTIPLIER).alias("shape"), F.lit(0.0).alias("category"))
    if mode not in ("adaptive", "blended"):
        raise ValueError(f"no such mode: {mode}")
    scales = robust_scales(long(events, FEATURES)).groupBy().agg(*(F.max(F.when(F.col("name") == c, F.col("scale"))).alias(f"s_{c}") for c in FEATURES))
    rows = _with_query(events, query).crossJoin(F.broadcast(scales))
    total = F.lit(0.0)
    for c, w in FEATURE_WEIGHTS.items():
        total = total + w * F.abs(F.col(c) - F.col(f"q_{c}")) / F.col(f"s_{c}")
    other = lambda c: (F.col(c) != F.col(f"q_{c}")).cast("double") * CATEGORY_PENALTIES[c]
    rows = rows.withColumn("_feature", total)
    if mode == "adaptive":
        return rows.select("episode_id", F.col("_feature").alias("adaptive"), F.lit(0.0).alias("shape"), (other("asset") + other("timeframe") + other("direction")).alias("category"))
    # the two distances are brought to one median before they are blended
    rows = rows.withColumn("_shape", shape_distance())
    medians = rows.agg(F.greatest(F.percentile("_feature", 0.5), F.lit(1e-12)).alias("_mf"), F.greatest(F.percentile("_shape", 0.5), F.lit(1e-12)).alias("_ms"))
    both = rows.crossJoin(F.broadcast(medians))
    return both.select("episode_id", ((1.0 - blend) * F.col("_feature")).alias("adaptive"), (blend * F.col("_shape") * F.col("_mf") / F.col("_ms")).alias("shape"), (other("asset") * (1.0 - blend) + other("timeframe")).alias("category"))


def scored_states(candidates: DataFrame, scores: DataFrame, live: DataFrame) -> DataFrame:
    """Every candidate state with the seven parts of its score and their sum. live: one row with the names of STATE_WEIGHTS."""
    rows = _with_query(candidates.join(scores, "episode_id"), live).withColumn("elapsed_bars", F.col("offset_bars").cast("double"))
    part = lambda c: STATE_WEIGHTS[c][0] * log_distance(F.col(c), F.col(f"q_{c}"), STATE_WEIGHTS[c][1])
    rows = rows.withColumns(
        {"move_part": part("current_move_pct"), "peak_part": part("peak_move_pct"), "drawdown_part": part("drawdown_pct"), "age_part": part("elapsed_bars"), "adaptive_part": F.col("adaptive") * FEATURE_SHARE, "shape_part": F.col("shape") * FEATURE_SHARE, "category_part": F.col("category")}
    )
    total = F.col(COMPONENTS[0])
    for c in COMPONENTS[1:]:
        total = total + F.col(c)
    return rows.withColumn("match_score", total).drop(*(f"q_{c}" for c in live.columns), "adaptive", "shape", "category", "elapsed_bars")


def shape_matrix(asked: pd.DataFrame, held: pd.DataFrame) -> np.ndarray:
    """`shape_distance` of each pair."""
    least = lambda rows, c: np.maximum(rows[c].to_numpy(float), 1e-12)
    off = lambda c: held[c].to_numpy(float)[None] - asked[c].to_numpy(float)[:, None]
    total = sum((np.abs(off(c)) * 100.0 / s) ** 2 for c, s in SHAPE_POINTS.items())
    total = total + sum((np.log(least(held, c)[None] / least(asked, c)[:, None]) / np.log(f)) ** 2 for c, f in SHAPE_FACTORS.items())
    return np.sqrt((total + (off(FEATURES[-1]) / SHAPE_RETURN) ** 2) / (len(SHAPE_POINTS) + len(SHAPE_FACTORS) + 1))


def observation_scores(observed: DataFrame, queries: DataFrame, scales: DataFrame, blend: float = SHAPE_BLEND, pool_directions: bool = False, k: int = 40, isolated: str = "1m", blocks: tuple[int, int] | None = None) -> DataFrame:
    """(query_id, observation_id, match_score, place) of the k closest observations of each query.

    Both tables have the seven features, series, direction and state columns; queries also query_id. Series of the
    timeframe `isolated` only meet their own asset, and directions their own unless pooled. Shape distances are brought
    to the median of the feature distances over all that a query meets. Observations that lack a feature match nothing.
    Queries meet observations in blocks: once for the two medians, once for the scores, of which a task keeps k.
    """
    states = {"entry_distance_pct": "current_move_pct", "peak_distance_pct": "peak_move_pct", "drawdown_pct": "drawdown_pct", "age_bars": "elapsed_bars"}
    wanted = [*FEATURES, *states, "asset", "timeframe", "direction"]
    asked, held = queries.select("query_id", *wanted), observed.select("observation_id", *wanted)
    blocks = blocks or block_counts(asked, held)
    # one row per feature
    units = {r.name: r.scale for r in scales.where(F.col("name").isin(*FEATURES)).collect()}

    def met(asked: pd.DataFrame, held: pd.DataFrame) -> np.ndarray:
        same = lambda c: held[c].to_numpy()[None] == asked[c].to_numpy()[:, None]
        out = same("asset") | ((held["timeframe"] != isolated).to_numpy()[None] & (asked["timeframe"] != isolated).to_numpy()[:, None])
        return out & (held["observation_id"].to_numpy()[None] != asked["query_id"].to_numpy()[:, None]) & (True if pool_directions else same("direction"))

    def both(asked: pd.DataFrame, held: pd.DataFrame) -> dict[str, np.ndarray]:
        seen = met(asked, held)
        feature = sum(w * np.abs(held[c].to_numpy(float)[None] - asked[c].to_numpy(float)[:, None]) / units[c] for c, w in FEATURE_WEIGHTS.items())
        return {"feature": np.where(seen, feature, np.nan), "shape": np.where(seen, shape_matrix(asked, held), np.nan)}

    middle = medians(asked, held, both, ("feature", "shape"), blocks, candidate_id="observation_id")
    middle = middle.groupBy("query_id").agg(*(F.greatest(F.max(F.when(F.col("name") == c, F.col("median"))), F.lit(1e-12)).alias(f"mid_{c}") for c in ("feature", "shape")))

    def nearest(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out, ids = [], held["observation_id"].to_numpy()
        for piece in chunks(asked, len(held)):
            pair = both(piece, held)
            rest = 0.0
            for c, name in states.items():
                w, floor = STATE_WEIGHTS[name]
                log = lambda rows, c=c, floor=floor: np.log(np.maximum(rows[c].to_numpy(float), 0.0) + floor)
                rest = rest + w * np.abs(log(held)[None] - log(piece)[:, None])
            rest = rest + CATEGORY_PENALTIES["asset"] * (1.0 - blend) * (held["asset"].to_numpy()[None] != piece["asset"].to_numpy()[:, None])
            fair = pair["shape"] * (piece["mid_feature"] / piece["mid_shape"]).to_numpy(float)[:, None]
            score = rest + FEATURE_SHARE * ((1.0 - blend) * pair["feature"] + blend * fair)
            rows, cols = best_of(ids, piece["query_id"].to_numpy(), score, k)
            out.append(pd.DataFrame({"query_id": piece["query_id"].to_numpy()[rows], "observation_id": ids[cols], "match_score": score[rows, cols]}))
        return pd.concat(out)

    kind = lambda rows, c: rows.schema[c].dataType.simpleString()
    schema = f"query_id {kind(asked, 'query_id')}, observation_id {kind(held, 'observation_id')}, match_score double"
    found = meet(asked.join(middle, "query_id"), held, nearest, schema, blocks, candidate_id="observation_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("match_score", "observation_id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def best_alignments(scored: DataFrame) -> DataFrame:
    """The best state of each episode, of equal ones the earliest. A partial aggregate: no sort, one row per episode and task moves."""
    columns = [c for c in scored.columns if c != "episode_id"]
    best = scored.groupBy("episode_id").agg(F.min_by(F.struct(*columns), F.struct("match_score", "offset_bars")).alias("b"))
    return best.select("episode_id", *(F.col(f"b.{c}") for c in columns))


def top(best: DataFrame, k: int) -> DataFrame:
    """The k best episodes; of equal scores the smaller id."""
    return best.orderBy("match_score", "episode_id").limit(k)


# The weights of the first pass, which knows neither departures nor the range against the close.
FIRST_PASS_WEIGHTS = {"body_pct_of_range": 0.8, "dominant_wick_pct_of_range": 0.8, "opposite_wick_pct_of_range": 0.8, "range_vs_prior_20_median": 0.6, "volume_vs_prior_20_mean": 0.6, "prior_1h_return_pct": 0.4}


def first_pass(path_rows: DataFrame, episodes: DataFrame, query: DataFrame, live: DataFrame, k: int) -> DataFrame:
    """(episode_id, offset_bars, remaining_bars, close_move_pct, peak_move_pct, score): the k closest episodes, each at its best bar.

    Any bar before the fill on the far side of the target counts, also before the departure; the peak is that of all
    four prices. A feature that an episode lacks adds nothing. query and live: one row each.
    """
    names = list(FIRST_PASS_WEIGHTS)
    plain = lambda df: df.withColumn("prior_1h_return_pct", F.col("aligned_prior_1h_return_pct") * F.col("direction_sign"))
    events = plain(episodes).select("episode_id", "signal_to_fill_bars", *names)
    scales = robust_scales(long(events, names), "raw").groupBy().agg(*(F.max(F.when(F.col("name") == c, F.col("scale"))).alias(f"s_{c}") for c in names))
    rows = _with_query(events, plain(query).select(*names)).crossJoin(F.broadcast(scales))
    feature = F.lit(0.0)
    for c, w in FIRST_PASS_WEIGHTS.items():
        feature = feature + F.coalesce(w * F.abs(F.col(c) - F.col(f"q_{c}")) / F.col(f"s_{c}"), F.lit(0.0))
    four = [F.col(f"normalized_{c}_pct") for c in ("open", "high", "low", "close")]
    route = Window.partitionBy("episode_id").orderBy("offset_bars").rowsBetween(Window.unboundedPreceding, 0)
    bars = path_rows.select("episode_id", "offset_bars", F.col("normalized_close_pct").alias("current_move_pct"), F.max(F.greatest(*four)).over(route).alias("peak_move_pct"))
    met = bars.join(rows.select("episode_id", "signal_to_fill_bars", feature.alias("_feature")), "episode_id").where("offset_bars < signal_to_fill_bars AND current_move_pct > 0")
    met = _with_query(met.withColumns({"drawdown_pct": F.col("peak_move_pct") - F.col("current_move_pct"), "elapsed_bars": F.col("offset_bars").cast("double")}), live.select(*STATE_WEIGHTS))
    score = FEATURE_SHARE * F.col("_feature")
    for c, (w, floor) in STATE_WEIGHTS.items():
        score = score + w * log_distance(F.col(c), F.col(f"q_{c}"), floor)
    told = F.struct("offset_bars", (F.col("signal_to_fill_bars") - F.col("offset_bars")).alias("remaining_bars"), F.col("current_move_pct").alias("close_move_pct"), "peak_move_pct", "score")
    best = met.withColumn("score", score).groupBy("episode_id").agg(F.min_by(told, F.struct("score", "offset_bars")).alias("b"))
    return best.select("episode_id", "b.*").orderBy("score", "episode_id").limit(k)


def component_summary(matched: DataFrame) -> DataFrame:
    """Mean, median and 90th percentile of each part of the score."""
    return long(matched, COMPONENTS).groupBy("name").agg(F.avg("value").alias("mean"), F.percentile("value", 0.5).alias("median"), F.percentile("value", 0.9).alias("p90"))


def near_clones(events: DataFrame, query: DataFrame, steps: tuple[tuple[float, float], ...] = ((0.05, 2.0), (0.03, 1.5), (0.01, 1.2))) -> DataFrame:
    """How many episodes remain under ever stricter tolerances: shape within a fraction of the range, context within a factor."""
    rows = _with_query(events, query)
    alike = lambda c, f: F.coalesce(ratio(F.col(c), F.col(f"q_{c}")).between(1 / f, f), F.lit(False))
    counts = [F.count("*").alias("eligible")]
    for n, (points, factor) in enumerate(steps, 1):
        test = F.lit(True)
        for c in SHAPE_POINTS:
            test = test & (F.abs(F.col(c) - F.col(f"q_{c}")) <= points)
        for c in SHAPE_FACTORS:
            test = test & alike(c, factor)
        counts.append(F.count_if(test).alias(f"within_{n}"))
    return rows.agg(*counts)
