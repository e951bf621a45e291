"""Replay of past moments: every episode is asked about as it stood at fixed ages, and answered by what had ended by then.

All moments are searched at once. Each sees its own past only: the episodes whose fill had closed by its snapshot,
with the scales of those episodes. Blocks of moments meet blocks of episodes, which keep the best state of each
episode and the best episodes of each moment.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import single
from tidemark.functions.storage import stored
from tidemark.operators import project
from tidemark.operators.crossing import best_of, block_counts, chunks, medians, meet
from tidemark.operators.evaluate import by_mode, paired_bootstrap
from tidemark.operators.match import CATEGORY_PENALTIES, FEATURE_SHARE, FEATURE_WEIGHTS, SHAPE_BLEND, SHAPE_MULTIPLIER, SHAPE_POOL, STATE_WEIGHTS, shape_distance, shape_matrix
from tidemark.operators.stats import MAD_TO_STD

#: what stands for the current move, its peak, the drawdown and the age in a state's arrays
_STATE_COLUMNS = dict(zip(STATE_WEIGHTS, ("moves", "peaks", "drawdowns", "offsets")))
FEATURES = tuple(FEATURE_WEIGHTS)
MODES = ("adaptive", "blended", "archetype")
#: bars after a snapshot at which a told route is held against the real one
CHECKPOINTS = (1, 3, 6, 12, 24, 48, 96, 192, 576, 1440)
#: what `moded` adds to a moment
_BY_MODE = ("mode", "edge", "edge_id", "fair")


def moments(path_rows: DataFrame, states: DataFrame, episodes: DataFrame, offsets: Sequence[int]) -> DataFrame:
    """(query_id, ..): each episode at each age before its fill, what could be seen then, what came after, and `status`.

    status: not_confirmed_departure or not_away_from_target for moments that cannot be asked about, else ready.
    """
    ends = path_rows.where(F.col("offset_bars").isin(*offsets)).select("episode_id", "offset_bars", "open_time")
    rows = states.where(F.col("offset_bars").isin(*offsets) & (F.col("remaining_bars") > 0)).drop("asset", "timeframe", "direction", "direction_sign")
    rows = rows.join(ends, ["episode_id", "offset_bars"]).join(episodes, "episode_id")
    status = F.when(F.col("offset_bars") < F.col("signal_to_departure_bars"), "not_confirmed_departure").when(F.col("current_move_pct") <= 0, "not_away_from_target").otherwise("ready")
    return rows.select(
        F.concat_ws("@", "episode_id", "offset_bars").alias("query_id"), "episode_id", "asset", "timeframe", "direction", "direction_sign", "offset_bars", (F.col("open_time") + F.col("interval_minutes") * 60_000).alias("snapshot_ms"),
        "current_move_pct", "peak_move_pct", "drawdown_pct", F.col("offset_bars").cast("double").alias("elapsed_bars"), F.col("remaining_bars").alias("actual_remaining_bars"), F.greatest("future_peak_move_pct", F.lit(0.0)).alias("actual_future_pct"), status.alias("status"), *FEATURES,
    )


def library_of(episodes: DataFrame, states: DataFrame) -> DataFrame:
    """One row per episode with its candidate states as arrays, in the order of their age."""
    kept = states.where("candidate").groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("offset_bars", "current_move_pct", "peak_move_pct", "drawdown_pct", "remaining_bars", "future_peak_move_pct"))).alias("s"))
    part = lambda c, name: F.col(f"s.{c}").cast("array<double>").alias(name)
    arrays = kept.select("episode_id", part("offset_bars", "offsets"), part("current_move_pct", "moves"), part("peak_move_pct", "peaks"), part("drawdown_pct", "drawdowns"), part("remaining_bars", "remaining"), part("future_peak_move_pct", "futures"))
    return episodes.select("episode_id", "asset", "timeframe", "direction", "fill_close_ms", *FEATURES).join(arrays, "episode_id", "left")


def _seen(asked: pd.DataFrame, held: pd.DataFrame) -> np.ndarray:
    """Which episodes a moment may look at: same bars, ended by then, not its own."""
    column = lambda rows, c: rows[c].to_numpy()
    out = column(held, "fill_close_ms")[None] <= column(asked, "snapshot_ms")[:, None]
    out &= column(held, "timeframe")[None] == column(asked, "timeframe")[:, None]
    return out & (column(held, "episode_id")[None] != column(asked, "own_id")[:, None])


def _known(asked: pd.DataFrame, held: pd.DataFrame) -> dict[str, np.ndarray]:
    seen = _seen(asked, held)
    return {c: np.where(seen, held[c].to_numpy(float)[None], np.nan) for c in FEATURES}


def _deviations(asked: pd.DataFrame, held: pd.DataFrame) -> dict[str, np.ndarray]:
    known = _known(asked, held)
    return {c: np.abs(known[c] - asked[f"center_{c}"].to_numpy(float)[:, None]) for c in FEATURES}


def _moments_of(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    """Number, sum and sum of squares of the distances to the center, from which the spread follows."""
    rows = []
    for piece in chunks(asked, len(held)):
        known = _known(piece, held)
        for c in FEATURES:
            off = known[c] - piece[f"center_{c}"].to_numpy(float)[:, None]
            rows.append(pd.DataFrame({"query_id": piece["query_id"].to_numpy(), "name": c, "n": (~np.isnan(off)).sum(axis=1), "s": np.nansum(off, axis=1), "ss": np.nansum(off * off, axis=1)}))
    return pd.concat(rows)


def _wide(values: DataFrame, column: str, prefix: str) -> DataFrame:
    return values.groupBy("query_id").agg(*(F.max(F.when(F.col("name") == c, F.col(column))).alias(f"{prefix}_{c}") for c in FEATURES))


def scaled_moments(ready: DataFrame, library: DataFrame, blocks: tuple[int, int]) -> DataFrame:
    """ready with scale_<feature> over the episodes that each moment may look at; moments that see none are left out.

    A scale is the median absolute deviation, made comparable, else the standard deviation, else 1.
    """
    facts = library.select("episode_id", "timeframe", "fill_close_ms", *FEATURES)
    asked = ready.select("query_id", F.col("episode_id").alias("own_id"), "timeframe", "snapshot_ms")
    centers = _wide(medians(asked, facts, _known, FEATURES, blocks), "median", "center")
    asked = stored(asked.join(centers, "query_id"), "centers")
    mads = _wide(medians(asked, facts, _deviations, FEATURES, blocks), "median", "mad")
    sums = meet(asked, facts, _moments_of, "query_id string, name string, n long, s double, ss double", blocks).groupBy("query_id", "name").agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss")))
    spread = F.sqrt(F.greatest(F.try_divide(F.col("ss"), F.col("n")) - F.pow(F.try_divide(F.col("s"), F.col("n")), 2), F.lit(0.0)))
    both = mads.join(_wide(sums.withColumn("spread", spread), "spread", "spread"), "query_id")
    scale = lambda c: F.when(F.col(f"mad_{c}") * MAD_TO_STD > 1e-12, F.col(f"mad_{c}") * MAD_TO_STD).when(F.col(f"spread_{c}") > 1e-12, F.col(f"spread_{c}")).otherwise(1.0).alias(f"scale_{c}")
    return ready.join(both.select("query_id", *map(scale, FEATURES)), "query_id")


def _shapes(asked: pd.DataFrame, held: pd.DataFrame) -> np.ndarray:
    # rounded, so that an edge is met again by its own distance whatever block it is computed in
    return np.round(shape_matrix(asked, held), 12)


def _features(asked: pd.DataFrame, held: pd.DataFrame) -> np.ndarray:
    return sum(w * np.abs(held[c].to_numpy(float)[None] - asked[c].to_numpy(float)[:, None]) / asked[f"scale_{c}"].to_numpy(float)[:, None] for c, w in FEATURE_WEIGHTS.items())


def moded(scaled: DataFrame, library: DataFrame, blocks: tuple[int, int], pool: int = SHAPE_POOL) -> DataFrame:
    """scaled three times, once for each mode, with what the modes need to know of all that a moment sees.

    edge, edge_id: the last of the `pool` episodes of the most similar candle. fair: what brings shape distances to the
    median of the feature distances. A task keeps the pool of its block, so a moment costs `pool` rows for each block.
    """
    facts = library.select("episode_id", "timeframe", "fill_close_ms", *FEATURES)
    asked = stored(scaled.select("query_id", F.col("episode_id").alias("own_id"), "timeframe", "snapshot_ms", *FEATURES, *(f"scale_{c}" for c in FEATURES)), "mode-moments")

    def closest(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out, ids = [], held["episode_id"].to_numpy()
        for piece in chunks(asked, len(held)):
            shape = np.where(_seen(piece, held), _shapes(piece, held), np.inf)
            rows, cols = best_of(ids, piece["query_id"].to_numpy(), shape, pool)
            out.append(pd.DataFrame({"query_id": piece["query_id"].to_numpy()[rows], "episode_id": ids[cols], "shape": shape[rows, cols]}))
        return pd.concat(out)

    def both(asked: pd.DataFrame, held: pd.DataFrame) -> dict[str, np.ndarray]:
        seen = _seen(asked, held)
        return {"feature": np.where(seen, _features(asked, held), np.nan), "shape": np.where(seen, _shapes(asked, held), np.nan)}

    place = F.row_number().over(Window.partitionBy("query_id").orderBy("shape", "episode_id"))
    near = meet(asked, facts, closest, "query_id string, episode_id string, shape double", blocks).withColumn("place", place).where(F.col("place") <= pool)
    edges = near.groupBy("query_id").agg(F.max(F.struct("shape", "episode_id")).alias("e")).select("query_id", F.col("e.shape").alias("edge"), F.col("e.episode_id").alias("edge_id"))
    mid = lambda c: F.greatest(F.max(F.when(F.col("name") == c, F.col("median"))), F.lit(1e-12))
    fair = medians(asked, facts, both, ("feature", "shape"), blocks).groupBy("query_id").agg((mid("feature") / mid("shape")).alias("fair"))
    known = scaled.join(edges, "query_id").join(fair, "query_id").withColumn("mode", F.explode(F.array(*map(F.lit, MODES))))
    return known.withColumn("query_id", F.concat_ws("@", "query_id", "mode"))


def alignments(scaled: DataFrame, library: DataFrame, k: int, blocks: tuple[int, int]) -> DataFrame:
    """(query_id, episode_id, offset_bars, remaining_bars, current_move_pct, future_peak_move_pct, match_score, eligible, matched).

    The k best episodes of each moment, each at its best state, of equal ones the earliest; equal scores go by id.
    eligible and matched count all episodes that the moment saw, and those of them with a state to match. Episodes that
    lack a feature are not matched.

    With the columns of `moded` each moment is matched in its mode: by features and category; by features blended with
    the shape of the candle, whatever its direction; or by shape alone, among the pool of the most similar candles.
    """
    asked = scaled.select("query_id", F.col("episode_id").alias("own_id"), "asset", "timeframe", "direction", "snapshot_ms", *STATE_WEIGHTS, *FEATURES, *(f"scale_{c}" for c in FEATURES), *(c for c in _BY_MODE if c in scaled.columns))

    def nearest(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        has = held["offsets"].map(lambda x: x is not None and len(x) > 0).to_numpy(bool)
        facts = held[has].reset_index(drop=True)
        lengths = np.array([len(x) for x in facts["offsets"]], int)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        flat = {c: np.concatenate([np.asarray(x, float) for x in facts[c]]) if len(facts) else np.zeros(0) for c in ("offsets", "moves", "peaks", "drawdowns", "remaining", "futures")}
        logs = {c: np.log(np.maximum(flat[_STATE_COLUMNS[c]], 0.0) + floor) for c, (_, floor) in STATE_WEIGHTS.items()}
        out = []
        for piece in chunks(asked, max(len(held), starts[-1])):
            every = _seen(piece, held)
            if "mode" in piece:
                shape, edge, mode = _shapes(piece, held), piece["edge"].to_numpy(float)[:, None], piece["mode"].to_numpy()[:, None]
                pooled = (shape < edge) | (shape == edge) & (held["episode_id"].to_numpy()[None] <= piece["edge_id"].to_numpy()[:, None])
                every &= pooled | (mode != "archetype")
            counts = pd.DataFrame({"query_id": piece["query_id"].to_numpy(), "eligible": every.sum(axis=1), "matched": every[:, has].sum(axis=1)})
            out.append(counts)
            if not len(facts):
                continue
            column = lambda c: piece[c].to_numpy(float)[:, None]
            states = 0.0
            for c, (weight, floor) in STATE_WEIGHTS.items():
                states = states + weight * np.abs(logs[c][None] - np.log(np.maximum(column(c), 0.0) + floor))
            feature = _features(piece, facts)
            differs = {c: CATEGORY_PENALTIES[c] * (facts[c].to_numpy()[None] != piece[c].to_numpy()[:, None]) for c in CATEGORY_PENALTIES}
            signal = FEATURE_SHARE * feature + sum(differs.values())
            if "mode" in piece:
                shape = shape[:, has]
                blended = FEATURE_SHARE * ((1.0 - SHAPE_BLEND) * feature + SHAPE_BLEND * shape * column("fair")) + (1.0 - SHAPE_BLEND) * differs["asset"] + differs["timeframe"]
                signal = np.where(mode == "adaptive", signal, np.where(mode == "blended", blended, FEATURE_SHARE * SHAPE_MULTIPLIER * shape))
            score = np.minimum.reduceat(states, starts[:-1], axis=1) + signal
            score[~every[:, has]] = np.inf
            ids = facts["episode_id"].to_numpy()
            rows, cols = best_of(ids, piece["query_id"].to_numpy(), score, k)
            at = np.array([starts[c] + np.argmin(states[r, starts[c] : starts[c + 1]]) for r, c in zip(rows, cols)], int)
            out.append(pd.DataFrame({"query_id": piece["query_id"].to_numpy()[rows], "episode_id": ids[cols], "offset_bars": flat["offsets"][at], "remaining_bars": flat["remaining"][at], "current_move_pct": flat["moves"][at], "future_peak_move_pct": flat["futures"][at], "match_score": score[rows, cols]}))
        return pd.concat(out).reindex(columns=names)

    schema = "query_id string, episode_id string, offset_bars double, remaining_bars double, current_move_pct double, future_peak_move_pct double, match_score double, eligible double, matched double"
    names = [p.split()[0] for p in schema.split(", ")]
    met = stored(meet(asked, library, nearest, schema, blocks), "alignments")
    counts = met.where("eligible IS NOT NULL").groupBy("query_id").agg(F.sum("eligible").cast("long").alias("eligible"), F.sum("matched").cast("long").alias("matched"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("match_score", "episode_id"))
    found = met.where("episode_id IS NOT NULL").drop("eligible", "matched").withColumn("place", place).where(F.col("place") <= k).drop("place")
    whole = lambda c: F.col(c).cast("long").alias(c)
    return found.select("query_id", "episode_id", whole("offset_bars"), whole("remaining_bars"), "current_move_pct", "future_peak_move_pct", "match_score").join(counts, "query_id")


def _scored(asked: DataFrame, matched: DataFrame, episodes: DataFrame, least: int) -> DataFrame:
    """asked with what the three scenarios of each moment's matches said, whether they enclosed what came, and the errors of the normal one."""
    ready = asked.where("status = 'ready'")
    live = ready.select("query_id", F.col("current_move_pct").alias("q_move"), F.col("direction_sign").alias("q_sign"))
    facts = episodes.select("episode_id", "asset", "timeframe", "direction")
    cohort = project.projected_by_query(matched.where(F.col("matched") >= least).join(facts, "episode_id").join(live, "query_id"))
    told = project.scenarios(stored(cohort, "replay-cohort"), by=["query_id"])
    of = lambda s, c: F.max(F.when(F.col("scenario") == s, F.col(c)))
    wide = told.groupBy("query_id").agg(
        *(of(s, "remaining_bars").alias(f"{s}_remaining_bars") for s in ("fast", "normal", "extreme")), *(of(s, "projected_future_pct").alias(f"{s}_future_pct") for s in ("fast", "normal", "extreme")),
        *(of("normal", c).alias(f"normal_{c}") for c in ("episode_id", "offset_bars", "scale")),
        F.min("remaining_bars").alias("_least_bars"), F.max("remaining_bars").alias("_most_bars"), F.min("projected_future_pct").alias("_least_pct"), F.max("projected_future_pct").alias("_most_pct"),
    )
    counts = matched.select("query_id", "eligible").distinct()
    rows = asked.join(counts, "query_id", "left").join(wide, "query_id", "left")
    status = F.when(F.col("status") != "ready", F.col("status")).when(F.col("normal_remaining_bars").isNull(), "too_few_candidates").otherwise("evaluated")
    rows = rows.withColumn("status", status).withColumn("eligible", F.coalesce("eligible", F.lit(0)))
    rows = rows.withColumn("duration_covered", F.col("actual_remaining_bars").between(F.col("_least_bars"), F.col("_most_bars"))).withColumn("excursion_covered", F.col("actual_future_pct").between(F.col("_least_pct"), F.col("_most_pct")))
    return rows.withColumns(
        {
            "joint_covered": F.col("duration_covered") & F.col("excursion_covered"),
            "duration_log_error": F.abs(F.log1p(F.col("normal_remaining_bars").cast("double")) - F.log1p(F.col("actual_remaining_bars").cast("double"))),
            "excursion_error_pct": F.abs(F.col("normal_future_pct") - F.col("actual_future_pct")),
        }
    )


def replay(path_rows: DataFrame, states: DataFrame, episodes: DataFrame, offsets: Sequence[int], k: int = 80, least: int = 250, blocks: tuple[int, int] | None = None) -> DataFrame:
    """One row per moment: what the three scenarios of its past said, what came, and whether they enclosed it.

    status: evaluated, or why not: not_confirmed_departure, not_away_from_target, too_few_candidates (fewer than
    `least` episodes matched). Without episodes there are no moments.
    """
    asked = stored(moments(path_rows, states, episodes, offsets), "moments")
    library = stored(library_of(episodes, states), "replay-library")
    ready = asked.where("status = 'ready'")
    blocks = blocks or block_counts(ready, library)
    matched = alignments(stored(scaled_moments(ready, library, blocks), "scaled-moments"), library, k, blocks)
    return _scored(asked, matched, episodes, least).select(
        "query_id", "episode_id", "asset", "direction", "offset_bars", "snapshot_ms", "status", "eligible", "actual_remaining_bars", "actual_future_pct",
        *(f"{s}_remaining_bars" for s in ("fast", "normal", "extreme")), *(f"{s}_future_pct" for s in ("fast", "normal", "extreme")), "duration_covered", "excursion_covered", "joint_covered", "duration_log_error", "excursion_error_pct",
    )


def path_errors(cases: DataFrame, states: DataFrame, checkpoints: Sequence[int] = CHECKPOINTS) -> DataFrame:
    """(query_id, path_error_pct): mean distance between the told and the real move at the checkpoints after each snapshot.

    cases: (query_id, episode_id, offset_bars, actual_remaining_bars, normal_episode_id, normal_offset_bars,
    normal_remaining_bars, normal_scale). A route that has come to its fill stays at the target: its move is 0.
    """
    steps = cases.withColumn("h", F.explode(F.array(*map(F.lit, checkpoints))))
    at = lambda kind: states.select(F.col("episode_id").alias(f"{kind}_episode"), F.col("offset_bars").alias(f"{kind}_at"), F.col("current_move_pct").alias(f"{kind}_move"))
    steps = steps.select("query_id", "h", "actual_remaining_bars", "normal_remaining_bars", "normal_scale", F.col("episode_id").alias("real_episode"), (F.col("offset_bars") + F.col("h")).alias("real_at"), F.col("normal_episode_id").alias("told_episode"), (F.col("normal_offset_bars") + F.col("h")).alias("told_at"))
    met = steps.join(at("real"), ["real_episode", "real_at"], "left").join(at("told"), ["told_episode", "told_at"], "left")
    move = lambda left, value: F.when(F.col("h") >= F.col(left), 0.0).otherwise(F.greatest(value, F.lit(0.0)))
    off = F.abs(move("normal_remaining_bars", F.col("told_move") * F.col("normal_scale")) - move("actual_remaining_bars", F.col("real_move")))
    return met.groupBy("query_id").agg(F.avg(off).alias("path_error_pct"))


def shape_replay(path_rows: DataFrame, states: DataFrame, episodes: DataFrame, reference: DataFrame, offsets: Sequence[int], most_distance: float = 2.0, k: int = 80, least: int = 80, pool: int = SHAPE_POOL, checkpoints: Sequence[int] = CHECKPOINTS, blocks: tuple[int, int] | None = None) -> DataFrame:
    """One row per moment and mode, for the episodes whose candle is at most `most_distance` from the reference's.

    Each moment is answered three times by its own past, with features, features blended with the candle's shape, and
    shape alone (`moded`); `path_error_pct` is how far the normal scenario's route was from the real one (`path_errors`).
    reference: one row with the seven features. status as in `replay`. All modes go through one scan.
    """
    one = single(reference.select(*(F.col(c).alias(f"q_{c}") for c in FEATURES)), "reference")
    # one row
    alike = episodes.crossJoin(F.broadcast(one)).withColumn("reference_distance", shape_distance()).drop(*(f"q_{c}" for c in FEATURES)).where(F.col("reference_distance") <= most_distance)
    asked = stored(moments(path_rows, states, alike.drop("reference_distance"), offsets), "moments")
    library = stored(library_of(episodes, states), "replay-library")
    ready = asked.where("status = 'ready'")
    blocks = blocks or block_counts(ready, library)
    scaled = stored(scaled_moments(ready, library, blocks), "scaled-moments")
    matched = alignments(stored(moded(scaled, library, blocks, pool), "moded-moments"), library, k, blocks)
    every = asked.withColumn("moment_id", F.col("query_id")).withColumn("mode", F.explode(F.array(*map(F.lit, MODES)))).withColumn("query_id", F.concat_ws("@", "query_id", "mode"))
    cases = stored(_scored(every, matched, episodes, least), "shape-cases")
    told = path_errors(cases.where("status = 'evaluated'"), states, checkpoints)
    return cases.join(told, "query_id", "left").join(alike.select("episode_id", "reference_distance"), "episode_id").select(
        "moment_id", "mode", "episode_id", "asset", "direction", "offset_bars", "reference_distance", "status", "eligible", "actual_remaining_bars", "actual_future_pct", "normal_episode_id", "path_error_pct", "duration_covered", "excursion_covered", "joint_covered", "duration_log_error", "excursion_error_pct"
    )


def mode_report(cases: DataFrame) -> DataFrame:
    """By mode and age, and by mode over all (offset_bars NULL): evaluated moments and episodes, errors of the normal route, coverage."""
    done = cases.where("status = 'evaluated'")
    share = lambda c: F.avg(F.col(c).cast("double")).alias(c.replace("covered", "coverage"))
    mid = lambda c: F.percentile(c, 0.5).alias(f"median_{c}")
    every = done.withColumn("age", F.explode(F.array("offset_bars", F.lit(None)))).groupBy("mode", F.col("age").alias("offset_bars"))
    return every.agg(F.count("*").alias("cases"), F.count_distinct("episode_id").alias("episodes"), F.avg("path_error_pct").alias("mean_path_error_pct"), mid("path_error_pct"), mid("duration_log_error"), mid("excursion_error_pct"), *map(share, ("duration_covered", "excursion_covered", "joint_covered")))


def mode_gains(cases: DataFrame, draws: int = 500) -> DataFrame:
    """(mode, paired_moments, lower_error_share, gain, low, high): how much nearer each other mode's routes were than the adaptive one's, on the moments that all answered.

    Errors that agree to nine digits are equal: two modes often tell the same route. A mode without paired moments has no row.
    """
    paths = by_mode(cases.where("status = 'evaluated'").select("moment_id", "episode_id", "mode", "path_error_pct"), ["moment_id", "episode_id"], "mode", "path_error_pct", MODES)
    out = None
    for mode in MODES[1:]:
        counts = paths.agg(F.lit(mode).alias("mode"), F.count("*").alias("paired_moments"), F.avg((F.round(mode, 9) < F.round(MODES[0], 9)).cast("double")).alias("lower_error_share")).where("paired_moments > 0")
        # two single rows
        row = counts.crossJoin(paired_bootstrap(paths, "episode_id", MODES[0], mode, draws))
        out = row if out is None else out.unionByName(row)
    return out


def report(cases: DataFrame) -> DataFrame:
    """By age, and over all (offset_bars NULL): how many moments, how many evaluated, coverage and median errors of these."""
    share = lambda c: F.avg(F.col(c).cast("double")).alias(c.replace("covered", "coverage"))
    mid = lambda c: F.percentile(c, 0.5).alias(f"median_{c}")
    return cases.rollup("offset_bars").agg(F.count("*").alias("moments"), F.count_if(F.col("status") == "evaluated").alias("evaluated"), *map(share, ("duration_covered", "excursion_covered", "joint_covered")), mid("duration_log_error"), mid("excursion_error_pct"))
