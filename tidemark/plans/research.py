"""Registered queries of replays, forecasts and searches over many settings, each beside the SQL that it must equal."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import age_bucket, age_support
from tidemark.functions.storage import run_dir, stored
from tidemark.operators import evaluate, features, folds, forests, library, match, outcomes, replay, retrieval, stats, support, trace, variants, windows
from tidemark.plans import catalogue as cat
from tidemark.plans import oracle as O
from tidemark.plans.catalogue import query
from tidemark.plans.oracle import FEATURES, MATCH_K, r, sql
from tidemark.sources import artifacts
from tidemark.sources import candles as C

# Replay of all past moments

OFFSETS, LEAST_MATCHED = (2, 4, 8, 16), 20


def _replay_sql() -> dict[str, str]:
    feature = " + ".join(f"{w} * abs(g.{f} - m.{f}) / z_{f}.scale" for f, w in match.FEATURE_WEIGHTS.items())
    log = lambda a, b, f: f"abs(ln((greatest({a}, 0.0) + {f}) / (greatest({b}, 0.0) + {f})))"
    state = " + ".join(f"{w} * {log(a, b, f)}" for (w, f), a, b in zip(match.STATE_WEIGHTS.values(), ("s.current_move_pct", "s.peak_move_pct", "s.drawdown_pct", "CAST(s.offset_bars AS DOUBLE)"), ("m.current_move_pct", "m.peak_move_pct", "m.drawdown_pct", "m.elapsed_bars")))
    other = "CASE WHEN g.asset <> m.asset THEN 0.35 ELSE 0.0 END + CASE WHEN g.direction <> m.direction THEN 0.1 ELSE 0.0 END"
    pick = lambda name, score, before: f"SELECT * FROM choice_rows {'WHERE ' + ' AND '.join(f'(query_id, episode_id) NOT IN (SELECT (query_id, episode_id) FROM {b})' for b in before) if before else ''} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round({score}, 12), match_score, episode_id) = 1"
    return {
        "moments": f"SELECT s.episode_id || '@' || s.offset_bars AS query_id, s.episode_id, s.asset, s.timeframe, s.direction, s.direction_sign, s.offset_bars, p.open_time + e.interval_minutes * 60000 AS snapshot_ms, s.current_move_pct, s.peak_move_pct, s.drawdown_pct, CAST(s.offset_bars AS DOUBLE) AS elapsed_bars, s.remaining_bars AS actual_remaining_bars, greatest(s.future_peak_move_pct, 0.0) AS actual_future_pct, CASE WHEN s.offset_bars < s.signal_to_departure_bars THEN 'not_confirmed_departure' WHEN s.current_move_pct <= 0 THEN 'not_away_from_target' ELSE 'ready' END AS status, {', '.join('e.' + f for f in FEATURES)} FROM states s JOIN paths p ON p.episode_id = s.episode_id AND p.offset_bars = s.offset_bars JOIN episodes e ON e.episode_id = s.episode_id WHERE s.offset_bars IN {OFFSETS} AND s.remaining_bars > 0",
        "seen_by": f"SELECT m.query_id, e.episode_id, e.asset, e.direction, {', '.join('e.' + f for f in FEATURES)} FROM moments m JOIN episodes e ON e.fill_close_ms <= m.snapshot_ms AND e.timeframe = m.timeframe AND e.episode_id <> m.episode_id WHERE m.status = 'ready'",
        **{f"z_{f}": O.robust("seen_by", f, "first_usable", "query_id") for f in FEATURES},
        "aligned": f"SELECT m.query_id, g.episode_id, s.offset_bars, s.remaining_bars, s.current_move_pct, s.future_peak_move_pct, {state} + 0.5 * ({feature}) + {other} AS match_score FROM moments m JOIN seen_by g ON g.query_id = m.query_id {' '.join(f'JOIN z_{f} ON z_{f}.query_id = m.query_id' for f in FEATURES)} JOIN states s ON s.episode_id = g.episode_id AND s.candidate",
        "bests": "SELECT * FROM aligned QUALIFY row_number() OVER (PARTITION BY query_id, episode_id ORDER BY match_score, offset_bars) = 1",
        "cohorts": f"SELECT b.*, m.current_move_pct / b.current_move_pct AS scale, greatest(greatest(b.future_peak_move_pct, 0.0) * (m.current_move_pct / b.current_move_pct), 0.0) AS projected_future_pct FROM bests b JOIN moments m ON m.query_id = b.query_id JOIN (SELECT query_id, count(*) AS matched FROM bests GROUP BY 1) k ON k.query_id = b.query_id AND matched >= {LEAST_MATCHED} QUALIFY row_number() OVER (PARTITION BY b.query_id ORDER BY match_score, b.episode_id) <= {MATCH_K}",
        "rank_rows": f"SELECT *, cume_dist() OVER (PARTITION BY query_id ORDER BY joint_risk) AS joint_percentile, {O.average_pct_rank('match_score', 'query_id')} AS match_percentile, count(*) OVER (PARTITION BY query_id) AS cohort FROM (SELECT *, round(0.55 * {O.average_pct_rank('remaining_bars', 'query_id')} + 0.45 * {O.average_pct_rank('projected_future_pct', 'query_id')}, 12) AS joint_risk FROM cohorts)",
        "mid_rows": "SELECT query_id, md, mm, greatest(quantile_cont(abs(ln(1.0 + remaining_bars) - md), 0.5) * 1.4826, stddev_pop(ln(1.0 + remaining_bars)), 1e-6) AS sd, greatest(quantile_cont(abs(projected_future_pct - mm), 0.5) * 1.4826, stddev_pop(projected_future_pct), 1e-6) AS sm FROM cohorts JOIN (SELECT query_id, quantile_cont(ln(1.0 + remaining_bars), 0.5) AS md, quantile_cont(projected_future_pct, 0.5) AS mm FROM cohorts GROUP BY 1) USING (query_id) GROUP BY 1, 2, 3",
        "choice_rows": "SELECT x.*, abs(joint_percentile - 0.25) + 0.18 * match_percentile AS fast_score, abs(ln(1.0 + remaining_bars) - md) / sd + abs(projected_future_pct - mm) / sm + 0.2 * match_percentile AS normal_score, abs(joint_percentile - 0.9) + 0.18 * match_percentile AS extreme_score FROM rank_rows x JOIN mid_rows y ON y.query_id = x.query_id WHERE cohort >= 12",
        "fast_rows": pick("fast", "fast_score", ()),
        "normal_rows": pick("normal", "normal_score", ("fast_rows",)),
        "extreme_rows": pick("extreme", "extreme_score", ("fast_rows", "normal_rows")),
        "told": "SELECT f.query_id, f.remaining_bars AS fast_remaining_bars, n.remaining_bars AS normal_remaining_bars, x.remaining_bars AS extreme_remaining_bars, f.projected_future_pct AS fast_future_pct, n.projected_future_pct AS normal_future_pct, x.projected_future_pct AS extreme_future_pct FROM fast_rows f JOIN normal_rows n ON n.query_id = f.query_id JOIN extreme_rows x ON x.query_id = f.query_id",
        "cases": """SELECT *, actual_remaining_bars BETWEEN least(fast_remaining_bars, normal_remaining_bars, extreme_remaining_bars) AND greatest(fast_remaining_bars, normal_remaining_bars, extreme_remaining_bars) AS duration_covered,
          actual_future_pct BETWEEN least(fast_future_pct, normal_future_pct, extreme_future_pct) AND greatest(fast_future_pct, normal_future_pct, extreme_future_pct) AS excursion_covered,
          abs(ln(1.0 + normal_remaining_bars) - ln(1.0 + actual_remaining_bars)) AS duration_log_error, abs(normal_future_pct - actual_future_pct) AS excursion_error_pct
          FROM (SELECT m.query_id, m.episode_id, m.asset, m.direction, m.offset_bars, m.snapshot_ms, CASE WHEN m.status <> 'ready' THEN m.status WHEN t.query_id IS NULL THEN 'too_few_candidates' ELSE 'evaluated' END AS status, m.actual_remaining_bars, m.actual_future_pct, t.* EXCLUDE (query_id),
            CASE WHEN m.query_id IN (SELECT query_id FROM bests) THEN (SELECT count(*) FROM seen_by g WHERE g.query_id = m.query_id) ELSE 0 END AS eligible FROM moments m LEFT JOIN told t ON t.query_id = m.query_id)""",
    }


def _replayed(spark: SparkSession, d: str) -> DataFrame:
    e = cat.hourly(spark, d)
    t = cat.traced(e)
    paths, episodes = stored(library.paths(t, e), "paths"), stored(library.episodes(t, e), "episodes")
    states = stored(library.states(paths, episodes), "states")
    return replay.replay(paths, states, episodes, OFFSETS, MATCH_K, LEAST_MATCHED)


_numbers = ("actual_future_pct", "fast_future_pct", "normal_future_pct", "extreme_future_pct", "duration_log_error", "excursion_error_pct")


@query(sql(f"SELECT query_id, episode_id, asset, direction, offset_bars, snapshot_ms, status, eligible, actual_remaining_bars, fast_remaining_bars, normal_remaining_bars, extreme_remaining_bars, {', '.join(map(r, _numbers))}, duration_covered, excursion_covered, duration_covered AND excursion_covered AS joint_covered FROM cases", **_replay_sql()))
def path_replay(spark, d):
    """Every episode at four ages, answered by what had ended by then: coverage and errors of each moment."""
    return _replayed(spark, d)


@query(sql(f"SELECT offset_bars, count(*) AS moments, count_if(status = 'evaluated') AS evaluated, {r('avg(CAST(duration_covered AS DOUBLE))', 'duration_coverage')}, {r('avg(CAST(excursion_covered AS DOUBLE))', 'excursion_coverage')}, {r('avg(CAST(duration_covered AND excursion_covered AS DOUBLE))', 'joint_coverage')}, {r('quantile_cont(duration_log_error, 0.5)', 'median_duration_log_error')}, {r('quantile_cont(excursion_error_pct, 0.5)', 'median_excursion_error_pct')} FROM cases GROUP BY ROLLUP (offset_bars)", **_replay_sql()))
def path_replay_report(spark, d):
    return replay.report(_replayed(spark, d))


# Replay of moments like a given candle, in three modes

#: the newest episode's candle is the one that is asked about; the tables' candles lie far apart
ALIKE, SHAPE_POOL = 50.0, 30


def _shape_replay_sql() -> dict[str, str]:
    base = _replay_sql()
    feature = " + ".join(f"{w} * abs(g.{f} - m.{f}) / z_{f}.scale" for f, w in match.FEATURE_WEIGHTS.items())
    scales = " ".join(f"JOIN z_{f} ON z_{f}.query_id = m.query_id" for f in FEATURES)
    shape = O._SHAPE.replace("e.", "g.").replace("q.", "m.")
    out = {
        "pinned": "SELECT * FROM episodes ORDER BY signal_open_ms DESC, episode_id DESC LIMIT 1",
        "alike": f"SELECT e.episode_id, {O._SHAPE} AS reference_distance FROM episodes e, pinned q WHERE {O._SHAPE} <= {ALIKE}",
        "asked_moments": base["moments"] + " AND s.episode_id IN (SELECT episode_id FROM alike)",
        "moments": f"SELECT query_id || '@' || mode AS query_id, query_id AS moment_id, mode, * EXCLUDE (query_id) FROM asked_moments, (VALUES {', '.join(f"('{m}')" for m in replay.MODES)}) t(mode)",
        **{k: q for k, q in base.items() if k == "seen_by" or k.startswith("z_")},
        "pair_rows": f"SELECT m.query_id, m.mode, g.episode_id, {feature} AS feature, round({shape}, 12) AS shape, CASE WHEN g.asset <> m.asset THEN 0.35 ELSE 0.0 END AS o_asset, CASE WHEN g.direction <> m.direction THEN 0.1 ELSE 0.0 END AS o_direction FROM moments m JOIN seen_by g ON g.query_id = m.query_id {scales}",
        "fairs": "SELECT query_id, greatest(quantile_cont(feature, 0.5), 1e-12) / greatest(quantile_cont(shape, 0.5), 1e-12) AS fair FROM pair_rows GROUP BY 1",
        "signal_rows": f"SELECT p.query_id, episode_id, CASE mode WHEN 'adaptive' THEN 0.5 * feature + o_asset + o_direction WHEN 'blended' THEN 0.5 * (0.7 * feature + 0.3 * shape * fair) + 0.7 * o_asset ELSE 0.75 * shape END AS signal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shape, episode_id) AS place FROM pair_rows) p JOIN fairs f ON f.query_id = p.query_id WHERE mode <> 'archetype' OR place <= {SHAPE_POOL}",
        **{k: q for k, q in base.items() if k not in ("moments", "seen_by") and not k.startswith("z_")},
    }
    head, _, rest = out["aligned"].partition(" + 0.5 * (")
    out["aligned"] = f"{head} + g.signal AS match_score FROM moments m JOIN signal_rows g ON g.query_id = m.query_id JOIN states s{rest.partition(' JOIN states s')[2]}"
    out["told"] = out["told"].replace("SELECT f.query_id,", "SELECT f.query_id, n.episode_id AS normal_episode_id, n.offset_bars AS normal_offset_bars, n.scale AS normal_scale,")
    out["cases"] = out["cases"].replace("SELECT m.query_id,", "SELECT m.query_id, m.moment_id, m.mode,").replace("FROM seen_by g", "FROM signal_rows g")
    out["route_steps"] = f"""SELECT c.query_id, CASE WHEN h >= c.normal_remaining_bars THEN 0.0 ELSE greatest(n.current_move_pct * c.normal_scale, 0.0) END AS told, CASE WHEN h >= c.actual_remaining_bars THEN 0.0 ELSE greatest(a.current_move_pct, 0.0) END AS actual
      FROM cases c CROSS JOIN (VALUES {', '.join(f'({h})' for h in replay.CHECKPOINTS)}) t(h) LEFT JOIN states n ON n.episode_id = c.normal_episode_id AND n.offset_bars = c.normal_offset_bars + h LEFT JOIN states a ON a.episode_id = c.episode_id AND a.offset_bars = c.offset_bars + h WHERE c.status = 'evaluated'"""
    out["route_errors"] = "SELECT query_id, avg(abs(told - actual)) AS path_error_pct FROM route_steps GROUP BY 1"
    out["shape_cases"] = "SELECT c.*, duration_covered AND excursion_covered AS joint_covered, path_error_pct, reference_distance FROM cases c LEFT JOIN route_errors r ON r.query_id = c.query_id JOIN alike a ON a.episode_id = c.episode_id"
    return out


def _shape_replayed(spark: SparkSession, d: str) -> DataFrame:
    e = cat.hourly(spark, d)
    t = cat.traced(e)
    paths, episodes = stored(library.paths(t, e), "paths"), stored(library.episodes(t, e), "episodes")
    states = stored(library.states(paths, episodes), "states")
    pinned = episodes.orderBy(F.desc("signal_open_ms"), F.desc("episode_id")).limit(1)
    return stored(replay.shape_replay(paths, states, episodes, pinned, OFFSETS, ALIKE, MATCH_K, LEAST_MATCHED, SHAPE_POOL), "shape-replay")


_case_numbers = ("reference_distance", "actual_future_pct", "path_error_pct", "duration_log_error", "excursion_error_pct")


@query(sql(f"SELECT moment_id, mode, episode_id, asset, direction, offset_bars, status, eligible, actual_remaining_bars, normal_episode_id, {', '.join(map(r, _case_numbers))}, duration_covered, excursion_covered, joint_covered FROM shape_cases", **_shape_replay_sql()))
def shape_replay(spark, d):
    """Moments of candles like the newest one, answered by features, by features and shape, and by shape alone: whose route was nearer."""
    return _shape_replayed(spark, d)


def _mode_report_sql() -> str:
    share = lambda c: r(f"avg(CAST({c} AS DOUBLE))", c.replace("covered", "coverage"))
    mid = lambda c: r(f"quantile_cont({c}, 0.5)", f"median_{c}")
    columns = [r("avg(path_error_pct)", "mean_path_error_pct"), *map(mid, ("path_error_pct", "duration_log_error", "excursion_error_pct")), *map(share, ("duration_covered", "excursion_covered", "joint_covered"))]
    return sql(f"SELECT mode, offset_bars, count(*) AS cases, count(DISTINCT episode_id) AS episodes, {', '.join(columns)} FROM shape_cases WHERE status = 'evaluated' GROUP BY GROUPING SETS ((mode), (mode, offset_bars))", **_shape_replay_sql())


@query(_mode_report_sql())
def shape_replay_report(spark, d):
    return replay.mode_report(_shape_replayed(spark, d))


def _mode_gains_sql() -> str:
    value = lambda m: f"min(CASE WHEN mode = '{m}' THEN path_error_pct END) AS {m}"
    first, *others = replay.MODES
    each = " UNION ALL ".join(f"SELECT '{m}' AS mode, episode_id, {first} AS a, {m} AS b FROM mode_paths" for m in others)
    factors = ", ".join(f"({k}, {f})" for k, f in enumerate(evaluate.draw_factors(cat.DRAWS), 1))
    weight = " + ".join(f"CAST(spot >= {p!r} AS INT)" for p in evaluate._POISSON)
    tables = {
        "mode_paths": f"SELECT * FROM (SELECT moment_id, episode_id, {', '.join(map(value, replay.MODES))} FROM shape_cases WHERE status = 'evaluated' GROUP BY 1, 2) WHERE {' AND '.join(f'{m} IS NOT NULL' for m in replay.MODES)}",
        "mode_pairs": each,
        "mode_episodes": f"SELECT mode, CAST('0x' || substr(md5('7:' || episode_id), 1, 12) AS BIGINT) % {evaluate.PRIME - 1} + 1 AS h, avg(a) AS a, avg(b) AS b FROM mode_pairs GROUP BY mode, episode_id",
        "mode_draws": f"SELECT mode, 0 AS draw, 1 AS w, a, b FROM mode_episodes UNION ALL SELECT mode, draw, {weight}, a, b FROM (SELECT mode, draw, a, b, (h * f % {evaluate.PRIME}) / {evaluate.PRIME}.0 AS spot FROM mode_episodes, (VALUES {factors}) t(draw, f))",
        "mode_sums": "SELECT mode, draw, 1.0 - sum(w * b) / sum(w * a) AS gain FROM mode_draws GROUP BY 1, 2",
        "mode_counts": "SELECT mode, count(*) AS paired_moments, avg(CAST(round(b, 9) < round(a, 9) AS DOUBLE)) AS lower_error_share FROM mode_pairs GROUP BY 1",
    }
    return sql(f"SELECT mode, paired_moments, {r('lower_error_share')}, {r('max(CASE WHEN draw = 0 THEN gain END)', 'gain')}, {r('quantile_cont(CASE WHEN draw > 0 THEN gain END, 0.025)', 'low')}, {r('quantile_cont(CASE WHEN draw > 0 THEN gain END, 0.975)', 'high')} FROM mode_sums JOIN mode_counts USING (mode) GROUP BY 1, 2, 3", **_shape_replay_sql(), **tables)


@query(_mode_gains_sql())
def shape_replay_gains(spark, d):
    """How much nearer the routes of the other two modes come than the adaptive one's, and how sure that is."""
    return replay.mode_gains(_shape_replayed(spark, d), cat.DRAWS)


# Many settings in one scan

TESTED_HORIZONS, NEAREST = (6, 12, 24), 25
_FACTS = {"state": ("log_age_minutes", "log_entry_distance", "log_peak_distance", "upper_wick"), "context": ("entry_range_pct", "entry_body_pct", "signal_to_entry_return")}
_VIEWS = {"pre": 12, "recent": 12, "episode": 16}


def _settings_sql(variants: dict[str, tuple[dict[str, float], float]]) -> dict[str, str]:
    facts = {
        "log_age_minutes": "ln(1 + o.age_bars * 60)", "log_entry_distance": "ln(1 + o.now)", "log_peak_distance": "ln(1 + o.peak)", "upper_wick": "CAST(o.direction = 'upper_wick' AS DOUBLE)",
        "entry_range_pct": "(c.high - c.low) / greatest(o.entry_price, 1e-12) * 100.0", "entry_body_pct": "abs(o.entry_price - c.open) / greatest(o.entry_price, 1e-12) * 100.0", "signal_to_entry_return": "coalesce(o.direction_sign * (o.entry_price / nullif(s.close, 0) - 1.0) * 100.0, 0.0)",
    }
    weights = ", ".join(f"('{n}', '{b}', {w})" for n, (ws, _) in variants.items() for b, w in ws.items())
    shares = ", ".join(f"('{n}', {share})" for n, (_, share) in variants.items())
    ratio = lambda n: f"CASE WHEN m.variant = 'BASE' THEN 1.0 ELSE m.{n} / greatest(b.{n}, 1e-12) END"
    three = [ratio(n) for n in ("fill_brier", "adverse_error_pct", "wait_error_bars")]
    return {
        **cat._fingerprint_tables(),
        "asked": f"SELECT o.* FROM observed o JOIN touched t USING (observation_id) WHERE t.available_bars >= {max(TESTED_HORIZONS)} AND o.signal_open_time >= (SELECT max(signal_open_time) FROM observed) - {3 * cat.DAY}",
        "learnt": f"SELECT o.* FROM observed o JOIN touched t USING (observation_id) WHERE t.available_bars >= {max(TESTED_HORIZONS)} AND o.entry_close_time + {max(TESTED_HORIZONS) * cat.HOUR} <= (SELECT min(entry_close_time) FROM asked)",
        "facts": f"SELECT o.observation_id, {', '.join(f'{x} AS {n}' for n, x in facts.items())} FROM observed o JOIN e c ON c.asset = o.asset AND c.bar_index = o.entry_index JOIN e s ON s.asset = o.asset AND s.bar_index = o.signal_index",
        "longs": " UNION ALL ".join(f"SELECT observation_id, '{b}' AS block, '{n}' AS name, {n} AS value FROM facts" for b, ns in _FACTS.items() for n in ns) + " UNION ALL SELECT observation_id, view, CAST(point AS VARCHAR), value FROM printed",
        "learnt_longs": "SELECT l.* FROM longs l JOIN learnt USING (observation_id)",
        "units": O.robust("learnt_longs", "value", "first_usable", "block, name"),
        "widths": "SELECT block, CAST(count(DISTINCT name) AS DOUBLE) AS width FROM longs GROUP BY 1",
        "zs": "SELECT l.observation_id, l.block, l.name, greatest(least((l.value - u.center) / u.scale, 8.0), -8.0) / sqrt(w.width) AS z FROM longs l JOIN units u ON u.block = l.block AND u.name = l.name JOIN widths w ON w.block = l.block",
        "asked_z": "SELECT zs.* FROM zs JOIN asked USING (observation_id)",
        "learnt_z": "SELECT zs.*, signal_id FROM zs JOIN learnt USING (observation_id)",
        "by_block": "SELECT a.observation_id AS query_id, b.observation_id, b.signal_id, a.block, sum((a.z - b.z) * (a.z - b.z)) AS d FROM asked_z a JOIN learnt_z b ON a.block = b.block AND a.name = b.name GROUP BY 1, 2, 3, 4",
        "settings": f"SELECT * FROM (VALUES {weights}) t(variant, block, weight)",
        "seen_shares": f"SELECT * FROM (VALUES {shares}) t(variant, share)",
        "far": "SELECT query_id, w.variant, observation_id, signal_id, sqrt(sum(weight * weight * d)) AS distance FROM by_block b JOIN settings w ON w.block = b.block JOIN seen_shares h ON h.variant = w.variant AND CAST('0x' || substr(md5('history:' || b.signal_id), 1, 12) AS BIGINT) / 281474976710656.0 < h.share GROUP BY ALL",
        "nearest": f"SELECT query_id, variant, observation_id FROM (SELECT * FROM far QUALIFY row_number() OVER (PARTITION BY query_id, variant, signal_id ORDER BY distance, observation_id) = 1) QUALIFY row_number() OVER (PARTITION BY query_id, variant ORDER BY distance, signal_id) <= {NEAREST}",
        "bounds": cat._bounds_sql(lambda x, name: f"{x} AS {name}"),
        "told_rows": "SELECT n.query_id, n.variant, b.horizon_bars, avg(CAST(b.target_hit AS DOUBLE)) AS fill, quantile_cont(b.max_adverse_upper_pct, 0.5) AS adverse_pct, coalesce(quantile_cont(CASE WHEN b.target_hit THEN CAST(t.target_bars AS DOUBLE) END, 0.5), b.horizon_bars) AS wait_bars FROM nearest n JOIN bounds b ON b.observation_id = n.observation_id JOIN touched t ON t.observation_id = n.observation_id GROUP BY 1, 2, 3",
        "missed": "SELECT x.variant, x.horizon_bars, a.signal_id, count(*) AS n, avg(pow(x.fill - CAST(b.target_hit AS DOUBLE), 2)) AS f, avg(abs(x.adverse_pct - b.max_adverse_upper_pct)) AS a, avg(CASE WHEN b.target_hit THEN abs(x.wait_bars - t.target_bars) END) AS w FROM told_rows x JOIN asked a ON a.observation_id = x.query_id JOIN bounds b ON b.observation_id = x.query_id AND b.horizon_bars = x.horizon_bars JOIN touched t ON t.observation_id = x.query_id GROUP BY 1, 2, 3",
        "measured": "SELECT variant, horizon_bars, CAST(sum(n) AS BIGINT) AS queries, avg(f) AS fill_brier, avg(a) AS adverse_error_pct, avg(w) AS wait_error_bars FROM missed GROUP BY 1, 2",
        "compared": f"SELECT m.*, ({' + '.join(three)}) / 3.0 AS mean_error_ratio, greatest({', '.join(three)}) AS worst_error_ratio FROM measured m JOIN measured b ON b.horizon_bars = m.horizon_bars AND b.variant = 'BASE'",
    }


def _searched(spark: SparkSession, d: str, settings: dict[str, tuple[dict[str, float], float]]) -> DataFrame:
    """Errors of each setting on the observations of the last three days, from those whose horizons had passed by then."""
    e = cat.hourly(spark, d)
    blocks = cat.blocked(e)
    o, touched = cat._touched(e, blocks)
    bounds = stored(outcomes.adverse_bounds(o, touched, blocks, TESTED_HORIZONS), "bounds")
    whole = o.join(touched.where(F.col("available_bars") >= max(TESTED_HORIZONS)).select("observation_id"), "observation_id")
    newest = F.broadcast(o.agg((F.max("signal_open_time") - 3 * cat.DAY).alias("_begin")))
    asked = whole.crossJoin(newest).where(F.col("signal_open_time") >= F.col("_begin")).select(F.col("observation_id"), "signal_id", "entry_close_time")
    first = F.broadcast(asked.agg(F.min("entry_close_time").alias("_first")))
    history = whole.crossJoin(first).where(F.col("entry_close_time") + max(TESTED_HORIZONS) * cat.HOUR <= F.col("_first")).select("observation_id", "signal_id")
    facts = features.of_observations(o, e, (6, 24), (3, 12), ())
    longs = [stats.long(facts, ns, "observation_id").withColumn("block", F.lit(b)) for b, ns in _FACTS.items()]
    printed = features.fingerprint(o, e, 24, 12).select("observation_id", F.col("point").cast("string").alias("name"), "value", F.col("view").alias("block"))
    values = stored(longs[0].unionByName(longs[1]).unionByName(printed), "block-values")
    names = dict(_FACTS) | {v: tuple(map(str, range(n))) for v, n in _VIEWS.items()}
    vectors = stored(variants.block_vectors(values, history, names), "block-vectors")
    queries = asked.select(F.col("observation_id").alias("query_id"), "signal_id").join(vectors.withColumnRenamed("observation_id", "query_id"), "query_id")
    found = variants.search(queries, history.withColumn("place", variants.sample_place("signal_id")).join(vectors, "observation_id"), settings, NEAREST)
    waits = touched.select("observation_id", "target_bars")
    told = variants.forecasts(stored(found, "variants"), bounds, waits)
    return stored(variants.errors(told, queries.select("query_id", "signal_id"), bounds, waits), "variant-errors")


_CONFIGS = {name: (weights, 1.0) for name, weights in variants.configurations().items()}
_errors = ("fill_brier", "adverse_error_pct", "wait_error_bars")
_ratios = ("mean_error_ratio", "worst_error_ratio")


@query(sql(f"SELECT variant, horizon_bars, queries, {', '.join(map(r, (*_errors, *_ratios)))}, worst_error_ratio <= 1.02 AND row_number() OVER (PARTITION BY horizon_bars ORDER BY CASE WHEN worst_error_ratio <= 1.02 THEN 0 ELSE 1 END, mean_error_ratio, variant) = 1 AS selected FROM compared", **{n: q.replace("'BASE'", "'state'") for n, q in _settings_sql(_CONFIGS).items()}))
def fingerprint_configs(spark, d):
    """All 21 weightings of the blocks in one scan, and the one that is selected at each horizon."""
    return variants.chosen(_searched(spark, d, _CONFIGS), "state", 0.02)


_SHARES = {f"share_{p}": ({"state": 1.0, "context": 1.0}, p / 100) for p in (20, 40, 60, 80, 100)}


@query(sql(f"SELECT variant, horizon_bars, queries, {', '.join(map(r, _errors))} FROM measured", **_settings_sql(_SHARES)))
def learning_curve(spark, d):
    """How errors fall as the history grows: nested samples of 20 to 100 per cent of its signals in one scan."""
    return _searched(spark, d, _SHARES)


# Trees

_TREE_COLUMNS = ("current_move_pct", "peak_move_pct", "drawdown_pct", "elapsed_bars", *FEATURES)


@query()
def forest_quantiles(spark, d):
    """What is left to the fill and the move until then, at three quantiles, for the last part of all moments by the forests of the first."""
    e = cat.hourly(spark, d)
    t = cat.traced(e)
    paths, episodes = stored(library.paths(t, e), "paths"), stored(library.episodes(t, e), "episodes")
    moments = replay.moments(paths, stored(library.states(paths, episodes), "states"), episodes, OFFSETS).where("status = 'ready'")
    logs = {"remaining": F.log1p(F.col("actual_remaining_bars").cast("double")), "excursion": F.log1p("actual_future_pct")}
    # what is learnt from had ended before the first moment that is asked about
    rows = stored(folds.chrono_split(moments.withColumns(logs).join(episodes.select("episode_id", "fill_close_ms"), "episode_id"), "snapshot_ms", 0.7, 0.0), "forest-rows")
    first = F.broadcast(rows.where("part = 'test'").agg(F.min("snapshot_ms").alias("_first")))
    # in a fixed order, as trees draw their samples by it
    train, asked = stored(rows.where("part = 'train'").crossJoin(first).where("fill_close_ms <= _first").drop("_first").orderBy("query_id"), "forest-train"), rows.where("part = 'test'")
    out = None
    for target in logs:
        model = forests.fit_forest(train, _TREE_COLUMNS, target)
        if model is None:
            return spark.createDataFrame([], "query_id string, target string, q10 double, q50 double, q90 double, actual double")
        values = forests.leaf_values(forests.leaves(model, train, target), target)
        told = forests.forest_quantiles(forests.leaves(model, asked, "query_id"), stored(values, "leaf-values"), (0.1, 0.5, 0.9))
        one = told.join(asked.select("query_id", F.col(target).alias("_y")), "query_id").select("query_id", F.lit(target).alias("target"), *(F.expm1(c).alias(c) for c in ("q10", "q50", "q90")), F.expm1("_y").alias("actual"))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def stacked_forecast(spark, d):
    """Fills and adverse moves of the newest observations by a stack over two base systems, learnt out of fold from what was known before."""
    e = cat.hourly(spark, d)
    blocks = cat.blocked(e)
    o, touched = cat._touched(e, blocks)
    bounds = outcomes.adverse_bounds(o, touched, blocks, (12,)).where(F.col("fully_observed") | F.col("target_hit"))
    known = bounds.select("observation_id", F.col("target_hit").cast("double").alias("hit"), F.col("max_adverse_upper_pct").alias("adverse"))
    facts = features.of_observations(o, e, (6, 24), (3, 12), ("click", "error", "purchase", "signup", "view"))
    printed = features.as_vectors(features.fingerprint(o, e, 24, 12))
    views = printed.select("observation_id", *(F.coalesce(F.try_element_at("vector", F.lit(k + 1)), F.lit(0.0)).alias(f"view_{k}") for k in range(0, sum(_VIEWS.values()), 4)))
    rows = o.select("observation_id", "signal_id", "signal_open_time", "entry_close_time").join(facts, "observation_id").join(views, "observation_id").join(known, "observation_id", "left")
    rows = stored(folds.chrono_split(rows, "signal_open_time", 0.7, 0.0), "stack-rows")
    first = F.broadcast(rows.where("part = 'test'").agg(F.min("signal_open_time").alias("_first")))
    train = stored(rows.where("part = 'train'").crossJoin(first).where(F.col("entry_close_time") + 12 * cat.HOUR <= F.col("_first")).drop("_first").orderBy("observation_id"), "stack-train")
    systems = {"facts": facts.columns[1:], "views": [*facts.columns[1:], *views.columns[1:]]}
    targets = {"hit": "chance", "adverse": "amount"}
    stack = forests.fit_stack(train, systems, targets, "signal_id", folds=2)
    told = forests.predict_stack(rows.where("part = 'test'"), stack, list(systems), targets)
    return told.select("observation_id", "signal_id", "hit", "adverse", "facts_hit", "views_hit", "stacked_hit", "facts_adverse", "views_adverse", "stacked_adverse")


# Windows of raw candles

_LENGTHS, _ROUTE = {"pre": 12, "recent": 12}, 16
_log1 = lambda x: f"sign({x}) * ln(1 + abs({x}))"


def _windows_sql() -> str:
    pct = lambda c: O._pct(f"c.{c}", "greatest(o.wick_target, 1e-12)", "o.direction_sign")
    raw = f"""
    SELECT w.observation_id, w.view, CAST(w.k AS INT) AS point, {', '.join(f"coalesce({_log1(pct(c))}, 0.0) AS {c}" for c in ('open', 'high', 'low', 'close'))},
      coalesce(least(greatest(o.direction_sign * ln(greatest(c.close, 1e-12) / greatest(CASE WHEN c.bar_index = w.first THEN c.close ELSE b.close END, 1e-12)) * 100.0, -20.0), 20.0), 0.0) AS change,
      coalesce(ln(1 + abs(c.high - c.low) / greatest(o.wick_target, 1e-12) * 100.0), 0.0) AS range, coalesce(ln(1 + greatest(c.volume, 0.0) / greatest(s.volume, 1e-12)), 0.0) AS volume,
      coalesce(CAST(c.bar_index >= o.signal_index AS DOUBLE), 0.0) AS after_signal, CAST(c.bar_index IS NOT NULL AS DOUBLE) AS present
    FROM wanted w JOIN observed o ON o.observation_id = w.observation_id JOIN e s ON s.asset = o.asset AND s.bar_index = o.signal_index
      LEFT JOIN e c ON c.asset = o.asset AND c.bar_index = w.i LEFT JOIN e b ON b.asset = o.asset AND b.bar_index = w.i - 1"""
    route = f"""
    SELECT o.observation_id, k, c.bar_index - o.signal_index AS x, {', '.join(f'{pct(c)} AS {c}' for c in ('open', 'high', 'low', 'close'))}, greatest(c.volume, 0.0) / greatest(s.volume, 1e-12) AS volume,
      k * (o.entry_index - o.signal_index) / {_ROUTE - 1}.0 AS spot
    FROM observed o JOIN e s ON s.asset = o.asset AND s.bar_index = o.signal_index, (SELECT unnest(generate_series(0, {_ROUTE - 1})) AS k) JOIN e c ON c.asset = o.asset AND c.bar_index BETWEEN o.signal_index + floor(k * (o.entry_index - o.signal_index) / {_ROUTE - 1}.0) AND o.signal_index + floor(k * (o.entry_index - o.signal_index) / {_ROUTE - 1}.0) + 1 AND c.bar_index <= o.entry_index"""
    between = lambda v: f"arg_min({v}, x) + (max(spot) - min(x)) * (arg_max({v}, x) - arg_min({v}, x))"
    return sql(
        f"SELECT observation_id, view, point, {', '.join(r(c) for c in windows.CHANNELS)} FROM raws UNION ALL SELECT observation_id, 'episode', CAST(k AS INT), {', '.join(r(_log1(c), c) for c in ('open', 'high', 'low', 'close'))}, NULL, {r('ln(1 + size)', 'range')}, {r('ln(1 + volume)', 'volume')}, NULL, NULL FROM (SELECT observation_id, k, {', '.join(f'{between(c)} AS {c}' for c in ('open', 'high', 'low', 'close', 'volume'))}, {between('abs(high - low)')} AS size FROM routes GROUP BY 1, 2)",
        wanted=f"SELECT observation_id, 'pre' AS view, k, signal_index - {_LENGTHS['pre']} + k AS i, greatest(signal_index - {_LENGTHS['pre']}, 0) AS first FROM observed, (SELECT unnest(generate_series(0, {_LENGTHS['pre'] - 1})) AS k) UNION ALL SELECT observation_id, 'recent', k, entry_index - {_LENGTHS['recent'] - 1} + k, greatest(entry_index - {_LENGTHS['recent'] - 1}, 0) FROM observed, (SELECT unnest(generate_series(0, {_LENGTHS['recent'] - 1})) AS k)",
        raws=raw, routes=route,
    )


@query(_windows_sql())
def sample_windows(spark, d):
    """Raw windows before each signal and entry, and the route between them, from blocks that are written once."""
    e = cat.hourly(spark, d)
    found = stored(windows.samples(cat._observed(e), windows.written(e), _LENGTHS, _ROUTE), "windows")
    none = lambda rows: rows.select("observation_id", "view", "point", *((F.col(c) if c in rows.columns else F.lit(None).cast("double").alias(c)) for c in windows.CHANNELS))
    return none(windows.long_points(found, "pre", windows.CHANNELS)).unionByName(none(windows.long_points(found, "recent", windows.CHANNELS))).unionByName(none(windows.long_points(found, "episode", windows.ROUTE_CHANNELS)))


# Two-stage retrieval: the table's embeddings stand for an encoder's, its first values for the scalar state, two more for outcomes

_POOL, _KEPT = 24, 8
_shares = {name: dict(shares) for name, shares in retrieval.MODES.items()}


def _retrieval_sql() -> str:
    scalar = " + ".join(f"{w} * abs(q.c{k} - x.c{k}) / s{k}.scale" for k, w in ((1, 1.8), (2, 1.2), (3, 0.4)))

    def mode(name: str, shares: dict[str, float]) -> str:
        inside = " OR ".join(f"place_{c} <= {_POOL}" for c in shares)
        d = next(iter(shares)) if len(shares) == 1 else " + ".join(f"{w} * {c} / greatest(quantile_cont({c}, 0.5) OVER (PARTITION BY query_id), 1e-6)" for c, w in shares.items())
        return f"SELECT '{name}' AS mode, query_id, candidate_id, group_id, {d} AS distance FROM placed WHERE {inside}"

    lerp = lambda q: f"SELECT mode, query_id, arg_min(CASE WHEN ls IS NULL THEN value ELSE lv + ({q} - ls) / (s - ls) * (value - lv) END, row(s, value, candidate_id)) AS x FROM steps WHERE s >= {q} GROUP BY 1, 2"
    return sql(
        f"SELECT a.mode, a.query_id, {r('a.x', 'p10')}, {r('b.x', 'p50')}, {r('c.x', 'p90')}, f.candidate_id AS nearest, {r('f.distance', 'nearest_distance')} FROM t10 a JOIN t50 b USING (mode, query_id) JOIN t90 c USING (mode, query_id) JOIN firsts f ON f.mode = a.mode AND f.query_id = a.query_id AND f.place = 1",
        facts="SELECT vec_id, label, embedding, CAST(embedding[1] AS DOUBLE) AS c1, CAST(embedding[2] AS DOUBLE) AS c2, CAST(embedding[3] AS DOUBLE) AS c3, CAST(embedding[4] AS DOUBLE) AS o1, CAST(embedding[5] AS DOUBLE) AS o2 FROM vectors",
        **{f"s{k}": O.robust("facts", f"c{k}", "first_usable") for k in (1, 2, 3)},
        **{f"w{k}": f"SELECT greatest(quantile_cont(o{k}, 0.75) - quantile_cont(o{k}, 0.25), 0.05) AS unit FROM facts" for k in (1, 2)},
        usual="SELECT label, avg(o1) AS f1, avg(o2) AS f2 FROM facts GROUP BY 1",
        measured_pairs=f"SELECT q.vec_id AS query_id, x.vec_id AS candidate_id, x.label AS group_id, {scalar} AS scalar, greatest(1.0 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(x.embedding AS DOUBLE[])), 0.0) AS embedding, (abs(u.f1 - x.o1) / w1.unit + abs(u.f2 - x.o2) / w2.unit) / 2.0 AS forecast FROM facts q JOIN usual u ON u.label = q.label JOIN facts x ON x.vec_id <> q.vec_id, s1, s2, s3, w1, w2 WHERE q.vec_id % 50 = 0",
        placed="SELECT *, " + ", ".join(f"row_number() OVER (PARTITION BY query_id ORDER BY {c}, candidate_id) AS place_{c}" for c in retrieval.DISTANCES) + " FROM measured_pairs",
        combined=" UNION ALL ".join(mode(n, s) for n, s in _shares.items()),
        firsts=f"SELECT *, row_number() OVER (PARTITION BY mode, query_id ORDER BY distance, candidate_id) AS place FROM (SELECT * FROM combined QUALIFY row_number() OVER (PARTITION BY mode, query_id, group_id ORDER BY distance, candidate_id) = 1) QUALIFY row_number() OVER (PARTITION BY mode, query_id ORDER BY distance, candidate_id) <= {_KEPT}",
        weighed="SELECT *, CAST(candidate_id % 100 AS DOUBLE) AS value, exp(-distance / greatest(quantile_cont(distance, 0.5) OVER (PARTITION BY mode, query_id), 1e-4)) + 1e-6 AS w FROM firsts",
        steps="SELECT *, lag(s) OVER (PARTITION BY mode, query_id ORDER BY value, candidate_id) AS ls, lag(value) OVER (PARTITION BY mode, query_id ORDER BY value, candidate_id) AS lv FROM (SELECT *, sum(w) OVER (PARTITION BY mode, query_id ORDER BY value, candidate_id ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY mode, query_id) AS s FROM weighed)",
        t10=lerp(0.1), t50=lerp(0.5), t90=lerp(0.9),
    )


@query(_retrieval_sql())
def retrieval_modes(spark, d):
    """Five ways to rank real outcomes for a query, from exact pools by three distances."""
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", "embedding", *(F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate(("c1", "c2", "c3", "o1", "o2"))))
    scales = {x.name: x.scale for x in stats.robust_scales(stats.long(rows, ["c1", "c2", "c3"])).collect()}
    units = rows.agg(*(F.greatest(F.percentile(c, 0.75) - F.percentile(c, 0.25), F.lit(0.05)).alias(c) for c in ("o1", "o2"))).first()
    scalar = F.array(*(w * F.col(c) / F.lit(scales.get(c, 1.0)) for c, w in (("c1", 1.8), ("c2", 1.2), ("c3", 0.4)))).alias("scalar")
    space = lambda a, b: F.array(F.col(a) / F.lit(units.o1), F.col(b) / F.lit(units.o2)).alias("forecast")
    usual = rows.groupBy("label").agg(F.avg("o1").alias("f1"), F.avg("o2").alias("f2"))
    queries = rows.where("vec_id % 50 = 0").join(usual, "label").select(F.col("vec_id").alias("query_id"), scalar, "embedding", space("f1", "f2"))
    candidates = rows.select(F.col("vec_id").alias("candidate_id"), F.col("label").alias("group_id"), scalar, "embedding", space("o1", "o2"))
    found = stored(retrieval.ranked(retrieval.pools(queries, candidates, _POOL), _POOL, _KEPT), "retrieved")
    told = retrieval.quantiles(retrieval.weighed(found).withColumn("value", (F.col("candidate_id") % 100).cast("double")), "value")
    first = found.where("place = 1").select("mode", "query_id", F.col("candidate_id").alias("nearest"), F.col("distance").alias("nearest_distance"))
    return told.join(first, ["mode", "query_id"])


# Ages: buckets that weigh alike, capped samples, and which ages were sampled

_AGE_BUCKETS = ((1, 2, "1-2"), (3, 6, "3-6"), (7, 12, "7-12"), (13, 48, "13-48"))
_CAP, _SAMPLED = 150, (2, 6, 12, 24)
_bucket = "CASE " + " ".join(f"WHEN offset_bars BETWEEN {a} AND {b} THEN '{name}'" for a, b, name in _AGE_BUCKETS) + " END"


def _aged_states(spark: SparkSession, d: str) -> DataFrame:
    e = cat.hourly(spark, d)
    t = cat.traced(e)
    rows = cat._states(e, t).where("candidate").select("episode_id", "asset", "direction", "offset_bars")
    return stored(rows.withColumn("bucket", age_bucket(F.col("offset_bars"), _AGE_BUCKETS)), "aged-states")


_aged_sql = {"aged_states": f"SELECT episode_id, asset, direction, offset_bars, {_bucket} AS bucket FROM states WHERE candidate"}


@query(sql(f"SELECT episode_id, offset_bars, bucket, {r('w / avg(w) OVER ()', 'weight')} FROM weighed_states", **_aged_sql, weighed_states="SELECT s.*, 1.0 / (count(*) OVER (PARTITION BY bucket, episode_id) * (SELECT count(DISTINCT x.episode_id) FROM aged_states x WHERE x.bucket = s.bucket)) AS w FROM aged_states s"))
def age_balanced_weights(spark, d):
    return folds.age_balanced_weights(_aged_states(spark, d), "episode_id", "bucket").select("episode_id", "offset_bars", "bucket", "weight")


_spaced = lambda i, n, m: f"({n} <= {m} OR CASE WHEN {m} > 1 THEN coalesce((SELECT bool_or(CAST(floor(g.k * ({n} - 1) / ({m} - 1)) AS BIGINT) = {i}) FROM (SELECT unnest(generate_series(0, {_CAP})) AS k) g WHERE g.k < {m}), false) ELSE {i} = 0 END)"


@query(sql(
    "SELECT episode_id, offset_bars, bucket FROM taken UNION ALL SELECT episode_id, offset_bars, bucket FROM (SELECT *, row_number() OVER (ORDER BY episode_id, offset_bars) - 1 AS i, count(*) OVER () AS n, (SELECT " + str(_CAP) + " - count(*) FROM taken) AS m FROM aged_states WHERE (episode_id, offset_bars) NOT IN (SELECT (episode_id, offset_bars) FROM taken)) x WHERE m > 0 AND " + _spaced("x.i", "x.n", "x.m"),
    **_aged_sql,
    strata_rows=f"SELECT *, row_number() OVER (PARTITION BY bucket, asset, direction ORDER BY episode_id, offset_bars) - 1 AS i, count(*) OVER (PARTITION BY bucket, asset, direction) AS n, (SELECT greatest(1, {_CAP} // count(*)) FROM (SELECT DISTINCT bucket, asset, direction FROM aged_states)) AS m FROM aged_states",
    taken="SELECT s.* FROM strata_rows s WHERE " + _spaced("s.i", "s.n", "s.m"),
))
def age_stratified_cap(spark, d):
    """At most 150 states, with a quota for every age, series and direction, and evenly spaced ones of the rest."""
    return folds.stratified_cap(_aged_states(spark, d), _CAP, ["bucket", "asset", "direction"], ["episode_id", "offset_bars"], ["episode_id", "offset_bars"]).select("episode_id", "offset_bars", "bucket")


@query(sql(f"SELECT offset_bars, count(*) AS states, CASE WHEN offset_bars IN {_SAMPLED} THEN 'exact_sampled_age' WHEN offset_bars BETWEEN {min(_SAMPLED)} AND {max(_SAMPLED)} THEN 'between_sampled_ages' ELSE 'outside_sampled_age' END AS status, (SELECT max(a) FROM (SELECT unnest([{', '.join(map(str, _SAMPLED))}]) AS a) WHERE a <= offset_bars) AS lower, (SELECT min(a) FROM (SELECT unnest([{', '.join(map(str, _SAMPLED))}]) AS a) WHERE a >= offset_bars) AS upper FROM aged_states GROUP BY offset_bars", **_aged_sql))
def snapshot_age_support(spark, d):
    rows = _aged_states(spark, d).groupBy("offset_bars").agg(F.count("*").alias("states"))
    return rows.withColumn("s", age_support(F.col("offset_bars"), _SAMPLED)).select("offset_bars", "states", "s.status", "s.lower", "s.upper")


# How far a neighbourhood can be trusted, by an artifact that is tied to its source

_SUPPORT_POOL, _SUPPORT_K, _SUPPORT_HORIZON = 96, 12, 12


def _support_sql() -> str:
    z = {n: f"z_{n}" for n in ("log_age_minutes", "log_entry_distance", "log_peak_distance")}
    facts = {"log_age_minutes": "ln(1 + o.age_bars * 60)", "log_entry_distance": "ln(1 + o.now)", "log_peak_distance": "ln(1 + o.peak)"}
    vector = ", ".join(f"least(greatest((f.{n} - u_{n}.center) / u_{n}.scale, -8.0), 8.0) / sqrt(3.0) AS {c}" for n, c in z.items())
    distance = "sqrt(" + " + ".join(f"pow(a.{c} - b.{c}, 2)" for c in z.values()) + ")"
    lerp = "SELECT query_id, arg_min(v, row(v, candidate_id)) AS adverse_p50 FROM (SELECT *, sum(w) OVER (PARTITION BY query_id ORDER BY v ROWS UNBOUNDED PRECEDING) AS u, sum(w) OVER (PARTITION BY query_id) AS a FROM near_weights) WHERE u >= 0.5 * a GROUP BY 1"
    share = lambda c: f"(SELECT count(*) FROM supports c WHERE c.part = 'calibration' AND c.{c} <= s.{c}) / CAST((SELECT count(*) FROM supports c WHERE c.part = 'calibration') AS DOUBLE)"
    return sql(
        f"SELECT query_id, raw_neighbours, {', '.join(map(r, ('effective_neighbours', 'agreement', 'same_asset_share', 'fill_probability', 'adverse_p50', 'median_percentile', 'nearest_percentile')))}, CAST(least(floor(median_percentile * 5), 4) AS INT) AS level, effective_neighbours < 8.0 OR median_percentile >= 0.8 AS low_support FROM (SELECT s.*, p.adverse_p50, {share('median_distance')} AS median_percentile, {share('nearest_distance')} AS nearest_percentile FROM supports s JOIN p50 p USING (query_id) WHERE s.part = 'asked')",
        seen=f"SELECT o.*, t.available_bars FROM observed o JOIN touched t USING (observation_id)",
        seen_whole="SELECT * FROM seen WHERE available_bars >= 24",
        edge="SELECT t AS b FROM (SELECT signal_open_time AS t, row_number() OVER (ORDER BY signal_open_time) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT signal_open_time FROM seen)) WHERE k = greatest(CAST(floor(n * 0.8) AS BIGINT), 1)",
        parted=f"SELECT observation_id, signal_id, asset, CASE WHEN signal_open_time >= b THEN 'calibration' ELSE 'history' END AS part FROM seen_whole, edge, (SELECT min(entry_close_time) AS f FROM seen_whole, edge WHERE signal_open_time >= b) WHERE signal_open_time >= b OR entry_close_time + {_SUPPORT_HORIZON * cat.HOUR} <= f UNION ALL SELECT observation_id, signal_id, asset, 'asked' FROM seen WHERE available_bars < 24",
        facts=f"SELECT o.observation_id, p.part, p.signal_id, p.asset, {', '.join(f'{x} AS {n}' for n, x in facts.items())} FROM observed o JOIN parted p USING (observation_id)",
        learnt="SELECT * FROM facts WHERE part = 'history'",
        **{f"u_{n}": O.robust("learnt", n, "first_usable") for n in z},
        vecs=f"SELECT f.observation_id, f.part, f.signal_id, f.asset, {vector} FROM facts f, {', '.join(f'u_{n}' for n in z)}",
        far=f"SELECT a.observation_id AS query_id, a.part, a.asset AS own_asset, b.observation_id AS candidate_id, b.signal_id, b.asset, {distance} AS distance FROM vecs a JOIN vecs b ON b.part = 'history' AND a.part <> 'history' QUALIFY row_number() OVER (PARTITION BY a.observation_id ORDER BY {distance}, b.observation_id) <= {_SUPPORT_POOL}",
        firsts=f"SELECT * FROM (SELECT * FROM far QUALIFY row_number() OVER (PARTITION BY query_id, signal_id ORDER BY distance, candidate_id) = 1) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, candidate_id) <= {_SUPPORT_K}",
        bounds=cat._bounds_sql(lambda x, name: f"{x} AS {name}"),
        near_weights=f"SELECT f.*, CAST(b.target_hit AS DOUBLE) AS y, b.max_adverse_upper_pct AS v, exp(-f.distance / greatest(quantile_cont(f.distance, 0.5) OVER (PARTITION BY f.query_id), 1e-9)) AS w FROM firsts f JOIN bounds b ON b.observation_id = f.candidate_id AND b.horizon_bars = {_SUPPORT_HORIZON}",
        supports="SELECT query_id, part, count(*) AS raw_neighbours, sum(w) * sum(w) / sum(w * w) AS effective_neighbours, min(distance) AS nearest_distance, quantile_cont(distance, 0.5) AS median_distance, greatest(sum(w * y) / sum(w), 1 - sum(w * y) / sum(w)) AS agreement, sum(w * y) / sum(w) AS fill_probability, sum(CASE WHEN asset = own_asset THEN w ELSE 0.0 END) / sum(w) AS same_asset_share FROM near_weights GROUP BY 1, 2",
        p50=lerp,
    )


@query(_support_sql())
def support_artifact(spark, d):
    """How well the newest observations' neighbourhoods are supported, by tables that were saved under their source's fingerprint."""
    root = f"{run_dir(spark)}/support-{uuid.uuid4().hex}"
    e = cat.hourly(spark, d)
    blocks = cat.blocked(e)
    o, touched = cat._touched(e, blocks)
    C.write_parquet(e, f"{root}/source")
    rows = o.join(touched.select("observation_id", "available_bars"), "observation_id").withColumn("fully_observed", F.col("available_bars") >= 24)
    facts = features.of_observations(o, e, (6, 24), (3, 12), ()).select("observation_id", *(names := ("log_age_minutes", "log_entry_distance", "log_peak_distance")))
    known = outcomes.adverse_bounds(o, touched, blocks, (_SUPPORT_HORIZON,)).select("observation_id", F.col("target_hit").cast("double").alias("label"), F.col("max_adverse_upper_pct").alias("value"))
    build = lambda: support.fitted(folds.calibration_tail(rows, 0.2, _SUPPORT_HORIZON * cat.HOUR), facts, names, known, _SUPPORT_POOL, _SUPPORT_K)
    held = artifacts.load_or_build(spark, f"{root}/artifact", artifacts.fingerprint(spark, f"{root}/source"), build)
    return support.supported(held, rows.where("NOT fully_observed").select("observation_id", "asset").join(facts, "observation_id"), names, _SUPPORT_POOL, _SUPPORT_K)


# JSON columns

@query("SELECT event_type, k % 10 AS digit, count(*) AS events, round(avg(value), 6) + 0.0 AS mean_value FROM (SELECT event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1, 2")
def event_props(spark, d):
    """Properties that stand as JSON in a column, parsed and grouped by."""
    rows = spark.read.parquet(f"{d}/events.parquet").withColumn("p", F.from_json("props", "k long"))
    return rows.groupBy("event_type", (F.col("p.k") % 10).alias("digit")).agg(F.count("*").alias("events"), F.avg("value").alias("mean_value"))


# The first pass over routes, and traces without caps

_first_pass_features = {n: ("{}.aligned_prior_1h_return_pct * {}.direction_sign" if n == "prior_1h_return_pct" else f"{{}}.{n}") for n in match.FIRST_PASS_WEIGHTS}


def _first_pass_sql() -> str:
    log = lambda a, b, f: f"abs(ln((greatest({a}, 0.0) + {f}) / (greatest({b}, 0.0) + {f})))"
    feature = " + ".join(f"coalesce({w} * abs(e.{n} - ({_first_pass_features[n].format('q', 'q')})) / z_{n}.scale, 0.0)" for n, w in match.FIRST_PASS_WEIGHTS.items())
    state = " + ".join(f"{w} * {log(a, b, f)}" for (w, f), a, b in zip(match.STATE_WEIGHTS.values(), ("p.move", "p.peak", "p.peak - p.move", "CAST(p.offset_bars AS DOUBLE)"), ("l.current_move_pct", "l.peak_move_pct", "l.drawdown_pct", "l.elapsed_bars")))
    return sql(
        f"SELECT episode_id, offset_bars, remaining_bars, {r('move', 'close_move_pct')}, {r('peak', 'peak_move_pct')}, {r('score')} FROM (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY score, offset_bars) = 1) ORDER BY score, episode_id LIMIT 25",
        named=f"SELECT e.episode_id, {', '.join(f'{x.format("e", "e")} AS {n}' for n, x in _first_pass_features.items())} FROM known e",
        **{f"z_{n}": O.robust("named", n, "raw") for n in match.FIRST_PASS_WEIGHTS},
        passed="SELECT episode_id, offset_bars, signal_to_fill_bars - offset_bars AS remaining_bars, normalized_close_pct AS move, max(greatest(normalized_open_pct, normalized_high_pct, normalized_low_pct, normalized_close_pct)) OVER (PARTITION BY episode_id ORDER BY offset_bars) AS peak FROM paths",
        scored=f"SELECT p.*, {state} + 0.5 * ({feature}) AS score FROM passed p JOIN named e USING (episode_id), q, live l, {', '.join(f'z_{n}' for n in match.FIRST_PASS_WEIGHTS)} WHERE remaining_bars > 0 AND move > 0",
    )


@query(_first_pass_sql())
def first_pass_analogues(spark, d):
    s = cat.Study(spark, d)
    return match.first_pass(s.paths, s.known, s.query, s.live, 25)


@query(sql(
    "SELECT signal_id, CASE WHEN early THEN 'filled_before_departure' WHEN d IS NULL THEN 'no_departure' WHEN g IS NULL THEN 'unfilled' ELSE 'filled' END AS status, CASE WHEN NOT early THEN d END AS departure_index, CASE WHEN NOT early THEN g END AS fill_index FROM (SELECT x.*, (SELECT min(c.bar_index) FROM e c WHERE c.asset = x.asset AND c.bar_index > x.d AND ((x.direction_sign = 1 AND c.low <= x.wick_target) OR (x.direction_sign = -1 AND c.high >= x.wick_target))) AS g FROM hits x)",
    hits=f"SELECT *, f IS NOT NULL AND (d IS NULL OR f <= d) AS early FROM (SELECT s.signal_id, s.asset, s.direction_sign, s.wick_target, min(CASE WHEN {O._TOUCH} THEN c.bar_index END) AS f, min(CASE WHEN {O._LEAVE} THEN c.bar_index END) AS d FROM relaxed s LEFT JOIN e c ON c.asset = s.asset AND c.bar_index > s.bar_index GROUP BY 1, 2, 3, 4)",
))
def trace_without_caps(spark, d):
    """Departures and fills however late they come."""
    e = cat.hourly(spark, d)
    return trace.trace_capped(cat.relaxed(e), e, None, None).select("signal_id", "status", "departure_index", "fill_index")
