"""The SQL that the registered queries must equal: common table expressions that build on each other, and how to end them."""

from __future__ import annotations

import re

from tidemark.operators.signals import FEATURES

FOLLOW_UP = 48
AGES, HORIZONS, THRESHOLDS = (2, 6, 12), (6, 12, 24), (5.0, 20.0, 50.0)
PANEL = {"6b": 6, "24b": 24, "48b": 48}
MATCH_K = 40

def r(expression: str, name: str | None = None) -> str:
    return f"round({expression}, 6) + 0.0 AS {name or expression}"


def _candles(table: str, key: str, time: str, price: str, order: str, seconds: int, volume: str) -> str:
    return f"""
    SELECT asset, '{seconds // 60}m' AS timeframe, {seconds // 60} AS interval_minutes, bucket * {seconds * 1000} AS open_time, bucket * {seconds * 1000} + {seconds * 1000 - 1} AS close_time,
      open, high, low, close, volume, row_number() OVER (PARTITION BY asset ORDER BY bucket) - 1 AS bar_index
    FROM (SELECT {key} AS asset, epoch_us({time}) // {seconds * 1_000_000} AS bucket, arg_min({price}, row({time}, {order})) AS open, max({price}) AS high, min({price}) AS low,
        arg_max({price}, row({time}, {order})) AS close, CAST(sum({volume}) AS DOUBLE) AS volume
      FROM {table} WHERE {time} IS NOT NULL AND {price} IS NOT NULL GROUP BY 1, 2)"""


def _shapes(source: str) -> str:
    part = lambda x: f"CASE WHEN high > low THEN {x} / (high - low) END"
    w = "PARTITION BY asset ORDER BY bar_index"
    prior = f"({w} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
    return f"""
    SELECT *, high - low AS rng, {part("abs(close - open)")} AS body, {part("(least(open, close) - low)")} AS lower_wick, {part("(high - greatest(open, close))")} AS upper_wick,
      CASE WHEN high > low THEN (high - low) / nullif(close, 0) * 100.0 END AS range_pct,
      CASE WHEN count(*) OVER {prior} = 20 THEN (high - low) / nullif(quantile_cont(high - low, 0.5) OVER {prior}, 0) END AS vs_median,
      CASE WHEN count(*) OVER {prior} = 20 THEN volume / nullif(avg(volume) OVER {prior}, 0) END AS vs_mean,
      (close / nullif(lag(close) OVER ({w}), 0) - 1.0) * 100.0 AS back_return
    FROM {source}"""


def _signals(shapes: str, body: float, dominant: float, opposite: float) -> str:
    wick = lambda a, b: f"rng > 0 AND body <= {body} AND {a}_wick >= {dominant} AND {b}_wick <= {opposite}"
    return f"""
    SELECT asset || '_' || timeframe || '_' || direction || '_' || CAST(open_time AS VARCHAR) AS signal_id, * FROM (
      SELECT asset, timeframe, interval_minutes, bar_index, open_time, close_time, CASE WHEN s = 1 THEN 'lower_wick' ELSE 'upper_wick' END AS direction, s AS direction_sign, open, high, low, close, volume,
        CASE WHEN s = 1 THEN low ELSE high END AS wick_target, CASE WHEN s = 1 THEN high ELSE low END AS opposite_extreme, body AS body_pct_of_range,
        CASE WHEN s = 1 THEN lower_wick ELSE upper_wick END AS dominant_wick_pct_of_range, CASE WHEN s = 1 THEN upper_wick ELSE lower_wick END AS opposite_wick_pct_of_range,
        range_pct AS range_pct_of_close, vs_median AS range_vs_prior_20_median, vs_mean AS volume_vs_prior_20_mean, s * back_return AS aligned_prior_1h_return_pct
      FROM (SELECT *, CASE WHEN {wick("lower", "upper")} THEN 1 WHEN {wick("upper", "lower")} THEN -1 ELSE 0 END AS s FROM {shapes}) WHERE s <> 0)
    WHERE {" AND ".join(f"{f} IS NOT NULL" for f in FEATURES)}"""


_TOUCH = "((s.direction_sign = 1 AND c.low <= s.wick_target) OR (s.direction_sign = -1 AND c.high >= s.wick_target))"
_LEAVE = "((s.direction_sign = 1 AND c.close >= s.opposite_extreme) OR (s.direction_sign = -1 AND c.close <= s.opposite_extreme))"


def _traced(signals: str, candles: str, bars: int) -> str:
    return f"""
    SELECT *, CASE WHEN status <> 'filled_before_departure' THEN first_departure END AS departure_index, CASE WHEN status = 'filled' THEN first_fill END AS fill_index FROM (
      SELECT *, CASE WHEN first_fill IS NOT NULL AND (first_departure IS NULL OR first_fill <= first_departure) THEN 'filled_before_departure' WHEN first_fill IS NOT NULL THEN 'filled'
        WHEN bar_index + {bars} >= series_bars THEN 'right_censored' WHEN first_departure IS NULL THEN 'no_departure' ELSE 'unfilled' END AS status
      FROM (SELECT s.*, n.series_bars, h.first_fill, h.first_departure FROM {signals} s JOIN (SELECT asset, max(bar_index) + 1 AS series_bars FROM {candles} GROUP BY 1) n USING (asset)
        LEFT JOIN (SELECT s.signal_id, min(CASE WHEN {_TOUCH} THEN c.bar_index END) AS first_fill, min(CASE WHEN {_LEAVE} THEN c.bar_index END) AS first_departure
          FROM {signals} s JOIN {candles} c ON c.asset = s.asset AND c.bar_index > s.bar_index AND c.bar_index <= s.bar_index + {bars} GROUP BY 1) h USING (signal_id)))"""


def _pct(price: str, target: str = "wick_target", sign: str = "direction_sign") -> str:
    return f"{sign} * ({price} / nullif({target}, 0) - 1.0) * 100.0"


def _competing(t: str, a: str, h: str, available: str) -> str:
    return f"CASE WHEN {t} <= {h} AND {a} <= {h} THEN CASE WHEN {t} = {a} THEN 'ambiguous_intrabar' WHEN {t} < {a} THEN 'target_first' ELSE 'adverse_first' END WHEN {t} <= {h} THEN 'target_first' WHEN {a} <= {h} THEN 'adverse_first' WHEN {available} >= {h} THEN 'neither' ELSE 'right_censored' END"


def robust(source: str, value: str, variant: str, by: str = "") -> str:
    """(by, center, scale) of a column."""
    keys, on = (f"{by}, ", f"USING ({by})") if by else ("", "ON true")
    group = f"GROUP BY {by}, center, spread" if by else "GROUP BY center, spread"
    mad = "mad" if variant == "raw" else "mad * 1.4826"
    scale = f"greatest({mad}, spread, 1e-6)" if variant == "largest" else f"CASE WHEN {mad} > 1e-12 THEN {mad} WHEN spread > 1e-12 THEN spread ELSE 1.0 END"
    return f"""SELECT {keys}center, {scale} AS scale FROM (SELECT {keys}center, spread, quantile_cont(abs({value} - center), 0.5) AS mad FROM {source}
      JOIN (SELECT {keys}quantile_cont({value}, 0.5) AS center, stddev_pop({value}) AS spread FROM {source} {"GROUP BY " + by if by else ""}) c {on} {group})"""


def average_pct_rank(value: str, by: str = "") -> str:
    p, both = (f"PARTITION BY {by} ", f"PARTITION BY {by}, {value}") if by else ("", f"PARTITION BY {value}")
    return f"((rank() OVER ({p}ORDER BY {value}) + (count(*) OVER ({both}) - 1) / 2.0) / count(*) OVER ({'PARTITION BY ' + by if by else ''}))"


_SHAPE = (
    "sqrt((pow(abs(e.body_pct_of_range - q.body_pct_of_range) * 100.0 / 0.75, 2) + pow(abs(e.dominant_wick_pct_of_range - q.dominant_wick_pct_of_range) * 100.0 / 3.0, 2) + pow(abs(e.opposite_wick_pct_of_range - q.opposite_wick_pct_of_range) * 100.0 / 3.0, 2)"
    " + pow(abs(ln(greatest(e.range_pct_of_close, 1e-12) / greatest(q.range_pct_of_close, 1e-12)) / ln(1.5)), 2) + pow(abs(ln(greatest(e.range_vs_prior_20_median, 1e-12) / greatest(q.range_vs_prior_20_median, 1e-12)) / ln(1.5)), 2)"
    " + pow(abs(ln(greatest(e.volume_vs_prior_20_mean, 1e-12) / greatest(q.volume_vs_prior_20_mean, 1e-12)) / ln(2.0)), 2) + pow(e.aligned_prior_1h_return_pct - q.aligned_prior_1h_return_pct, 2)) / 7.0)"
)
_WEIGHTS = (0.8, 0.8, 0.8, 0.6, 0.6, 0.5, 0.5)


def _scores() -> dict[str, str]:
    scales = " UNION ALL ".join(f"SELECT '{f}' AS name, scale FROM ({robust('known', f, 'first_usable')})" for f in FEATURES)
    feature = " + ".join(f"{w} * abs(e.{f} - q.{f}) / (SELECT scale FROM feature_scales WHERE name = '{f}')" for f, w in zip(FEATURES, _WEIGHTS))
    log = lambda a, b, f: f"abs(ln((greatest({a}, 0.0) + {f}) / (greatest({b}, 0.0) + {f})))"
    state = f"1.8 * {log('s.current_move_pct', 'l.current_move_pct', 0.3)} AS move_part, 1.2 * {log('s.peak_move_pct', 'l.peak_move_pct', 0.3)} AS peak_part, 1.2 * {log('s.drawdown_pct', 'l.drawdown_pct', 0.3)} AS drawdown_part, 0.4 * {log('CAST(s.offset_bars AS DOUBLE)', 'l.elapsed_bars', 3.0)} AS age_part"
    total = "move_part + peak_part + drawdown_part + age_part + adaptive_part + shape_part + category_part"
    out = {
        "feature_scales": scales,
        "raw_scores": f"SELECT e.episode_id, {feature} AS feature, {_SHAPE} AS shape, CAST(e.asset <> q.asset AS INT) AS o_asset, CAST(e.timeframe <> q.timeframe AS INT) AS o_time, CAST(e.direction <> q.direction AS INT) AS o_dir FROM known e, q",
        "scores_adaptive": "SELECT episode_id, feature AS adaptive, 0.0 AS shape, o_asset * 0.35 + o_time * 0.25 + o_dir * 0.1 AS category FROM raw_scores",
        "scores_blended": "SELECT episode_id, 0.7 * feature AS adaptive, 0.3 * shape * (SELECT greatest(quantile_cont(feature, 0.5), 1e-12) FROM raw_scores) / (SELECT greatest(quantile_cont(shape, 0.5), 1e-12) FROM raw_scores) AS shape, o_asset * 0.35 * 0.7 + o_time * 0.25 AS category FROM raw_scores",
        "scores_archetype": "SELECT episode_id, 0.0 AS adaptive, shape * 1.5 AS shape, 0.0 AS category FROM (SELECT * FROM raw_scores ORDER BY shape, episode_id LIMIT 240)",
    }
    for mode in ("adaptive", "blended", "archetype"):
        out[f"best_{mode}"] = f"""SELECT *, {total} AS match_score FROM (SELECT s.*, {state}, e.adaptive * 0.5 AS adaptive_part, e.shape * 0.5 AS shape_part, e.category AS category_part FROM states s JOIN scores_{mode} e USING (episode_id), live l WHERE s.candidate)
          QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY {total}, offset_bars) = 1"""
    return out


CTES: dict[str, str] = {
    "e": _candles("events", "event_type", "ts", "value", "event_id", 3600, "1"),
    "w": _candles("lineitem", "l_returnflag", "l_shipdate", "l_extendedprice", "row(l_orderkey, l_linenumber)", 604800, "l_quantity"),
    "e_shapes": _shapes("e"),
    "w_shapes": _shapes("w"),
    "signals": _signals("e_shapes", 0.05, 0.75, 0.2),
    "w_signals": _signals("w_shapes", 0.05, 0.75, 0.2),
    "relaxed": _signals("e_shapes", 0.15, 0.5, 0.45),
    "traced": _traced("relaxed", "e", FOLLOW_UP),
    "strict_traced": _traced("signals", "e", FOLLOW_UP),
    "w_traced": _traced("w_signals", "w", 52),
    "paths": f"""SELECT t.signal_id AS episode_id, t.asset, t.timeframe, t.direction, t.direction_sign, c.open_time, c.bar_index - t.bar_index AS offset_bars,
      CASE WHEN c.bar_index = t.bar_index THEN 'signal' WHEN c.bar_index < t.departure_index THEN 'pre_departure' WHEN c.bar_index = t.departure_index THEN 'departure' WHEN c.bar_index < t.fill_index THEN 'return_path' ELSE 'fill' END AS phase,
      c.open, c.high, c.low, c.close, c.volume, {", ".join(_pct("c." + x, "t.wick_target", "t.direction_sign") + f" AS normalized_{x}_pct" for x in ("open", "high", "low", "close"))},
      t.departure_index - t.bar_index AS signal_to_departure_bars, t.fill_index - t.bar_index AS signal_to_fill_bars
      FROM traced t JOIN e c ON c.asset = t.asset AND c.bar_index BETWEEN t.bar_index AND t.fill_index WHERE t.status = 'filled'""",
    "away": "SELECT *, CASE WHEN direction_sign = 1 THEN normalized_high_pct ELSE normalized_low_pct END AS peak_at_bar FROM paths",
    "episodes": f"""SELECT t.signal_id AS episode_id, t.asset, t.timeframe, t.interval_minutes, t.direction, t.direction_sign, t.open_time AS signal_open_ms, f.close_time + 1 AS fill_close_ms, t.wick_target,
      t.departure_index - t.bar_index AS signal_to_departure_bars, t.fill_index - t.bar_index AS signal_to_fill_bars, (t.fill_index - t.bar_index) * t.interval_minutes AS signal_to_fill_minutes, a.max_away_move_pct, a.time_to_max_away_bars, {", ".join("t." + f for f in FEATURES)}, t.bar_index, t.departure_index
      FROM traced t JOIN e f ON f.asset = t.asset AND f.bar_index = t.fill_index JOIN (SELECT episode_id, max(peak_at_bar) AS max_away_move_pct, arg_min(offset_bars, row(-peak_at_bar, offset_bars)) AS time_to_max_away_bars FROM away GROUP BY 1) a ON a.episode_id = t.signal_id WHERE t.status = 'filled'""",
    "states": """SELECT *, greatest(peak_move_pct - current_move_pct, 0.0) AS drawdown_pct, coalesce(offset_bars > 0 AND remaining_bars > 0 AND offset_bars >= signal_to_departure_bars AND current_move_pct > 0 AND future_peak_move_pct IS NOT NULL, false) AS candidate
      FROM (SELECT episode_id, asset, timeframe, direction, direction_sign, offset_bars, normalized_close_pct AS current_move_pct, signal_to_departure_bars, signal_to_fill_bars - offset_bars AS remaining_bars,
        max(peak_at_bar) OVER (PARTITION BY episode_id ORDER BY offset_bars) AS peak_move_pct, max(peak_at_bar) OVER (PARTITION BY episode_id ORDER BY offset_bars ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS future_peak_move_pct FROM away)""",
    # the matched signal: the last episode, as it stood when it departed; known: what had ended by then
    "q": "SELECT * FROM (SELECT e.*, d.close_time + 1 AS snapshot_ms FROM episodes e JOIN e d ON d.asset = e.asset AND d.bar_index = e.departure_index) ORDER BY signal_open_ms DESC, episode_id DESC LIMIT 1",
    "known": "SELECT e.* FROM episodes e, q WHERE e.fill_close_ms <= q.snapshot_ms AND e.episode_id <> q.episode_id",
    "live": "SELECT s.current_move_pct, s.peak_move_pct, s.drawdown_pct, CAST(s.offset_bars AS DOUBLE) AS elapsed_bars FROM states s, q WHERE s.episode_id = q.episode_id AND s.offset_bars = q.signal_to_departure_bars",
    **_scores(),
    "cohort": f"""SELECT b.*, l.current_move_pct / b.current_move_pct AS scale, greatest(b.future_peak_move_pct, 0.0) AS historical_future_pct, greatest(greatest(b.future_peak_move_pct, 0.0) * (l.current_move_pct / b.current_move_pct), 0.0) AS projected_future_pct,
      greatest(greatest(greatest(b.future_peak_move_pct, 0.0) * (l.current_move_pct / b.current_move_pct), 0.0) - l.current_move_pct, 0.0) * 100.0 / (100.0 + q.direction_sign * l.current_move_pct) AS projected_adverse_pct
      FROM (SELECT * FROM best_adaptive ORDER BY match_score, episode_id LIMIT {MATCH_K}) b, live l, q""",
    "ranked": f"""SELECT *, cume_dist() OVER (ORDER BY joint_risk) AS joint_percentile, {average_pct_rank("match_score")} AS match_percentile, count(*) OVER () AS cohort FROM (
      SELECT *, round(0.55 * {average_pct_rank("remaining_bars")} + 0.45 * {average_pct_rank("projected_future_pct")}, 12) AS joint_risk FROM cohort)""",
    "middles": """SELECT md, mm, greatest(quantile_cont(abs(ln(1.0 + remaining_bars) - md), 0.5) * 1.4826, stddev_pop(ln(1.0 + remaining_bars)), 1e-6) AS sd, greatest(quantile_cont(abs(projected_future_pct - mm), 0.5) * 1.4826, stddev_pop(projected_future_pct), 1e-6) AS sm
      FROM cohort, (SELECT quantile_cont(ln(1.0 + remaining_bars), 0.5) AS md, quantile_cont(projected_future_pct, 0.5) AS mm FROM cohort) GROUP BY md, mm""",
    "choices": """SELECT r.*, abs(joint_percentile - 0.25) + 0.18 * match_percentile AS fast_score, abs(ln(1.0 + remaining_bars) - md) / sd + abs(projected_future_pct - mm) / sm + 0.2 * match_percentile AS normal_score, abs(joint_percentile - 0.9) + 0.18 * match_percentile AS extreme_score,
      (SELECT count(*) FROM ranked x WHERE x.joint_risk >= r.joint_risk) / CAST(cohort AS DOUBLE) AS tail_share FROM ranked r, middles WHERE cohort >= 12""",
    "pick_fast": "SELECT 'fast' AS scenario, * FROM choices ORDER BY round(fast_score, 12), match_score, episode_id LIMIT 1",
    "pick_normal": "SELECT 'normal' AS scenario, * FROM choices WHERE episode_id NOT IN (SELECT episode_id FROM pick_fast) ORDER BY round(normal_score, 12), match_score, episode_id LIMIT 1",
    "pick_extreme": "SELECT 'extreme' AS scenario, * FROM choices WHERE episode_id NOT IN (SELECT episode_id FROM pick_fast UNION ALL SELECT episode_id FROM pick_normal) ORDER BY round(extreme_score, 12), match_score, episode_id LIMIT 1",
    "picks": "SELECT * FROM pick_fast UNION ALL SELECT * FROM pick_normal UNION ALL SELECT * FROM pick_extreme",
    "aged": f"""SELECT t.*, a.age_bars, t.bar_index + a.age_bars AS entry_index, CASE WHEN t.bar_index + a.age_bars >= t.series_bars THEN 'entry_not_observed' WHEN t.departure_index IS NULL OR t.departure_index > t.bar_index + a.age_bars THEN 'not_departed_by_entry' WHEN t.fill_index <= t.bar_index + a.age_bars THEN 'filled_by_entry' END AS omitted
      FROM traced t, (VALUES {", ".join(f"({a})" for a in AGES)}) a(age_bars)""",
    "observed": f"""SELECT *, greatest(peak - now, 0.0) AS drawdown_pct FROM (SELECT signal_id || '_entry_' || CAST(a.age_bars * a.interval_minutes AS VARCHAR) || 'm' AS observation_id, a.signal_id, a.asset, a.timeframe, a.interval_minutes, a.direction, a.direction_sign, a.open_time AS signal_open_time, a.bar_index AS signal_index, a.departure_index, a.entry_index, a.age_bars,
      c.open_time AS entry_open_time, c.close_time AS entry_close_time, c.close AS entry_price, a.wick_target, a.series_bars, greatest({_pct("c.close", "a.wick_target", "a.direction_sign")}, 0.0) AS now,
      (SELECT greatest(max({_pct("CASE WHEN a.direction_sign = 1 THEN p.high ELSE p.low END", "a.wick_target", "a.direction_sign")}), 0.0) FROM e p WHERE p.asset = a.asset AND p.bar_index BETWEEN a.bar_index AND a.entry_index) AS peak
      FROM aged a JOIN e c ON c.asset = a.asset AND c.bar_index = a.entry_index WHERE omitted IS NULL)""",
    "futures": f"""SELECT o.observation_id, o.direction_sign, o.entry_price, c.bar_index - o.entry_index AS k, CASE WHEN o.direction_sign = 1 THEN c.low <= o.wick_target ELSE c.high >= o.wick_target END AS touch,
      {", ".join(f"CASE WHEN o.direction_sign = 1 THEN c.high >= o.entry_price * (1 + {t} / 100.0) ELSE c.low <= o.entry_price * (1 - {t} / 100.0) END AS against_{t:g}" for t in THRESHOLDS)},
      greatest(CASE WHEN o.direction_sign = 1 THEN (c.high / o.entry_price - 1.0) * 100.0 ELSE (1.0 - c.low / o.entry_price) * 100.0 END, 0.0) AS adverse
      FROM observed o JOIN e c ON c.asset = o.asset AND c.bar_index > o.entry_index AND c.bar_index <= o.entry_index + {max(HORIZONS)}""",
    "touched": f"""SELECT o.observation_id, least({max(HORIZONS)}, o.series_bars - 1 - o.entry_index) AS available_bars, f.* EXCLUDE (observation_id) FROM observed o LEFT JOIN (
      SELECT observation_id, min(CASE WHEN touch THEN k END) AS target_bars, {", ".join(f"min(CASE WHEN against_{t:g} THEN k END) AS adverse_{t:g}pct_bars" for t in THRESHOLDS)} FROM futures GROUP BY 1) f USING (observation_id)""",
    "outcomes": " UNION ALL ".join(f"SELECT observation_id, {h} AS horizon_bars, CAST({t} AS DOUBLE) AS threshold_pct, {_competing('target_bars', f'adverse_{t:g}pct_bars', str(h), 'available_bars')} AS outcome FROM touched" for h in HORIZONS for t in THRESHOLDS),
    "vectors": "SELECT vec_id, label, embedding FROM embeddings",
    "near": "SELECT query_id, candidate_id, group_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, candidate_id) AS place FROM (SELECT a.vec_id AS query_id, b.vec_id AS candidate_id, b.label AS group_id, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS distance FROM vectors a, vectors b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)",
}


def _needed(text: str) -> list[str]:
    """The table expressions that a text names, and what these need, in order."""
    wanted: set[str] = set()
    todo = [text]
    while todo:
        for w in set(re.findall(r"(?:\bFROM|\bJOIN|,)\s+(\w+)", todo.pop())) & CTES.keys() - wanted:
            wanted.add(w)
            todo.append(CTES[w])
    return [c for c in CTES if c in wanted]


def sql(final: str, **extra: str) -> str:
    """`final` with the table expressions that it needs in front."""
    names = _needed(" ".join([*extra.values(), final]))
    parts = [f"{n} AS ({CTES[n]})" for n in names] + [f"{n} AS ({q})" for n, q in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + final
