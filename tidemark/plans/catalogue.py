"""The registered queries over the driver's tables, each beside the SQL that it must equal.

Two candle series stand in for market data: hourly candles of `events` by type and weekly candles of `lineitem` prices
by return flag. Most queries run on signals with relaxed limits, of which the small tables have enough.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import age_group, distance_group, rounded, tertile
from tidemark.functions.storage import run_dir, stored
from tidemark.operators import evaluate, features, folds, knn, library, match, outcomes, panel, project, ranks, rollup, signals, stats, trace, walkforward
from tidemark.operators import models as supervised
from tidemark.operators.first_hit import Blocks, blocked
from tidemark.plans import oracle as O
from tidemark.plans.oracle import AGES, FEATURES, FOLLOW_UP, HORIZONS, MATCH_K, PANEL, THRESHOLDS, r, sql
from tidemark.sources import candles as C
from tidemark.sources import ledger
from tidemark.sources import library as store
from tidemark.streaming import candles as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
HOUR = 3_600_000
RELAXED = signals.Shape(0.15, 0.5, 0.45)


def query(oracle: str | None = None, name: str | None = None):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, d, f=f: rounded(f(spark, d))
        if oracle is not None:
            ORACLE_SQL[key] = oracle
        return f

    return register


def _micros(column: str) -> Column:
    """Microseconds from the epoch of a timestamp with or without a zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))")


def hourly(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/events.parquet")
    return stored(C.from_ticks(rows, F.col("event_type"), _micros("ts"), F.col("value"), F.col("event_id"), 3600), "hourly")


def weekly(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    return C.from_ticks(rows, F.col("l_returnflag"), _micros("l_shipdate"), F.col("l_extendedprice"), F.struct("l_orderkey", "l_linenumber"), 604_800, F.col("l_quantity"))


def relaxed(e: DataFrame) -> DataFrame:
    return signals.detect(e, 1, RELAXED)


def traced(e: DataFrame, blocks: Blocks | None = None) -> DataFrame:
    """Written, as everything below reads it more than once."""
    return stored(trace.trace(relaxed(e), e, FOLLOW_UP, blocks), "traced")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Candles, signals, traces: how the weekly signals ended."""
    w = weekly(spark, d)
    return trace.status_counts(trace.trace(signals.detect(w, 1), w, 52))


# Candles

_ohlc = ", ".join(r(c) for c in ("open", "high", "low", "close", "volume"))


@query(sql(f"SELECT asset, timeframe, bar_index, open_time, close_time, interval_minutes, {_ohlc} FROM e"))
def candles_from_ticks(spark, d):
    return hourly(spark, d).select("asset", "timeframe", "bar_index", "open_time", "close_time", "interval_minutes", "open", "high", "low", "close", "volume")


def _rolled(where: str) -> str:
    return sql(f"SELECT asset, timeframe, bucket AS open_time, {_ohlc}, bars FROM (SELECT asset, timeframe, open_time // {3 * HOUR} * {3 * HOUR} AS bucket, arg_min(open, open_time) AS open, max(high) AS high, min(low) AS low, arg_max(close, open_time) AS close, sum(volume) AS volume, count(*) AS bars, min(open_time) AS f, max(open_time) AS l FROM e GROUP BY 1, 2, 3) {where}")


@query(_rolled(""))
def candle_rollup(spark, d):
    return rollup.by_time(hourly(spark, d), 3 * HOUR)


@query(_rolled(f"WHERE bars = 3 AND l - f = {2 * HOUR}"))
def candle_rollup_complete_only(spark, d):
    return rollup.by_time(hourly(spark, d), 3 * HOUR, 3, HOUR)


@query(sql(f"SELECT asset, timeframe, bar_index // 6 AS group_index, min(open_time) AS open_time, round(arg_min(open, bar_index), 6) + 0.0 AS open, round(max(high), 6) + 0.0 AS high, round(min(low), 6) + 0.0 AS low, round(arg_max(close, bar_index), 6) + 0.0 AS close, round(sum(volume), 6) + 0.0 AS volume, count(*) AS bars FROM w GROUP BY 1, 2, 3"))
def candle_fixed_count_bucket(spark, d):
    return rollup.by_count(weekly(spark, d), 6)


@query(sql(f"SELECT asset, timeframe, open_time // {4 * HOUR} * {4 * HOUR} AS open_time, CASE WHEN bool_and(bar_index >= 200) THEN 'projected' WHEN bool_or(bar_index >= 200) THEN 'transition' ELSE 'actual' END AS phase, arg_min(open, open_time) AS open, max(high) AS high, min(low) AS low, arg_max(close, open_time) AS close, count(*) AS bars FROM e GROUP BY 1, 2, 3"))
def candle_visual_transition(spark, d):
    e = hourly(spark, d)
    return rollup.actual_and_projected(e.where("bar_index < 200"), e.where("bar_index >= 200"), 4 * HOUR)


@query(sql(f"SELECT asset, timeframe, count(*) AS row_count, count(DISTINCT open_time) AS distinct_times, min(open_time) AS first_open, max(open_time) AS last_open, count_if(open_time % {HOUR} <> 0) AS off_grid, count_if(close_time <> open_time + {HOUR - 1}) AS bad_close_time, count_if(high < greatest(open, close, low) OR low > least(open, close, high)) AS bad_prices, (max(open_time) - min(open_time)) // {HOUR} + 1 - count(DISTINCT open_time) AS missing_bars FROM e GROUP BY 1, 2"))
def series_contract_report(spark, d):
    return C.contract_report(hourly(spark, d), HOUR)


@query(sql(f"SELECT asset, timeframe, open_time + {HOUR} AS gap_start, nxt AS gap_end, (nxt - open_time) // {HOUR} - 1 AS missing_bars FROM (SELECT *, lead(open_time) OVER (PARTITION BY asset ORDER BY open_time) AS nxt FROM e) WHERE nxt - open_time > {HOUR}"))
def missing_ranges(spark, d):
    return C.missing_ranges(hourly(spark, d), HOUR)


@query(sql(f"SELECT timeframe, max(f) AS window_start, min(l) + {HOUR} AS window_end, count(*) AS series_count FROM (SELECT asset, timeframe, min(open_time) AS f, max(open_time) AS l FROM e GROUP BY 1, 2) GROUP BY 1"))
def common_window(spark, d):
    return C.common_window(hourly(spark, d), HOUR)


@query(sql(f"SELECT e.asset, count(*) AS bars, min(open_time) AS first_open, max(open_time) AS last_open FROM e, (SELECT max(f) AS a, min(l) + {HOUR} AS b FROM (SELECT asset, min(open_time) AS f, max(open_time) AS l FROM e GROUP BY 1)) x WHERE open_time >= a AND open_time < b GROUP BY 1"))
def restricted_window(spark, d):
    e = hourly(spark, d)
    return C.restricted(e, C.common_window(e, HOUR)).groupBy("asset").agg(F.count("*").alias("bars"), F.min("open_time").alias("first_open"), F.max("open_time").alias("last_open"))


@query("SELECT event_type AS asset, 'tick' AS timeframe, epoch_us(ts) // 3600000000 AS open_time, arg_max(value, event_id) AS close, max(event_id) AS source_order FROM events WHERE value IS NOT NULL GROUP BY 1, 3")
def deduplicated_last(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("asset"), F.lit("tick").alias("timeframe"), (F.floor(_micros("ts") / 3_600_000_000)).alias("open_time"), *(F.col("value").alias(c) for c in ("open", "high", "low", "close")), F.col("event_id").alias("source_order"))
    return C.keep_last(rows, "source_order").select("asset", "timeframe", "open_time", "close", "source_order")


# Signals

@query(sql(f"SELECT asset, bar_index, {r('rng', 'range')}, {r('vs_median', 'range_vs_prior_20_median')}, {r('vs_mean', 'volume_vs_prior_20_mean')}, {r('back_return', 'prior_1h_return_pct')} FROM w_shapes"))
def signal_context_features(spark, d):
    return signals.with_context(weekly(spark, d), 1).select("asset", "bar_index", "range", "range_vs_prior_20_median", "volume_vs_prior_20_mean", "prior_1h_return_pct")


_signal_columns = ("signal_id", "asset", "bar_index", "open_time", "direction", "direction_sign", "wick_target", "opposite_extreme", *FEATURES)
_signal_sql = ", ".join(c if c in _signal_columns[:6] else r(c) for c in _signal_columns)


@query(sql(f"SELECT {_signal_sql} FROM signals"))
def strict_signals(spark, d):
    return signals.detect(hourly(spark, d), 1).select(*_signal_columns)


@query(sql(f"SELECT {_signal_sql} FROM w_signals"))
def strict_signals_weekly(spark, d):
    return signals.detect(weekly(spark, d), 1).select(*_signal_columns)


@query(sql(f"SELECT {_signal_sql} FROM relaxed"))
def relaxed_signals(spark, d):
    return relaxed(hourly(spark, d)).select(*_signal_columns)


@query(sql(f"SELECT asset, timeframe, bar_index, open_time, CASE WHEN lower_wick >= upper_wick THEN 'lower_wick' ELSE 'upper_wick' END AS direction, {r('body * 100', 'body_pct')}, {r('greatest(lower_wick, upper_wick) * 100', 'dominant_pct')}, {r('least(lower_wick, upper_wick) * 100', 'opposite_pct')} FROM e_shapes WHERE rng > 0"))
def pinned_shape(spark, d):
    return signals.pinned_shape(hourly(spark, d))


# Traces

_trace_columns = ("signal_id", "status", "departure_index", "fill_index")


@query(sql("SELECT signal_id, status, departure_index, fill_index FROM traced"))
def trace_status(spark, d):
    return traced(hourly(spark, d)).select(*_trace_columns)


@query(sql("SELECT signal_id, status, departure_index, fill_index FROM strict_traced"))
def trace_status_strict(spark, d):
    e = hourly(spark, d)
    return trace.trace(signals.detect(e, 1), e, FOLLOW_UP).select(*_trace_columns)


@query(sql("SELECT status, count(*) AS signals FROM w_traced GROUP BY 1"))
def trace_status_counts(spark, d):
    return flagship(spark, d)


@query(sql(
    "SELECT signal_id, CASE WHEN early THEN 'filled_before_departure' WHEN d IS NULL THEN 'no_departure' WHEN g IS NULL THEN 'unfilled' ELSE 'filled' END AS status, CASE WHEN NOT early THEN d END AS departure_index, CASE WHEN NOT early THEN g END AS fill_index FROM (SELECT x.*, (SELECT min(c.bar_index) FROM e c WHERE c.asset = x.asset AND c.bar_index > x.d AND c.bar_index <= x.d + 36 AND ((x.direction_sign = 1 AND c.low <= x.wick_target) OR (x.direction_sign = -1 AND c.high >= x.wick_target))) AS g FROM hits x)",
    hits=f"SELECT *, f IS NOT NULL AND (d IS NULL OR f <= d) AS early FROM (SELECT s.signal_id, s.asset, s.direction_sign, s.wick_target, min(CASE WHEN {O._TOUCH} THEN c.bar_index END) AS f, min(CASE WHEN {O._LEAVE} THEN c.bar_index END) AS d FROM relaxed s LEFT JOIN e c ON c.asset = s.asset AND c.bar_index > s.bar_index AND c.bar_index <= s.bar_index + 24 GROUP BY 1, 2, 3, 4)",
))
def trace_separate_caps(spark, d):
    e = hourly(spark, d)
    return trace.trace_capped(relaxed(e), e, 24, 36).select(*_trace_columns)


@query(sql(f"SELECT signal_id, asset, timeframe, direction, status, {r('move', 'current_move_pct')}, row_number() OVER (PARTITION BY asset ORDER BY open_time DESC, signal_id) AS newest_rank FROM (SELECT t.*, {O._pct('l.c', 't.wick_target', 't.direction_sign')} AS move, row_number() OVER (PARTITION BY t.asset ORDER BY t.open_time DESC, signal_id) AS n FROM traced t JOIN (SELECT asset, arg_max(close, bar_index) AS c FROM e GROUP BY 1) l USING (asset)) WHERE n <= 400 AND departure_index IS NOT NULL AND fill_index IS NULL AND move > 0 QUALIFY row_number() OVER (PARTITION BY asset ORDER BY open_time DESC, signal_id) <= 80"))
def open_signals(spark, d):
    e = hourly(spark, d)
    return trace.open_signals(traced(e), e)


def _panel_sql(final: str) -> str:
    hits = f"SELECT s.signal_id, s.asset, s.timeframe, s.open_time, s.direction, s.bar_index, n.series_bars, min(CASE WHEN {O._TOUCH} THEN c.bar_index END) - s.bar_index AS fill_bars, min(CASE WHEN {O._LEAVE} THEN c.bar_index END) - s.bar_index AS departure_bars FROM relaxed s JOIN (SELECT asset, max(bar_index) + 1 AS series_bars FROM e GROUP BY 1) n USING (asset) LEFT JOIN e c ON c.asset = s.asset AND c.bar_index > s.bar_index AND c.bar_index <= s.bar_index + {max(PANEL.values())} GROUP BY 1, 2, 3, 4, 5, 6, 7"
    columns = []
    for n, b in PANEL.items():
        m, f, l = f"bar_index + {b} < series_bars", f"coalesce(fill_bars <= {b}, false)", f"coalesce(departure_bars <= {b}, false)"
        columns += [f"CASE WHEN {m} THEN CAST({f} AS INT) END AS fill_{n}", f"CASE WHEN {m} THEN CAST({l} AS INT) END AS departure_{n}", f"CASE WHEN {m} THEN CAST({f} AND {l} AND departure_bars < fill_bars AS INT) END AS clean_{n}",
                    f"CASE WHEN {m} THEN CASE WHEN {f} AND {l} AND departure_bars < fill_bars THEN 'departure_then_fill' WHEN {f} THEN 'filled_before_or_with_departure' WHEN {l} THEN 'departed_not_filled' ELSE 'no_departure_no_fill' END END AS outcome_{n}"]
    return sql(final, hits=hits, panel=f"SELECT signal_id, asset, timeframe, open_time, direction, fill_bars, departure_bars, {', '.join(columns)} FROM hits")


@query(_panel_sql("SELECT * FROM panel"))
def panel_labels(spark, d):
    e = hourly(spark, d)
    return panel.labels(relaxed(e), e, PANEL)


@query(_panel_sql("SELECT asset, timeframe, count(*) AS signals, count_if(direction = 'lower_wick') AS lower_wicks, count_if(direction = 'upper_wick') AS upper_wicks, " + ", ".join(f"count(fill_{n}) AS mature_{n}, {r(f'avg(fill_{n})', f'fill_rate_{n}')}, {r(f'avg(clean_{n})', f'clean_rate_{n}')}" for n in PANEL) + " FROM panel GROUP BY 1, 2"))
def panel_strata(spark, d):
    e = hourly(spark, d)
    return panel.strata(panel.labels(relaxed(e), e, PANEL), PANEL)


@query(_panel_sql("SELECT asset, timeframe, horizon, outcome, count(*) AS signals FROM (" + " UNION ALL ".join(f"SELECT asset, timeframe, '{n}' AS horizon, outcome_{n} AS outcome FROM panel" for n in PANEL) + ") WHERE outcome IS NOT NULL GROUP BY 1, 2, 3, 4"))
def panel_outcome_counts(spark, d):
    e = hourly(spark, d)
    return panel.outcome_counts(panel.labels(relaxed(e), e, PANEL), PANEL)


# Completed routes

_episode_ints = ("episode_id", "asset", "timeframe", "interval_minutes", "direction", "direction_sign", "signal_open_ms", "fill_close_ms", "signal_to_departure_bars", "signal_to_fill_bars", "signal_to_fill_minutes", "time_to_max_away_bars")


@query(sql(f"SELECT {', '.join(_episode_ints)}, {', '.join(r(c) for c in ('wick_target', 'max_away_move_pct', *FEATURES))} FROM episodes"))
def episode_library(spark, d):
    e = hourly(spark, d)
    return library.episodes(traced(e), e)


@query(sql(f"SELECT episode_id, offset_bars, phase, open_time, {', '.join(r(f'normalized_{c}_pct') for c in ('open', 'high', 'low', 'close'))} FROM paths"))
def path_rows(spark, d):
    e = hourly(spark, d)
    return library.paths(traced(e), e).select("episode_id", "offset_bars", "phase", "open_time", *(f"normalized_{c}_pct" for c in ("open", "high", "low", "close")))


@query(sql("SELECT phase, count(*) AS bars, count(DISTINCT episode_id) AS episodes FROM paths GROUP BY 1"))
def path_phases(spark, d):
    e = hourly(spark, d)
    return library.paths(traced(e), e).groupBy("phase").agg(F.count("*").alias("bars"), F.count_distinct("episode_id").alias("episodes"))


def _states(e: DataFrame, t: DataFrame) -> DataFrame:
    return library.states(library.paths(t, e), library.episodes(t, e))


_state_sql = f"SELECT episode_id, offset_bars, remaining_bars, candidate, {', '.join(r(c) for c in ('current_move_pct', 'peak_move_pct', 'drawdown_pct', 'future_peak_move_pct'))} FROM states"
_state_columns = ("episode_id", "offset_bars", "remaining_bars", "candidate", "current_move_pct", "peak_move_pct", "drawdown_pct", "future_peak_move_pct")


@query(sql(_state_sql))
def path_states(spark, d):
    e = hourly(spark, d)
    return _states(e, traced(e)).select(*_state_columns)


@query(sql(_state_sql + " WHERE candidate"))
def candidate_states(spark, d):
    e = hourly(spark, d)
    return _states(e, traced(e)).where("candidate").select(*_state_columns)


@query(sql(_state_sql + " WHERE candidate AND (offset_bars <= 4 OR (offset_bars <= 16 AND offset_bars % 2 = 0) OR offset_bars % 4 = 0)"))
def thinned_states(spark, d):
    e = hourly(spark, d)
    return library.thinned(_states(e, traced(e)), 4, 16, 2, 4).select(*_state_columns)


@query(sql(
    f"SELECT s.episode_id, s.offset_bars, {r('s.current_move_pct', 'current_move_pct')}, {r('m.rr', 'recent_range_pct')}, {r('m.rc', 'recent_change_pct')} FROM states s JOIN m USING (episode_id, offset_bars) WHERE s.candidate AND s.offset_bars IN (2, 4, 8, 16)",
    steps="SELECT episode_id, offset_bars, abs(normalized_high_pct - normalized_low_pct) AS size, abs(normalized_close_pct - coalesce(lag(normalized_close_pct) OVER (PARTITION BY episode_id ORDER BY offset_bars), normalized_close_pct)) AS step FROM paths",
    m="SELECT episode_id, offset_bars, avg(size) OVER (PARTITION BY episode_id ORDER BY offset_bars ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rr, avg(step) OVER (PARTITION BY episode_id ORDER BY offset_bars ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rc FROM steps",
))
def snapshot_dataset(spark, d):
    e = hourly(spark, d)
    t = traced(e)
    return library.snapshots(library.paths(t, e), library.episodes(t, e), (2, 4, 8, 16)).select("episode_id", "offset_bars", "current_move_pct", "recent_range_pct", "recent_change_pct")


# All outcomes

def _observed(e: DataFrame, blocks: Blocks | None = None) -> DataFrame:
    blocks = blocks or blocked(e)
    return stored(outcomes.observations(traced(e, blocks), e, AGES, blocks), "observed")


_obs = ("observation_id", "signal_id", "entry_index", "age_bars", "entry_open_time", "departure_to_entry_bars")


@query(sql(f"SELECT observation_id, signal_id, entry_index, age_bars, entry_open_time, entry_index - departure_index AS departure_to_entry_bars, {r('entry_price')}, {r('now', 'entry_distance_pct')}, {r('peak', 'peak_distance_pct')}, {r('drawdown_pct')} FROM observed"))
def observations(spark, d):
    return _observed(hourly(spark, d)).select(*_obs, "entry_price", "entry_distance_pct", "peak_distance_pct", "drawdown_pct")


@query(sql("SELECT age_bars, coalesce(omitted, 'observed') AS reason, count(*) AS signals FROM aged GROUP BY 1, 2"))
def omission_counts(spark, d):
    return outcomes.omissions(traced(hourly(spark, d)), AGES)


def _touched(e: DataFrame, blocks: Blocks | None = None) -> tuple[DataFrame, DataFrame]:
    blocks = blocks or blocked(e)
    o = _observed(e, blocks)
    return o, stored(outcomes.touches(o, blocks, max(HORIZONS), THRESHOLDS), "touched")


@query(sql("SELECT observation_id, available_bars, target_bars, " + ", ".join(f"adverse_{t:g}pct_bars" for t in THRESHOLDS) + " FROM touched"))
def first_adverse(spark, d):
    return _touched(hourly(spark, d))[1]


def _bounds_sql(shown) -> str:
    most = lambda bars: f"coalesce(max(CASE WHEN f.k <= least({{h}}, CASE WHEN t.target_bars <= {{h}} THEN {bars} ELSE {{h}} END) THEN f.adverse END), 0.0)"
    one = f"SELECT t.observation_id, {{h}} AS horizon_bars, t.available_bars >= {{h}} AS fully_observed, coalesce(t.target_bars <= {{h}}, false) AS target_hit, {shown(most('t.target_bars - 1'), 'max_adverse_lower_pct')}, {shown(most('t.target_bars'), 'max_adverse_upper_pct')} FROM touched t LEFT JOIN futures f USING (observation_id) GROUP BY 1, 2, 3, 4"
    return " UNION ALL ".join(one.format(h=h) for h in HORIZONS)


_bounds = _bounds_sql(r)


@query(sql(_bounds))
def horizon_adverse_bounds(spark, d):
    blocks = blocked(e := hourly(spark, d))
    o, t = _touched(e, blocks)
    return outcomes.adverse_bounds(o, t, blocks, HORIZONS)


@query(sql("SELECT * FROM outcomes"))
def competing_outcomes(spark, d):
    return outcomes.outcomes(_touched(hourly(spark, d))[1], HORIZONS, THRESHOLDS)


@query(sql("SELECT observation_id, " + ", ".join(f"{O._competing('target_bars', f'adverse_{t:g}pct_bars', str(h), 'available_bars')} AS outcome_{h}b_vs_{t:g}pct" for h in HORIZONS for t in THRESHOLDS) + " FROM touched"))
def outcomes_wide(spark, d):
    return outcomes.outcomes_wide(_touched(hourly(spark, d))[1], HORIZONS, THRESHOLDS)


@query(sql("SELECT horizon_bars, threshold_pct, outcome, count(*) AS observations FROM outcomes GROUP BY 1, 2, 3"))
def outcome_aggregate(spark, d):
    return outcomes.outcome_totals(outcomes.outcomes(_touched(hourly(spark, d))[1], HORIZONS, THRESHOLDS))


@query(sql("SELECT asset, count(*) AS signals, sum(bar_index) AS index_sum, count_if(status = 'filled') AS filled, sum(departure_index) AS departure_sum, sum(fill_index) AS fill_sum FROM traced GROUP BY 1"))
def trace_checksum(spark, d):
    t = traced(hourly(spark, d))
    return t.groupBy("asset").agg(F.count("*").alias("signals"), F.sum("bar_index").alias("index_sum"), F.count_if(F.col("status") == "filled").alias("filled"), F.sum("departure_index").alias("departure_sum"), F.sum("fill_index").alias("fill_sum"))


# Features

def _rolling_sql(windows: tuple[int, ...]) -> str:
    base = "SELECT *, (close / nullif(lag(close) OVER (PARTITION BY asset ORDER BY bar_index), 0) - 1.0) * 100.0 AS change, (high - low) / nullif(close, 0) * 100.0 AS range_pct FROM e"
    cols = []
    for w in windows:
        frame = f"(PARTITION BY asset ORDER BY bar_index ROWS BETWEEN {max(w, 2) - 1} PRECEDING AND CURRENT ROW)"
        cols += [f"(close / nullif(lag(close, {w}) OVER (PARTITION BY asset ORDER BY bar_index), 0) - 1.0) * 100.0 AS return_{w}", *(f"CASE WHEN count({c}) OVER {frame} >= 2 THEN {f}({c}) OVER {frame} END AS {n}_{w}" for c, f, n in (("change", "stddev_pop", "volatility"), ("range_pct", "avg", "range"), ("volume", "avg", "volume")))]
    ratio = ", ".join(f"CASE WHEN lag(volume_{w}, {w}) OVER (PARTITION BY asset ORDER BY bar_index) IS NOT NULL THEN volume_{w} / greatest(lag(volume_{w}, {w}) OVER (PARTITION BY asset ORDER BY bar_index), 1e-12) END AS volume_ratio_{w}" for w in windows)
    names = ", ".join(r(f"{n}_{w}") for w in windows for n in ("return", "volatility", "range", "volume_ratio"))
    return sql(f"SELECT asset, timeframe, bar_index, {names} FROM rated", based=base, rolled=f"SELECT asset, timeframe, bar_index, {', '.join(cols)} FROM based", rated=f"SELECT *, {ratio} FROM rolled")


@query(_rolling_sql((3, 6, 12)))
def rolling_features(spark, d):
    return features.rolling(hourly(spark, d), (3, 6, 12))


@query(sql(f"SELECT o.observation_id, {r('ln(1 + o.age_bars * 60)', 'log_age_minutes')}, {r('ln(1 + o.now)', 'log_entry_distance')}, {r('ln(1 + o.peak)', 'log_peak_distance')}, {r('(c.high - c.low) / greatest(o.entry_price, 1e-12) * 100.0', 'entry_range_pct')}, {r('abs(o.entry_price - c.open) / greatest(o.entry_price, 1e-12) * 100.0', 'entry_body_pct')}, {r('coalesce(o.direction_sign * (o.entry_price / nullif(s.close, 0) - 1.0) * 100.0, 0.0)', 'signal_to_entry_return')}, CAST(o.direction = 'upper_wick' AS DOUBLE) AS upper_wick FROM observed o JOIN e c ON c.asset = o.asset AND c.bar_index = o.entry_index JOIN e s ON s.asset = o.asset AND s.bar_index = o.signal_index"))
def observation_features(spark, d):
    e = hourly(spark, d)
    found = features.of_observations(_observed(e), e, (6, 24), (3, 12), ("click", "view", "purchase", "error"))
    return found.select("observation_id", "log_age_minutes", "log_entry_distance", "log_peak_distance", "entry_range_pct", "entry_body_pct", "signal_to_entry_return", "upper_wick")


def _fingerprint_tables() -> dict[str, str]:
    views = (("pre", "greatest(signal_index - 24, 0)", "greatest(signal_index - 1, 0)", 12), ("recent", "greatest(entry_index - 11, 0)", "entry_index", 12), ("episode", "signal_index", "entry_index", 16))
    points = " UNION ALL ".join(f"SELECT observation_id, asset, wick_target, direction_sign, '{v}' AS view, k AS point, k = {0 if v == 'episode' else n - 1} AS anchor, CAST(round_even({a} + k * (greatest({a}, {b}) - {a}) / {n - 1}.0, 0) AS BIGINT) AS bar_index FROM observed, (SELECT unnest(generate_series(0, {n - 1})) AS k)" for v, a, b, n in views)
    valued = f"SELECT p.observation_id, p.view, p.point, p.anchor, {O._pct('c.close', 'greatest(p.wick_target, 1e-12)', 'p.direction_sign')} AS v FROM points p JOIN e c USING (asset, bar_index)"
    return {"points": points, "valued": valued, "printed": "SELECT observation_id, view, CAST(point AS INT) AS point, v - max(CASE WHEN anchor THEN v END) OVER (PARTITION BY observation_id, view) AS value FROM valued"}


def _fingerprint_sql() -> str:
    return sql(f"SELECT observation_id, view, point, {r('value')} FROM printed", **_fingerprint_tables())


@query(_fingerprint_sql())
def sequence_fingerprint(spark, d):
    e = hourly(spark, d)
    return features.fingerprint(_observed(e), e, 24, 12)


@query(sql(
    f"SELECT episode_id, offset_bars, horizon_bars, {r('distance')}, {r('ln(1 + least(distance / greatest(move, 0.02), 25.0))', 'log_ratio')}, distance < move AS falls FROM curves",
    asked="SELECT s.episode_id, s.offset_bars, s.current_move_pct AS move, h.horizon_bars, e.signal_to_fill_bars AS fill FROM states s JOIN episodes e USING (episode_id), (VALUES (1), (3), (8)) h(horizon_bars) WHERE s.candidate",
    curves="SELECT a.*, CASE WHEN a.offset_bars + a.horizon_bars >= a.fill THEN 0.0 ELSE greatest(p.normalized_close_pct, 0.0) END AS distance FROM asked a LEFT JOIN paths p ON p.episode_id = a.episode_id AND p.offset_bars = a.offset_bars + a.horizon_bars",
))
def future_curves(spark, d):
    e = hourly(spark, d)
    t = traced(e)
    p = stored(library.paths(t, e), "paths")
    return features.future_curve(p, library.states(p, library.episodes(t, e)).where("candidate"), (1, 3, 8))


@query(sql("SELECT vec_id, CAST(len(embedding) AS INT) AS width, " + r("list_sum(CAST(embedding[1:8] AS DOUBLE[])) * 2.0 + list_sum(CAST(embedding[9:] AS DOUBLE[])) * 0.5", "total") + " FROM vectors"))
def composed_vectors(spark, d):
    """The first eight values as the state, the others as its context, each with its weight; a block without one is left out."""
    rows = spark.read.parquet(f"{d}/embeddings.parquet").withColumn("v", F.transform("embedding", lambda x: x.cast("double"))).select("vec_id", F.slice("v", 1, 8).alias("s"), F.slice("v", F.lit(9), F.size("v")).alias("c"))
    both = rows.select("vec_id", features.composed({"state": "s", "context": "c", "pre": "s"}, {"state": 2.0, "context": 0.5}).alias("v"))
    return both.select("vec_id", F.size("v").alias("width"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(sql(f"SELECT vec_id, k AS point, {r('CAST(embedding[low + 1] AS DOUBLE) + (x - low) * (CAST(embedding[least(low + 1, len(embedding) - 1) + 1] AS DOUBLE) - CAST(embedding[low + 1] AS DOUBLE))', 'value')} FROM spots", spots="SELECT *, CAST(floor(x) AS INT) AS low FROM (SELECT vec_id, embedding, CAST(k AS INT) AS k, k * (len(embedding) - 1) / 9.0 AS x FROM vectors, (SELECT unnest(generate_series(0, 9)) AS k))"))
def resampled_vectors(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    return rows.select("vec_id", F.posexplode(features.resampled(F.col("v"), 10)).alias("point", "value"))


# Statistics

def _scales_sql(variant: str) -> str:
    return sql(" UNION ALL ".join(f"SELECT '{f}' AS name, {r('center')}, {r('scale')} FROM ({O.robust('relaxed', f, variant)})" for f in FEATURES))


def _register_scales() -> None:
    for name, variant in (("robust_scales_a", "first_usable"), ("robust_scales_b", "largest"), ("robust_scales_c", "raw")):
        query(_scales_sql(variant), name)(lambda spark, d, variant=variant: stats.robust_scales(stats.long(relaxed(hourly(spark, d)), FEATURES), variant))


_register_scales()


@query(sql(" UNION ALL ".join(f"SELECT '{f}' AS name, {r(f'quantile_cont({f}, 0.5)', 'center')}, {r(f'CASE WHEN quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25) > 1e-9 THEN quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25) ELSE 1.0 END', 'scale')} FROM relaxed" for f in FEATURES)))
def iqr_scales(spark, d):
    return stats.iqr_scales(stats.long(relaxed(hourly(spark, d)), FEATURES))


@query(sql(" UNION ALL ".join(f"SELECT signal_id, '{f}' AS name, {r(f'greatest(least(({f} - center) / scale, 8.0), -8.0) / sqrt(7.0)', 'value')} FROM relaxed, ({O.robust('relaxed', f, 'first_usable')}) x" for f in FEATURES)))
def block_scaler(spark, d):
    return stats.block_scaled(stats.long(relaxed(hourly(spark, d)), FEATURES, "signal_id"))


@query("SELECT user_id, round(sum(value) * sum(value) / greatest(sum(value * value), 1e-12), 6) + 0.0 AS effective_n FROM events WHERE value IS NOT NULL GROUP BY 1")
def effective_n(spark, d):
    return stats.effective_n(spark.read.parquet(f"{d}/events.parquet").where("value IS NOT NULL").withColumnRenamed("value", "weight"), "user_id")


_weights = "SELECT event_type, event_id, value, 1.0 + user_id % 7 AS weight FROM events WHERE value IS NOT NULL"


def _weighted(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").where("value IS NOT NULL").select("event_type", "event_id", "value", (1.0 + F.col("user_id") % 7).alias("weight"))


@query(f"WITH x AS ({_weights}) SELECT event_type, arg_min(value, row(value, event_id)) AS quantile FROM (SELECT *, sum(weight) OVER (PARTITION BY event_type ORDER BY value, event_id ROWS UNBOUNDED PRECEDING) AS u, sum(weight) OVER (PARTITION BY event_type) AS a FROM x) WHERE u >= 0.75 * a GROUP BY 1")
def weighted_quantile_step(spark, d):
    return stats.weighted_quantile_step(_weighted(spark, d), 0.75, ["event_type"])


@query(f"WITH x AS ({_weights}), y AS (SELECT *, sum(weight) OVER (PARTITION BY event_type ORDER BY value, event_id ROWS UNBOUNDED PRECEDING) / sum(weight) OVER (PARTITION BY event_type) AS s FROM x), z AS (SELECT *, lag(s) OVER (PARTITION BY event_type ORDER BY value, event_id) AS ls, lag(value) OVER (PARTITION BY event_type ORDER BY value, event_id) AS lv FROM y) SELECT event_type, round(arg_min(CASE WHEN ls IS NULL THEN value ELSE lv + (0.9 - ls) / (s - ls) * (value - lv) END, row(s, value, event_id)), 6) + 0.0 AS quantile FROM z WHERE s >= 0.9 GROUP BY 1")
def weighted_quantile_interp(spark, d):
    return stats.weighted_quantile_linear(_weighted(spark, d), 0.9, ["event_type"], "event_id")


@query(f"SELECT event_id, {r(O.average_pct_rank('value', 'event_type'), 'pct_rank')} FROM events WHERE value IS NOT NULL")
def pct_rank_average(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").where("value IS NOT NULL").transform(lambda rows: ranks.ranked(rows, ["event_type"], "value")).select("event_id", F.col("percent_rank").alias("pct_rank"))


@query("SELECT event_id, round(cume_dist() OVER (PARTITION BY event_type ORDER BY value), 6) + 0.0 AS percentile FROM events WHERE value IS NOT NULL")
def empirical_percentile(spark, d):
    return ranks.ranked(spark.read.parquet(f"{d}/events.parquet").where("value IS NOT NULL"), ["event_type"], "value").select("event_id", "percentile")


#: a forecast to score: does an event's user spend more than usual, told from the value alone
_scored = "SELECT event_type, user_id, event_id, CAST(user_id % 3 = 0 AS INT) AS label, value / (1.0 + (SELECT max(value) FROM events)) AS score FROM events WHERE value IS NOT NULL"


def _scored_events(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").where("value IS NOT NULL")
    most = rows.agg(F.max("value").alias("_top"))
    return rows.crossJoin(F.broadcast(most)).select("event_type", "user_id", "event_id", (F.col("user_id") % 3 == 0).cast("int").alias("label"), (F.col("value") / (1.0 + F.col("_top"))).alias("score"))


@query(f"WITH x AS ({_scored}), y AS (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY score) + (count(*) OVER (PARTITION BY event_type, score) - 1) / 2.0 AS k FROM x) SELECT event_type, round((sum(k * label) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label)), 6) + 0.0 AS auc FROM y GROUP BY 1")
def auc(spark, d):
    return stats.auc(_scored_events(spark, d), "event_type")


@query(f"WITH x AS ({_scored}) SELECT event_type, count(*) AS n, round(avg(label), 6) + 0.0 AS positive_rate, round(avg((score - label) * (score - label)), 6) + 0.0 AS brier, round(avg(label) * (1 - avg(label)), 6) + 0.0 AS base_brier, round(1 - avg((score - label) * (score - label)) / (avg(label) * (1 - avg(label))), 6) + 0.0 AS skill FROM x GROUP BY 1")
def brier_by_group(spark, d):
    return evaluate.brier(_scored_events(spark, d), "event_type")


@query(f"WITH x AS ({_scored}) SELECT event_type, CAST(least(floor(score * 5), 4) AS INT) AS bin, count(*) AS n, round(avg(score), 6) + 0.0 AS mean_score, round(avg(label), 6) + 0.0 AS observed_rate FROM x GROUP BY 1, 2")
def calibration_bins(spark, d):
    return evaluate.calibration_bins(_scored_events(spark, d), 5, "event_type")


@query(f"WITH x AS ({_scored}), y AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY user_id) AS w FROM x) SELECT round(sum(abs(s - l)) / sum(w), 6) + 0.0 AS ece FROM (SELECT least(floor(score * 10), 9) AS bin, sum(w) AS w, sum(w * score) AS s, sum(w * label) AS l FROM y GROUP BY 1)")
def ece_episode(spark, d):
    return evaluate.balanced_ece(_scored_events(spark, d), "user_id")


@query(f"WITH x AS ({_scored}) SELECT event_type, round(avg(m), 6) + 0.0 AS balanced_mean, count(*) AS episodes FROM (SELECT event_type, user_id, avg((score - label) * (score - label)) AS m FROM x GROUP BY 1, 2) GROUP BY 1")
def balanced_mean(spark, d):
    return evaluate.balanced_mean(_scored_events(spark, d), F.pow(F.col("score") - F.col("label"), 2), "user_id", "event_type")


@query(f"WITH x AS (SELECT *, CAST(user_id % 5 AS VARCHAR) AS bucket FROM ({_scored})) SELECT 'event_type' AS subgroup, event_type AS value, count(*) AS n, round(avg((score - label) * (score - label)), 6) + 0.0 AS brier FROM x GROUP BY 2 UNION ALL SELECT 'bucket', bucket, count(*), round(avg((score - label) * (score - label)), 6) + 0.0 FROM x GROUP BY 2 UNION ALL SELECT 'all', 'all', count(*), round(avg((score - label) * (score - label)), 6) + 0.0 FROM x")
def subgroup_sets(spark, d):
    return evaluate.subgroups(_scored_events(spark, d).withColumn("bucket", (F.col("user_id") % 5).cast("string")), ["event_type", "bucket"])


_configs = f"SELECT event_type AS config, avg((score - label) * (score - label)) AS brier, avg(abs(score - label)) AS mae FROM ({_scored}) GROUP BY 1"


def _config_metrics(spark, d):
    miss = F.col("score") - F.col("label")
    return _scored_events(spark, d).groupBy(F.col("event_type").alias("config")).agg(F.avg(miss * miss).alias("brier"), F.avg(F.abs(miss)).alias("mae"))


@query(f"WITH m AS ({_configs}), k AS (SELECT *, (rank() OVER (ORDER BY brier) + rank() OVER (ORDER BY mae)) / 2.0 AS mean_rank FROM m) SELECT config, round(brier, 6) + 0.0 AS brier, round(mae, 6) + 0.0 AS mae, mean_rank, row_number() OVER (ORDER BY mean_rank, config) = 1 AS selected FROM k")
def config_selection(spark, d):
    return evaluate.selected(_config_metrics(spark, d), ["brier", "mae"])


@query(f"WITH m AS ({_configs}) SELECT m.config, round(m.brier, 6) + 0.0 AS brier, round(m.mae, 6) + 0.0 AS mae, m.brier <= b.brier * 1.01 AND m.mae <= b.mae * 1.01 AS passes FROM m, (SELECT * FROM m WHERE config = 'view') b")
def config_tolerance(spark, d):
    return evaluate.within_tolerance(_config_metrics(spark, d), "view", ["brier", "mae"], 1.01)


# Neighbours

def _neighbours(spark, d, depth: int) -> DataFrame:
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return knn.distances(queries, rows.select(F.col("vec_id").alias("candidate_id"), F.col("label").alias("group_id"), F.col("embedding").alias("vector")), depth)


@query(sql(f"SELECT query_id, candidate_id, CAST(place AS INT) AS place, {r('distance')} FROM near WHERE place <= 10"))
def knn_topk(spark, d):
    return _neighbours(spark, d, 10).select("query_id", "candidate_id", "place", "distance")


_grouped = {"pool": "SELECT * FROM near WHERE place <= 64", "firsts": "SELECT query_id, candidate_id, group_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, candidate_id) AS place FROM (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY query_id, group_id ORDER BY distance, candidate_id) = 1)"}


@query(sql(f"SELECT query_id, candidate_id, group_id, CAST(place AS INT) AS place, {r('distance')} FROM firsts WHERE place <= 5", **_grouped))
def knn_distinct_group(spark, d):
    return knn.first_of_groups(_neighbours(spark, d, knn.search_depth(8, 64)), 5).select("query_id", "candidate_id", "group_id", "place", "distance")


@query(sql(f"SELECT query_id, {r('sum(w * y) / sum(w)', 'prediction')}, count(*) AS neighbours FROM (SELECT query_id, 1.0 / (distance / greatest(quantile_cont(distance, 0.5) OVER (PARTITION BY query_id), 1e-9) + 0.05) AS w, CAST(group_id % 2 AS DOUBLE) AS y FROM near WHERE place <= 15) GROUP BY 1"))
def knn_vote(spark, d):
    near = knn.weights(_neighbours(spark, d, 15), "inverse").withColumn("label", (F.col("group_id") % 2).cast("double"))
    return knn.vote(near)


@query(sql(f"SELECT query_id, candidate_id, {r('distance')}, NOT bool_or(distance <= radius) OVER (PARTITION BY query_id) AS radius_failed FROM (SELECT near.*, (SELECT quantile_cont(distance, 0.25) FROM near WHERE place <= 8) AS radius FROM near WHERE place <= 8) QUALIFY distance <= radius OR (place = 1 AND NOT bool_or(distance <= radius) OVER (PARTITION BY query_id))"))
def knn_radius_fallback(spark, d):
    pool = _neighbours(spark, d, 8)
    return knn.within_radius(pool, 8, knn.radius_of(pool, 0.25)).select("query_id", "candidate_id", "distance", "radius_failed")


_support = {"ws": "SELECT *, exp(-distance / greatest(quantile_cont(distance, 0.5) OVER (PARTITION BY query_id), 1e-9)) AS w, CAST(group_id % 2 AS DOUBLE) AS y, CAST(candidate_id % 10 AS DOUBLE) AS v FROM near WHERE place <= 16", "wn": "SELECT *, w / sum(w) OVER (PARTITION BY query_id) AS p FROM ws", "wm": "SELECT *, sum(p * v) OVER (PARTITION BY query_id) AS m FROM wn",
            "supported": "SELECT query_id, count(*) AS raw_neighbours, 1.0 / sum(p * p) AS effective_neighbours, min(distance) AS nearest_distance, quantile_cont(distance, 0.5) AS median_distance, stddev_pop(distance) AS distance_dispersion, greatest(sum(p * y), 1 - sum(p * y)) AS agreement, sqrt(sum(p * (v - m) * (v - m))) AS value_dispersion FROM wm GROUP BY 1"}


def _supported(spark, d) -> DataFrame:
    near = knn.weights(_neighbours(spark, d, 16), "exponential")
    return knn.support(near.withColumns({"label": (F.col("group_id") % 2).cast("double"), "value": (F.col("candidate_id") % 10).cast("double")}))


@query(sql("SELECT query_id, raw_neighbours, " + ", ".join(r(c) for c in ("effective_neighbours", "nearest_distance", "median_distance", "distance_dispersion", "agreement", "value_dispersion")) + " FROM supported", **_support))
def support_stats(spark, d):
    return _supported(spark, d)


@query(sql("SELECT s.query_id, round(count_if(c.median_distance <= s.median_distance) / CAST(count(*) AS DOUBLE), 6) + 0.0 AS percentile, CAST(least(floor(count_if(c.median_distance <= s.median_distance) / CAST(count(*) AS DOUBLE) * 5), 4) AS INT) AS level FROM supported s, supported c WHERE s.query_id % 100 = 0 AND c.query_id % 100 <> 0 GROUP BY 1", **_support))
def support_buckets(spark, d):
    found = _supported(spark, d)
    return knn.support_levels(found.where("query_id % 100 = 0"), found.where("query_id % 100 <> 0"))


def _lerp(q: float) -> str:
    return f"SELECT query_id, arg_min(CASE WHEN ls IS NULL THEN v ELSE lv + ({q} - ls) / (s - ls) * (v - lv) END, row(s, v, candidate_id)) AS x FROM (SELECT *, lag(s) OVER (PARTITION BY query_id ORDER BY v, candidate_id) AS ls, lag(v) OVER (PARTITION BY query_id ORDER BY v, candidate_id) AS lv FROM shares) WHERE s >= {q} GROUP BY 1"


@query(sql(f"SELECT query_id, {r('a.x', 'p10')}, {r('greatest(a.x, b.x)', 'p50')}, {r('greatest(a.x, b.x, c.x)', 'p90')} FROM a10 a JOIN a50 b USING (query_id) JOIN a90 c USING (query_id)",
           kw="SELECT query_id, candidate_id, CAST(candidate_id % 100 AS DOUBLE) AS v, exp(-least(distance / greatest(quantile_cont(distance, 0.5) OVER (PARTITION BY query_id), 0.05), 50.0)) AS w FROM near WHERE place <= 32",
           shares="SELECT *, sum(w) OVER (PARTITION BY query_id ORDER BY v, candidate_id ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY query_id) AS s FROM kw", a10=_lerp(0.1), a50=_lerp(0.5), a90=_lerp(0.9)))
def local_quantiles(spark, d):
    near = _neighbours(spark, d, 32).withColumn("value", (F.col("candidate_id") % 100).cast("double"))
    return project.local_quantiles(near, (0.1, 0.5, 0.9))


@query(sql(f"SELECT query_id, candidate_id, {r('base', 'match_score')}, {r('fair', 'context_score')}, {r('0.7 * base + 0.3 * fair', 'final_score')}, CAST(row_number() OVER (PARTITION BY query_id ORDER BY 0.7 * base + 0.3 * fair, candidate_id) AS INT) AS place FROM fairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY 0.7 * base + 0.3 * fair, candidate_id) <= 10",
           ctx="SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS c1, CAST(embedding[2] AS DOUBLE) AS c2 FROM vectors", sc1=O.robust("ctx", "c1", "largest"), sc2=O.robust("ctx", "c2", "largest"),
           pairs="SELECT n.query_id, n.candidate_id, n.distance AS base, (least(abs(b.c1 - a.c1) / sc1.scale, 12.0) + least(abs(b.c2 - a.c2) / sc2.scale, 12.0)) / 2.0 AS raw FROM near n JOIN ctx a ON a.vec_id = n.query_id JOIN ctx b ON b.vec_id = n.candidate_id, sc1, sc2 WHERE n.place <= 30",
           fairs="SELECT *, raw * greatest(quantile_cont(base, 0.5) OVER (PARTITION BY query_id), 1e-9) / greatest(quantile_cont(raw, 0.5) OVER (PARTITION BY query_id), 1e-9) AS fair FROM pairs"))
def contextual_rerank(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("candidate_id"), F.col("embedding")[0].cast("double").alias("c1"), F.col("embedding")[1].cast("double").alias("c2"))
    scales = stats.robust_scales(stats.long(rows, ["c1", "c2"]), "largest")
    base = _neighbours(spark, d, 30).withColumnRenamed("distance", "match_score").select("query_id", "candidate_id", "match_score")
    return project.context_reranked(base, rows, rows.withColumnRenamed("candidate_id", "query_id"), scales, ["c1", "c2"], 0.3, 10)


# Matching and projection

class Study:
    """The last episode as it stood at its departure, against those that had ended by then."""

    def __init__(self, spark: SparkSession, d: str):
        e = hourly(spark, d)
        t = traced(e)
        self.paths = stored(library.paths(t, e), "paths")
        self.episodes = stored(library.episodes(t, e), "episodes")
        self.query = stored(self.episodes.orderBy(F.desc("signal_open_ms"), F.desc("episode_id")).limit(1), "query")
        at = self.query.select("episode_id", F.col("asset").alias("_asset"), (F.col("signal_open_ms")).alias("_ms"), F.col("signal_to_departure_bars").alias("_bars"))
        index = e.join(F.broadcast(at), (F.col("asset") == F.col("_asset")) & (F.col("open_time") == F.col("_ms"))).select("asset", (F.col("bar_index") + F.col("_bars")).alias("bar_index"))
        snapshot = e.join(F.broadcast(index), ["asset", "bar_index"]).select((F.col("close_time") + 1).alias("_snapshot"))
        own = self.query.select(F.col("episode_id").alias("_own"))
        self.known = stored(self.episodes.crossJoin(F.broadcast(snapshot)).crossJoin(F.broadcast(own)).where((F.col("fill_close_ms") <= F.col("_snapshot")) & (F.col("episode_id") != F.col("_own"))).drop("_snapshot", "_own"), "known")
        self.states = stored(library.states(self.paths, self.episodes), "states")
        live = self.states.join(F.broadcast(at), "episode_id").where(F.col("offset_bars") == F.col("_bars"))
        self.live = live.select("current_move_pct", "peak_move_pct", "drawdown_pct", F.col("offset_bars").cast("double").alias("elapsed_bars"), "direction_sign")

    def best(self, mode: str) -> DataFrame:
        scores = stored(match.event_scores(self.known, self.query, mode), "scores")
        return match.best_alignments(match.scored_states(self.states.where("candidate"), scores, self.live.drop("direction_sign")))

    def cohort(self) -> DataFrame:
        return stored(project.projected_moves(match.top(self.best("adaptive"), MATCH_K), self.live), "cohort")


@query(sql(f"SELECT e.episode_id, {r(O._SHAPE, 'shape_distance')} FROM known e, q ORDER BY {O._SHAPE}, e.episode_id LIMIT 25"))
def archetype_pool(spark, d):
    s = Study(spark, d)
    return match.shape_pool(s.known, s.query, 25).select("episode_id", "shape_distance")


_best_columns = ("episode_id", "offset_bars", "remaining_bars", *match.COMPONENTS, "match_score")


def _register_modes() -> None:
    for mode in ("adaptive", "blended", "archetype"):
        q = sql(f"SELECT episode_id, offset_bars, remaining_bars, {', '.join(r(c) for c in _best_columns[3:])} FROM best_{mode}")
        query(q, f"best_alignment_{mode}")(lambda spark, d, mode=mode: Study(spark, d).best(mode).select(*_best_columns))


_register_modes()


@query(sql(" UNION ALL ".join(f"SELECT '{c}' AS name, {r(f'avg({c})', 'mean')}, {r(f'quantile_cont({c}, 0.5)', 'median')}, {r(f'quantile_cont({c}, 0.9)', 'p90')} FROM best_adaptive" for c in match.COMPONENTS)))
def score_components(spark, d):
    return match.component_summary(Study(spark, d).best("adaptive"))


_clone = lambda p, f: " AND ".join([*(f"abs(e.{c} - q.{c}) <= {p}" for c in match.SHAPE_POINTS), *(f"e.{c} / q.{c} BETWEEN {1 / f} AND {f}" for c in match.SHAPE_FACTORS)])


@query(sql(f"SELECT count(*) AS eligible, count_if({_clone(0.05, 2.0)}) AS within_1, count_if({_clone(0.03, 1.5)}) AS within_2, count_if({_clone(0.01, 1.2)}) AS within_3 FROM known e, q"))
def near_clone_audit(spark, d):
    s = Study(spark, d)
    return match.near_clones(s.known, s.query)


@query(sql(f"SELECT episode_id, offset_bars, {', '.join(r(c) for c in ('scale', 'historical_future_pct', 'projected_future_pct', 'projected_adverse_pct'))} FROM cohort"))
def projected_coordinates(spark, d):
    return Study(spark, d).cohort().select("episode_id", "offset_bars", "scale", "historical_future_pct", "projected_future_pct", "projected_adverse_pct")


@query(sql(f"SELECT scenario, episode_id, offset_bars, remaining_bars, {', '.join(r(c) for c in ('scale', 'projected_future_pct', 'projected_adverse_pct', 'joint_risk', 'joint_percentile', 'tail_share', 'match_score'))}, cohort FROM picks"))
def scenarios(spark, d):
    return project.scenarios(Study(spark, d).cohort()).select("scenario", "episode_id", "offset_bars", "remaining_bars", "scale", "projected_future_pct", "projected_adverse_pct", "joint_risk", "joint_percentile", "tail_share", "match_score", "cohort")


def _projected(s: Study) -> DataFrame:
    one = s.query.select("wick_target", "direction_sign", F.col("signal_open_ms").alias("start_ms"), F.lit(HOUR).alias("interval_ms"))
    return project.candles(project.scenarios(s.cohort()), s.paths, one)


_project = lambda c: f"q.wick_target * (1.0 + q.direction_sign * k.scale * p.normalized_{c}_pct / 100.0)"
_projected_sql = {"drawn": f"SELECT k.scenario, p.offset_bars - k.offset_bars AS step, q.signal_open_ms + (p.offset_bars - k.offset_bars - 1) * {HOUR} AS open_time, {', '.join(f'{_project(c)} AS {c}_' for c in ('open', 'high', 'low', 'close'))} FROM picks k JOIN paths p ON p.episode_id = k.episode_id AND p.offset_bars > k.offset_bars, q"}


@query(sql(f"SELECT scenario, step, open_time, {r('open_', 'open')}, {r('greatest(open_, high_, low_, close_)', 'high')}, {r('least(open_, high_, low_, close_)', 'low')}, {r('close_', 'close')} FROM drawn", **_projected_sql))
def projected_candles(spark, d):
    return _projected(Study(spark, d))


@query(sql(f"SELECT scenario, count(*) AS bars, {r('greatest(max(CASE WHEN q.direction_sign = 1 THEN (greatest(open_, high_, low_, close_) / q.wick_target - 1.0) * 100.0 ELSE (1.0 - least(open_, high_, low_, close_) / q.wick_target) * 100.0 END), 0.0)', 'peak_pct')} FROM drawn, q GROUP BY 1", **_projected_sql))
def project_flagship(spark, d):
    s = Study(spark, d)
    drawn = _projected(s)
    live = s.query.select("wick_target", "direction_sign").crossJoin(s.live.select("current_move_pct"))
    return project.path_metrics(drawn, live).select("scenario", "bars", F.round("projected_future_pct", 4).alias("peak_pct"))


ORACLE_SQL["project_flagship"] = ORACLE_SQL["project_flagship"].replace(", 6) + 0.0 AS peak_pct", ", 4) + 0.0 AS peak_pct")


@query(sql(f"SELECT step, active, {r('o', 'open')}, {r('greatest(o, h, l, c)', 'high')}, {r('least(o, h, l, c)', 'low')}, {r('c', 'close')}, {r('p10', 'close_p10')}, {r('p90', 'close_p90')} FROM steps WHERE step < coalesce((SELECT min(step) FROM steps WHERE active < (SELECT greatest(6.0, count(*) / 4.0) FROM cohort)), 1000000)",
           steps="SELECT p.offset_bars - k.offset_bars AS step, count(*) AS active, quantile_cont(p.normalized_open_pct * k.scale, 0.5) AS o, quantile_cont(p.normalized_high_pct * k.scale, 0.5) AS h, quantile_cont(p.normalized_low_pct * k.scale, 0.5) AS l, quantile_cont(p.normalized_close_pct * k.scale, 0.5) AS c, quantile_cont(p.normalized_close_pct * k.scale, 0.1) AS p10, quantile_cont(p.normalized_close_pct * k.scale, 0.9) AS p90 FROM cohort k JOIN paths p ON p.episode_id = k.episode_id AND p.offset_bars > k.offset_bars GROUP BY 1"))
def analogue_envelope(spark, d):
    s = Study(spark, d)
    return project.envelope(s.paths, s.cohort())


@query(sql(f"SELECT episode_id, remaining_bars, {r('match_score')} FROM cohort ORDER BY abs(remaining_bars - (SELECT quantile_cont(remaining_bars, 0.5) FROM cohort)), match_score, episode_id LIMIT 1"))
def median_duration_scenario(spark, d):
    return project.median_duration_pick(Study(spark, d).cohort()).select("episode_id", "remaining_bars", "match_score")


_median_sql = {
    "middle": "SELECT * FROM cohort ORDER BY abs(remaining_bars - (SELECT quantile_cont(remaining_bars, 0.5) FROM cohort)), match_score, episode_id LIMIT 1",
    "drawn": f"SELECT p.offset_bars - k.offset_bars AS step, q.signal_open_ms + (p.offset_bars - k.offset_bars - 1) * {HOUR} AS open_time, q.wick_target * (1.0 + q.direction_sign * l.current_move_pct / 100.0) AS now, {', '.join(f'{_project(c)} AS {c}_' for c in ('open', 'high', 'low', 'close'))} FROM middle k JOIN paths p ON p.episode_id = k.episode_id AND p.offset_bars > k.offset_bars, q, live l",
}


@query(sql(f"SELECT step, open_time, {r('CASE WHEN step = 1 THEN now ELSE open_ END', 'open')}, {r('greatest(open_, high_, low_, close_, CASE WHEN step = 1 THEN now END)', 'high')}, {r('least(open_, high_, low_, close_, CASE WHEN step = 1 THEN now END)', 'low')}, {r('close_', 'close')} FROM drawn", **_median_sql))
def median_duration_candles(spark, d):
    """The route of usual length, drawn on from the live close."""
    s = Study(spark, d)
    chosen = project.median_duration_pick(s.cohort()).withColumn("scenario", F.lit("usual"))
    live = s.query.select("wick_target", "direction_sign", F.col("signal_open_ms").alias("start_ms"), F.lit(HOUR).alias("interval_ms")).crossJoin(s.live.select("current_move_pct"))
    return project.joined_to_live(project.candles(chosen, s.paths, live), live).drop("scenario")


#: (route, order, wait in bars, adverse move in percent, whether it must go against first)
ROUTES = (("early", 0, 3.0, 5.0, False), ("usual", 1, 8.0, 10.0, False), ("late", 2, 20.0, 20.0, False), ("against_first", 3, 12.0, 40.0, True))


def _routes_sql() -> str:
    tables = {
        "wanted": f"SELECT * FROM (VALUES {', '.join(map(str, ROUTES))}) t(route, place, w, a, adverse_first)",
        "route_pairs": "SELECT route, episode_id, offset_bars, remaining_bars, projected_adverse_pct, 0.5 * abs(ln((remaining_bars + 1.0) / (w + 1.0))) + 0.5 * abs(projected_adverse_pct - a) / greatest(a, 0.25) + 0.1 * match_score / (SELECT greatest(quantile_cont(match_score, 0.5), 1e-9) FROM cohort) + CASE WHEN adverse_first AND remaining_bars <= 1 THEN 100.0 ELSE 0.0 END AS route_score FROM cohort, wanted",
    }
    for route, place, *_ in ROUTES:
        taken = " AND ".join(f"episode_id NOT IN (SELECT episode_id FROM route_{k})" for k in range(place)) or "true"
        tables[f"route_{place}"] = f"SELECT * FROM route_pairs WHERE route = '{route}' AND {taken} ORDER BY route_score, episode_id LIMIT 1"
    every = " UNION ALL ".join(f"SELECT * FROM route_{k}" for k in range(len(ROUTES)))
    return sql(f"SELECT route, episode_id, offset_bars, remaining_bars, {r('projected_adverse_pct')}, {r('route_score')} FROM ({every})", **tables)


@query(_routes_sql())
def forecast_routes(spark, d):
    wanted = spark.createDataFrame(list(ROUTES), "route string, order int, wait_bars double, adverse_pct double, adverse_first boolean")
    return project.routes(Study(spark, d).cohort(), wanted)


# Folds and samples

_part = "SELECT open_time, CASE WHEN k < floor(n * 0.6) THEN 'train' WHEN k < floor(n * 0.8) THEN 'validation' ELSE 'test' END AS part FROM (SELECT open_time, row_number() OVER (ORDER BY open_time) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT open_time FROM relaxed))"


@query(sql("SELECT signal_id, part FROM relaxed JOIN parts USING (open_time)", parts=_part))
def chrono_split(spark, d):
    return folds.chrono_split(relaxed(hourly(spark, d)), "open_time").select("signal_id", "part")


DAY = 24 * HOUR


def _folds(spark, d) -> tuple[DataFrame, DataFrame]:
    e = hourly(spark, d)
    span = e.agg(F.min("open_time").alias("a"), F.coalesce(F.max("close_time"), F.lit(-1)).alias("b")).first()
    # without candles there is no fold
    return e, folds.rolling_folds(spark, span.a or 0, span.b + 1, 5 * DAY, 3 * DAY, 3 * DAY, DAY)


_fold_sql = {"span": "SELECT min(open_time) AS a, max(close_time) + 1 AS b FROM e", "folds": f"SELECT CAST(k AS INT) AS fold, a + {5 * DAY} + k * {3 * DAY} AS test_start, a + {5 * DAY} + k * {3 * DAY} + {3 * DAY} AS test_end FROM span, (SELECT unnest(generate_series(0, 4000)) AS k) WHERE a + {5 * DAY} + k * {3 * DAY} + {3 * DAY} <= b - {DAY}"}


@query(sql("SELECT fold, test_start, test_end FROM folds", **_fold_sql))
def rolling_folds(spark, d):
    return _folds(spark, d)[1]


_eligible = f"SELECT fold, observation_id, signal_open_time, CASE WHEN signal_open_time >= test_start THEN 'query' WHEN entry_close_time + {12 * HOUR} <= test_start THEN 'history' END AS role FROM observed, folds WHERE signal_open_time < test_end"


@query(sql("SELECT fold, role, count(*) AS observations FROM eligible WHERE role IS NOT NULL GROUP BY 1, 2", **_fold_sql, eligible=_eligible))
def eligible_history(spark, d):
    e, f = _folds(spark, d)
    return folds.eligible_history(_observed(e), f, 12 * HOUR).groupBy("fold", "role").agg(F.count("*").alias("observations"))


LEAST_TRAIN, NEIGHBOURS = 40, 25
_log = {"log_range_vs_prior_20_median": "range_vs_prior_20_median", "log_volume_vs_prior_20_mean": "volume_vs_prior_20_mean"}


def _walk_sql(final: str) -> str:
    names = list(walkforward.FEATURE_WEIGHTS)
    source = lambda n: f"ln(r.{_log[n]})" if n in _log else f"r.{n}"
    clean = "coalesce(p.fill_bars <= 24, false) AND coalesce(p.departure_bars <= 24, false) AND p.departure_bars < p.fill_bars"
    hits = f"SELECT s.signal_id, min(CASE WHEN {O._TOUCH} THEN c.bar_index END) - s.bar_index AS fill_bars, min(CASE WHEN {O._LEAVE} THEN c.bar_index END) - s.bar_index AS departure_bars FROM relaxed s LEFT JOIN e c ON c.asset = s.asset AND c.bar_index > s.bar_index AND c.bar_index <= s.bar_index + 48 GROUP BY s.signal_id, s.bar_index"
    far = " + ".join(f"pow((q.{n} - h.{n}) / s.s_{n} * {w}, 2)" for n, w in walkforward.FEATURE_WEIGHTS.items()) + "".join(f" + CASE WHEN q.{c} <> h.{c} THEN {p * p} ELSE 0 END" for c, p in walkforward.CATEGORY_PENALTIES.items())
    return sql(
        final,
        hits=hits,
        cases=f"SELECT r.signal_id, r.asset, r.timeframe, r.direction, r.open_time, k.close_time + 1 AS known_ms, CAST(({clean}) AS DOUBLE) AS label, {', '.join(f'{source(n)} AS {n}' for n in names)} FROM relaxed r JOIN hits p USING (signal_id) JOIN e k ON k.asset = r.asset AND k.bar_index = r.bar_index + 24",
        **_fold_sql,
        learnt="SELECT f.fold, c.* FROM cases c JOIN folds f ON c.known_ms <= f.test_start",
        asked="SELECT f.fold, c.* FROM cases c JOIN folds f ON c.open_time >= f.test_start AND c.open_time < f.test_end",
        sizes=f"SELECT fold, count(*) AS n_train, avg(label) AS base FROM learnt GROUP BY 1 HAVING count(*) >= {LEAST_TRAIN}",
        centers=f"SELECT fold, {', '.join(f'quantile_cont({n}, 0.5) AS c_{n}, stddev_pop({n}) AS d_{n}' for n in names)} FROM learnt GROUP BY 1",
        mads=f"SELECT l.fold, {', '.join(f'quantile_cont(abs(l.{n} - c.c_{n}), 0.5) * 1.4826 AS m_{n}' for n in names)} FROM learnt l JOIN centers c ON c.fold = l.fold GROUP BY 1",
        spans=f"SELECT c.fold, {', '.join(f'CASE WHEN m_{n} > 1e-12 THEN m_{n} WHEN d_{n} > 1e-12 THEN d_{n} ELSE 1.0 END AS s_{n}' for n in names)} FROM centers c JOIN mads m ON m.fold = c.fold",
        nearest=f"SELECT q.fold, q.signal_id AS query_id, q.label, z.n_train, z.base, h.label AS y, sqrt({far}) AS d FROM asked q JOIN sizes z ON z.fold = q.fold JOIN learnt h ON h.fold = q.fold JOIN spans s ON s.fold = q.fold QUALIFY row_number() OVER (PARTITION BY q.fold, q.signal_id ORDER BY sqrt({far}), h.signal_id) <= {NEIGHBOURS}",
        predicted="SELECT fold, query_id, label, n_train, base, sum(y / (d + 0.2)) / sum(1.0 / (d + 0.2)) AS score FROM nearest GROUP BY ALL",
    )


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    """Forecasts of a clean departure and fill within 24 bars, scaled by and learnt from what was known when each window began."""
    e, f = _folds(spark, d)
    signals_ = relaxed(e)
    known = e.select("asset", "timeframe", (F.col("bar_index") - 24).alias("bar_index"), (F.col("close_time") + 1).alias("known_ms"))
    labelled = panel.labels(signals_, e, PANEL).select("signal_id", F.col("clean_24b").cast("double").alias("label"))
    rows = signals_.join(labelled, "signal_id").join(known, ["asset", "timeframe", "bar_index"]).withColumns({n: F.ln(c) for n, c in _log.items()}).withColumnRenamed("signal_id", "id")
    return walkforward.predict(stored(rows, "forward"), f, NEIGHBOURS, LEAST_TRAIN)


@query(_walk_sql(f"SELECT fold, n_train, count(*) AS n_test, {r('avg(label)', 'positive_rate')}, {r('avg(pow(score - label, 2))', 'brier')}, {r('avg(pow(base - label, 2))', 'base_brier')}, {r('1.0 - avg(pow(score - label, 2)) / nullif(avg(pow(base - label, 2)), 0)', 'skill')} FROM predicted GROUP BY 1, 2"))
def walk_forward_knn(spark, d):
    return walkforward.fold_metrics(_predicted(spark, d))


@query(_walk_sql(f"SELECT fold || '/' || query_id AS case_id, {r('pow(base - label, 2)', 'a')}, {r('pow(score - label, 2)', 'b')} FROM predicted"))
def paired_predictions(spark, d):
    """The squared error of the base rate beside that of the neighbours' forecast, case by case."""
    rows = stored(_predicted(spark, d), "predicted").withColumn("case_id", F.concat_ws("/", "fold", "query_id"))
    error = lambda c: rows.select("case_id", F.pow(F.col(c) - F.col("label"), 2).alias("v"))
    return evaluate.paired(error("base_score"), error("score"), "case_id", "v")


DRAWS = 200


def _bootstrap_sql() -> str:
    factors = ", ".join(f"({k}, {f})" for k, f in enumerate(evaluate.draw_factors(DRAWS), 1))
    weight = " + ".join(f"CAST(spot >= {p!r} AS INT)" for p in evaluate._POISSON)
    return _walk_sql(
        f"SELECT {r('max(CASE WHEN draw = 0 THEN gain END)', 'gain')}, {r('quantile_cont(CASE WHEN draw > 0 THEN gain END, 0.025)', 'low')}, {r('quantile_cont(CASE WHEN draw > 0 THEN gain END, 0.975)', 'high')} FROM (SELECT draw, 1.0 - sum(w * b) / sum(w * a) AS gain FROM (SELECT 0 AS draw, 1 AS w, a, b FROM per UNION ALL SELECT draw, {weight}, a, b FROM (SELECT draw, a, b, (h * f % {evaluate.PRIME}) / {evaluate.PRIME}.0 AS spot FROM per, (VALUES {factors}) t(draw, f))) GROUP BY 1)"
        .replace("FROM per", "FROM (SELECT query_id, CAST('0x' || substr(md5('7:' || query_id), 1, 12) AS BIGINT) % " + str(evaluate.PRIME - 1) + " + 1 AS h, avg(pow(base - label, 2)) AS a, avg(pow(score - label, 2)) AS b FROM predicted GROUP BY 1) per")
    )


@query(_bootstrap_sql())
def paired_bootstrap(spark, d):
    """How much better the neighbours' forecast is than the base rate, and how sure that is."""
    rows = stored(_predicted(spark, d), "predicted")
    error = lambda c: F.pow(F.col(c) - F.col("label"), 2)
    return evaluate.paired_bootstrap(rows.withColumns({"a": error("base_score"), "b": error("score")}), "query_id", "a", "b", DRAWS)


# the table's days stand for months here: one holds 24 * 30 hours
_stretched = {"long": f"SELECT episode_id, signal_open_ms * 30 AS signal_open_ms, fill_close_ms * 30 AS fill_close_ms FROM episodes", "start": "SELECT epoch_ms(make_timestamp(max(signal_open_ms) * 1000) - INTERVAL 3 MONTH) AS s FROM long"}


@query(sql(f"SELECT episode_id, CASE WHEN signal_open_ms >= s THEN 'holdout' ELSE 'train' END AS part FROM long, start WHERE signal_open_ms >= s OR fill_close_ms <= s - {DAY}", **_stretched))
def embargoed_holdout(spark, d):
    e = hourly(spark, d)
    found = library.episodes(traced(e), e).select("episode_id", (F.col("signal_open_ms") * 30).alias("signal_open_ms"), (F.col("fill_close_ms") * 30).alias("fill_close_ms"))
    return folds.holdout_split(stored(found, "long"), 3, DAY).select("episode_id", "part")


@query(sql(f"SELECT observation_id, CASE WHEN signal_open_time >= b THEN 'calibration' ELSE 'history' END AS part FROM seen, edge, (SELECT min(entry_close_time) AS f FROM seen, edge WHERE signal_open_time >= b) WHERE signal_open_time >= b OR entry_close_time + {12 * HOUR} <= f",
           seen="SELECT * FROM observed WHERE series_bars - 1 - entry_index >= 24", edge="SELECT t AS b FROM (SELECT signal_open_time AS t, row_number() OVER (ORDER BY signal_open_time) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT signal_open_time FROM observed)) WHERE k = greatest(CAST(floor(n * 0.8) AS BIGINT), 1)"))
def calibration_tail(spark, d):
    rows = _observed(hourly(spark, d)).withColumn("fully_observed", F.col("series_bars") - 1 - F.col("entry_index") >= 24)
    return folds.calibration_tail(rows, 0.2, 12 * HOUR).select("observation_id", "part")


# Observations matched with queries, and what became of the matches

_newest = "SELECT max(signal_open_time) AS t FROM observed"
_fold_edge = f"(SELECT t - {3 * DAY} FROM newest)"
_soft = {
    "newest": _newest,
    "queries": f"SELECT * FROM observed JOIN relaxed r USING (signal_id) WHERE signal_open_time >= {_fold_edge}".replace("SELECT * FROM observed JOIN relaxed r USING (signal_id)", "SELECT o.*, " + ", ".join(f"r.{c}" for c in FEATURES) + " FROM observed o JOIN relaxed r USING (signal_id)"),
    "mature": f"SELECT o.*, {', '.join(f'r.{c}' for c in FEATURES)} FROM observed o JOIN relaxed r USING (signal_id) WHERE o.entry_close_time + {12 * HOUR} <= {_fold_edge}",
    "mscale": " UNION ALL ".join(f"SELECT '{c}' AS name, scale FROM ({O.robust('mature', c, 'first_usable')})" for c in FEATURES),
    "met": "SELECT q.observation_id AS query_id, e.observation_id, " + " + ".join(f"{w} * abs(e.{c} - q.{c}) / (SELECT scale FROM mscale WHERE name = '{c}')" for c, w in match.FEATURE_WEIGHTS.items()) + f" AS feature, {O._SHAPE} AS shape, "
    + " + ".join(f"{w} * abs(ln((greatest(e.{c}, 0.0) + {f}) / (greatest(q.{c}, 0.0) + {f})))" for c, (w, f) in zip(("now", "peak", "drawdown_pct", "age_bars"), match.STATE_WEIGHTS.values())) + " + CASE WHEN e.asset <> q.asset THEN 0.35 * 0.7 ELSE 0 END AS rest FROM mature e JOIN queries q ON e.direction = q.direction",
    "mids": "SELECT query_id, greatest(quantile_cont(feature, 0.5), 1e-12) AS mf, greatest(quantile_cont(shape, 0.5), 1e-12) AS ms FROM met GROUP BY 1",
    "soft": "SELECT query_id, observation_id, match_score, row_number() OVER (PARTITION BY query_id ORDER BY match_score, observation_id) AS place FROM (SELECT m.query_id, m.observation_id, rest + 0.5 * (0.7 * feature + 0.3 * shape * mf / ms) AS match_score FROM met m JOIN mids x ON x.query_id = m.query_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY match_score, observation_id) <= 30",
}


def _soft_matched(e: DataFrame, blocks: Blocks | None = None) -> tuple[DataFrame, DataFrame]:
    """Observations of the last three days against those whose horizon had passed by then."""
    o = _observed(e, blocks)
    begin = F.broadcast(o.agg((F.max("signal_open_time") - 3 * DAY).alias("_begin")))
    both = o.crossJoin(begin)
    asked = both.where("signal_open_time >= _begin").withColumnRenamed("observation_id", "query_id").drop("_begin")
    mature = both.where(F.col("entry_close_time") + 12 * HOUR <= F.col("_begin")).drop("_begin")
    scales = stats.robust_scales(stats.long(mature, FEATURES))
    return o, stored(match.observation_scores(mature, asked, scales, k=30), "soft")


@query(sql(f"SELECT query_id, observation_id, {r('match_score')}, CAST(place AS INT) AS place FROM soft WHERE place <= 10", **_soft))
def matched_observations(spark, d):
    return _soft_matched(hourly(spark, d))[1].where("place <= 10")


_told = {**_soft, "bounds": _bounds_sql(lambda x, name: f"{x} AS {name}"), "kept": "SELECT s.query_id, b.*, t.target_bars FROM soft s JOIN bounds b USING (observation_id) JOIN touched t USING (observation_id) WHERE b.fully_observed OR b.target_hit"}


@query(sql(
    f"SELECT query_id, horizon_bars, count(*) AS neighbours, {r('avg(CAST(target_hit AS DOUBLE))', 'fill_probability')}, {r('quantile_cont((max_adverse_lower_pct + max_adverse_upper_pct) / 2, 0.5)', 'adverse_p50')}, {r('quantile_cont(max_adverse_upper_pct, 0.8)', 'adverse_p80')}, {r('quantile_cont(max_adverse_upper_pct, 0.9)', 'adverse_p90')}, "
    + ", ".join(r(f"quantile_cont(CASE WHEN target_hit THEN CAST(target_bars AS DOUBLE) END, {q})", f"wait_bars_p{round(q * 100)}") for q in (0.1, 0.5, 0.9)) + " FROM kept GROUP BY 1, 2 HAVING count(*) >= 12",
    **_told,
))
def neighbour_outcomes(spark, d):
    return _told_by(spark, d)[0]


_CLASSES = ("target_first", "adverse_first", "ambiguous_intrabar", "neither", "right_censored")


@query(sql(
    "SELECT query_id, horizon_bars, threshold_pct, outcome, round(share, 6) + 0.0 AS share FROM (SELECT k.query_id, k.horizon_bars, o.threshold_pct, " + ", ".join(f"count_if(o.outcome = '{c}') / CAST(count(*) AS DOUBLE) AS {c}" for c in _CLASSES) + " FROM kept k JOIN outcomes o ON o.observation_id = k.observation_id AND o.horizon_bars = k.horizon_bars GROUP BY 1, 2, 3 HAVING count(*) >= 12) UNPIVOT (share FOR outcome IN (" + ", ".join(_CLASSES) + "))",
    **_told,
))
def neighbour_outcome_classes(spark, d):
    return _told_by(spark, d)[1]


def _told_by(spark, d) -> tuple[DataFrame, DataFrame]:
    e = hourly(spark, d)
    blocks = blocked(e)
    o, matched = _soft_matched(e, blocks)
    t = stored(outcomes.touches(o, blocks, max(HORIZONS), THRESHOLDS), "touched")
    bounds = stored(outcomes.adverse_bounds(o, t, blocks, HORIZONS), "bounds")
    return knn.outcome_summary(matched.select("query_id", "observation_id"), bounds, outcomes.outcomes(t, HORIZONS, THRESHOLDS), t.select("observation_id", "target_bars"), _CLASSES)


@query(sql("SELECT asset, status, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY asset) AS DOUBLE), 6) + 0.0 AS share FROM traced GROUP BY 1, 2"))
def status_shares(spark, d):
    return evaluate.value_shares(traced(hourly(spark, d)), "status", "asset")


@query(sql(f"SELECT a.episode_id, {r('a.match_score', 'adaptive')}, {r('b.match_score', 'blended')}, {r('c.match_score', 'archetype')} FROM best_adaptive a JOIN best_blended b USING (episode_id) JOIN best_archetype c USING (episode_id)"))
def scores_by_mode(spark, d):
    s, modes = Study(spark, d), ("adaptive", "blended", "archetype")
    rows = [s.best(m).select("episode_id", F.lit(m).alias("mode"), "match_score") for m in modes]
    return evaluate.by_mode(rows[0].union(rows[1]).union(rows[2]), "episode_id", "mode", "match_score", modes)


@query(sql(f"SELECT s.signal_id, {r('max_by(w.close, w.open_time)', 'close_before')} FROM relaxed s LEFT JOIN e w ON w.asset = s.asset AND w.open_time < s.open_time - {3 * HOUR} GROUP BY 1"))
def close_before_signal(spark, d):
    """The last close of the same series more than three hours before each signal, whatever gaps lie between."""
    e = hourly(spark, d)
    asked = relaxed(e).select("signal_id", "asset", "timeframe", (F.col("open_time") - 3 * HOUR).alias("at"))
    return ranks.as_of(asked, e, ["asset", "timeframe"], "at", "open_time", "close", "signal_id").withColumnRenamed("close", "close_before")


@query(sql(f"SELECT episode_id, {r('avg(abs(v - m))', 'distance')} FROM curves JOIN (SELECT step, sum(v * w) / sum(w) AS m FROM curves GROUP BY 1) USING (step) GROUP BY 1 ORDER BY avg(abs(v - m)), episode_id LIMIT 1",
           curves="SELECT k.episode_id, p.offset_bars - k.offset_bars AS step, p.normalized_close_pct * k.scale AS v, 1.0 / (k.match_score + 0.2) AS w FROM cohort k JOIN paths p ON p.episode_id = k.episode_id AND p.offset_bars > k.offset_bars AND p.offset_bars <= k.offset_bars + 8"))
def medoid_route(spark, d):
    s = Study(spark, d)
    chosen = s.cohort().select("episode_id", F.col("offset_bars").alias("_at"), "scale", (1.0 / (F.col("match_score") + 0.2)).alias("weight"))
    rows = s.paths.join(chosen, "episode_id").where(F.col("offset_bars").between(F.col("_at") + 1, F.col("_at") + 8))
    return project.medoid(rows.select("episode_id", (F.col("offset_bars") - F.col("_at")).alias("step"), (F.col("normalized_close_pct") * F.col("scale")).alias("value"), "weight"))


# Errors by group, calibration of quantiles, and a store that is read back

@query(sql(f"SELECT age_group, distance_group, volatility_group, count(*) AS observations, {r('avg(now)', 'mean_distance')} FROM (SELECT now, CASE WHEN age_bars * 60 < 60 THEN 'under_1h' WHEN age_bars * 60 < 360 THEN '1h_6h' WHEN age_bars * 60 < 1440 THEN '6h_1d' ELSE '1d_7d' END AS age_group, CASE WHEN now < 1 THEN 'under_1pct' WHEN now < 3 THEN '1_3pct' WHEN now < 7 THEN '3_7pct' WHEN now < 15 THEN '7_15pct' WHEN now < 30 THEN '15_30pct' ELSE 'over_30pct' END AS distance_group, CASE WHEN k <= 1.0 / 3 THEN 'low' WHEN k <= 2.0 / 3 THEN 'middle' ELSE 'high' END AS volatility_group FROM (SELECT *, {O.average_pct_rank('drawdown_pct')} AS k FROM observed)) GROUP BY 1, 2, 3"))
def observation_groups(spark, d):
    rows = ranks.ranked(_observed(hourly(spark, d)), [], "drawdown_pct")
    groups = rows.select("entry_distance_pct", age_group(F.col("age_bars") * 60).alias("age_group"), distance_group(F.col("entry_distance_pct")).alias("distance_group"), tertile(F.col("percent_rank")).alias("volatility_group"))
    return groups.groupBy("age_group", "distance_group", "volatility_group").agg(F.count("*").alias("observations"), F.avg("entry_distance_pct").alias("mean_distance"))


_pin = lambda q: f"greatest({q} * (value - q{round(q * 100)}), {q - 1} * (value - q{round(q * 100)}))"


@query("SELECT event_type, count(*) AS n, " + ", ".join(f"round(avg(CAST(value <= q{k} AS DOUBLE)), 6) + 0.0 AS coverage_{k}, round(avg({_pin(k / 100)}), 6) + 0.0 AS pinball_{k}" for k in (10, 50, 90)) + ", round(avg(CAST(value BETWEEN q10 AND q90 AS DOUBLE)), 6) + 0.0 AS interval_coverage, round(quantile_cont(abs(value - q50), 0.5), 6) + 0.0 AS median_error FROM (SELECT event_type, value, 1.0 + user_id % 5 AS q10, 20.0 + user_id % 7 AS q50, 60.0 + user_id % 11 AS q90 FROM events WHERE value IS NOT NULL) GROUP BY 1")
def quantile_calibration(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").where("value IS NOT NULL").withColumns({"q10": 1.0 + F.col("user_id") % 5, "q50": 20.0 + F.col("user_id") % 7, "q90": 60.0 + F.col("user_id") % 11})
    return evaluate.quantile_calibration(rows, "value", {0.1: "q10", 0.5: "q50", 0.9: "q90"}, "event_type")


@query(sql("SELECT p.asset, count(*) AS path_rows, count(DISTINCT p.episode_id) AS episodes, sum(p.offset_bars) AS offsets FROM paths p JOIN episodes e USING (episode_id) WHERE e.direction = 'lower_wick' AND p.asset IN ('click', 'view') GROUP BY 1"))
def library_store(spark, d):
    """Routes and episodes written as a store, read back for two assets, and the routes of one direction's episodes."""
    e = hourly(spark, d)
    t = traced(e)
    root = f"{run_dir(spark)}/library-{uuid.uuid4().hex}"
    store.write(library.paths(t, e), root, "paths")
    store.write(library.episodes(t, e), root, "episodes")
    chosen = store.require_unique(store.read(spark, root, "episodes", "60m", ["click", "view"]), "episode_id").where("direction = 'lower_wick'")
    found = store.read_paths(spark, root, chosen, "60m", ["click", "view"])
    return found.groupBy("asset").agg(F.count("*").alias("path_rows"), F.count_distinct("episode_id").alias("episodes"), F.sum("offset_bars").alias("offsets"))


@query(sql("SELECT signal_id, open_time FROM placed, (SELECT unnest(generate_series(0, 19)) AS k) WHERE n <= 20 OR i = CAST(floor(k * (n - 1) / 19) AS BIGINT) GROUP BY 1, 2", placed="SELECT *, row_number() OVER (ORDER BY open_time, signal_id) - 1 AS i, count(*) OVER () AS n FROM relaxed"))
def evenly_spaced(spark, d):
    return folds.evenly_spaced(relaxed(hourly(spark, d)), 20, ["open_time", "signal_id"]).select("signal_id", "open_time")


@query(sql("SELECT signal_id, direction, asset FROM marked QUALIFY row_number() OVER (ORDER BY hit DESC, open_time, signal_id) <= 40",
           strata="SELECT *, row_number() OVER (PARTITION BY direction, asset ORDER BY open_time, signal_id) - 1 AS i, count(*) OVER (PARTITION BY direction, asset) AS n, greatest(floor(40 / (SELECT CAST(count(*) AS DOUBLE) FROM (SELECT DISTINCT direction, asset FROM relaxed))), 1) AS quota FROM relaxed",
           marked="SELECT s.*, coalesce((SELECT bool_or(CASE WHEN least(s.quota, s.n) > 1 THEN round_even(k * (s.n - 1) / (least(s.quota, s.n) - 1), 0) ELSE 0 END = s.i) FROM (SELECT unnest(generate_series(0, 60)) AS k) g WHERE k < least(s.quota, s.n)), false) AS hit FROM strata s"))
def stratified_sample(spark, d):
    return folds.stratified_sample(relaxed(hourly(spark, d)), 40, ["direction", "asset"], ["open_time", "signal_id"]).select("signal_id", "direction", "asset")


@query(sql(f"SELECT observation_id, {r('1.0 / count(*) OVER (PARTITION BY signal_id)', 'weight')} FROM observed"))
def episode_weights(spark, d):
    return folds.episode_weights(_observed(hourly(spark, d)), "signal_id").select("observation_id", "weight")


# Streams, the ledger and supervised models

def _streamed(spark: SparkSession, e: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `work` makes of e as a stream: three parts come one after the other in time, and the query is started anew for each."""
    root = f"{run_dir(spark)}/stream-{uuid.uuid4().hex}"
    span = e.agg(F.min("open_time").alias("a"), F.max("open_time").alias("b")).first()
    third = ((span.b or 0) - (span.a or 0)) // 3 + 1
    for k in range(3):
        begin = (span.a or 0) + k * third
        e.where(F.col("open_time").between(begin, begin + third - 1)).write.mode("append").parquet(f"{root}/in")
        out = stream.run_available(spark, work(spark.readStream.schema(e.schema).parquet(f"{root}/in")), root)
    return out


@query(sql(f"SELECT asset, timeframe, bucket AS open_time, {_ohlc}, bars FROM (SELECT asset, timeframe, open_time // {4 * HOUR} * {4 * HOUR} AS bucket, arg_min(open, open_time) AS open, max(high) AS high, min(low) AS low, arg_max(close, open_time) AS close, sum(volume) AS volume, count(*) AS bars FROM e GROUP BY 1, 2, 3) WHERE bucket + {4 * HOUR} <= (SELECT max(open_time) FROM e) - {HOUR}"))
def stream_rollup(spark, d):
    return _streamed(spark, hourly(spark, d), lambda rows: stream.rollup(rows, "4 hours", "1 hour"))


@query(sql("SELECT asset, timeframe, signal_id, status, bar_index, departure_index, fill_index FROM traced WHERE status <> 'right_censored'"))
def stream_trace(spark, d):
    return _streamed(spark, hourly(spark, d), lambda rows: stream.follow(rows, FOLLOW_UP, 1, RELAXED))


@query(sql("SELECT asset, timeframe, signal_id, status, open_time AS snapshot_ms FROM traced"))
def forecast_ledger(spark, d):
    """Recorded twice, held once."""
    e = hourly(spark, d)
    rows = traced(e).select("asset", "timeframe", "signal_id", F.col("open_time").alias("snapshot_ms"), F.lit("v1").alias("model_version"), "status", F.lit(0).cast("long").alias("recorded_ms"))
    path = f"{run_dir(spark)}/ledger-{uuid.uuid4().hex}"
    ledger.append_once(rows, path)
    ledger.append_once(rows.unionByName(rows.limit(5)), path)
    return spark.read.parquet(path).select("asset", "timeframe", "signal_id", "status", "snapshot_ms")


@query()
def supervised_forecast(spark, d):
    e = hourly(spark, d)
    blocks = blocked(e)
    o, t = _touched(e, blocks)
    bounds = outcomes.adverse_bounds(o, t, blocks, (6, 24))
    wide = bounds.groupBy("observation_id").agg(*(F.max(F.when((F.col("horizon_bars") == h) & (F.col("fully_observed") | F.col("target_hit")), x)).alias(f"{n}_{h}") for h in (6, 24) for n, x in (("hit", F.col("target_hit").cast("double")), ("adverse", (F.col("max_adverse_lower_pct") + F.col("max_adverse_upper_pct")) / 2))))
    found = features.of_observations(o, e, (6, 24), (3, 12), ("click", "error", "purchase", "signup", "view"))
    rows = stored(folds.chrono_split(o.select("observation_id", "signal_open_time").join(found, "observation_id").join(wide, "observation_id"), "signal_open_time"), "supervised")
    models = supervised.fit(rows.where("part = 'train'"), found.columns[1:], (6, 24))
    scored = supervised.predict(rows.where("part <> 'train'"), models, (6, 24))
    return scored.select("observation_id", "part", "chance_6", "chance_24", "adverse_forecast_6", "adverse_forecast_24")


# the rest of the queries registers itself here
from tidemark.plans import research  # noqa: E402, F401
