"""The engine on hand-made candles, and properties that hold whatever the data are."""

import random

import numpy as np
import hashlib
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemark.functions import columns
from tidemark.operators import evaluate, first_hit, folds, knn, library, outcomes, project, rollup, signals, stats, trace
from tidemark.sources import candles as C
from tidemark.sources import ledger, manifest
from tidemark.streaming import candles as stream

SCHEMA = "asset string, timeframe string, interval_minutes int, bar_index long, open_time long, close_time long, open double, high double, low double, close double, volume double"


def candles(spark, rows, asset="A"):
    return spark.createDataFrame([(asset, "1m", 1, k, k * 60_000, k * 60_000 + 59_999, *map(float, r)) for k, r in enumerate(rows)], SCHEMA)


def walk(n, seed):
    rng = random.Random(seed)
    out, p = [], 100.0
    for _ in range(n):
        o, c = p, p + rng.uniform(-1, 1) * rng.random()
        out.append((o, max(o, c) + rng.random() ** 3 * 2, min(o, c) - rng.random() ** 3 * 2, c, 1 + rng.random()))
        p = c
    return out


RELAXED = signals.Shape(0.25, 0.5, 0.45)


def plain_trace(rows, i, sign, target, far, n):
    fill = leave = None
    for k in range(i + 1, min(len(rows) - 1, i + n) + 1):
        _, h, low, c, _ = rows[k]
        if fill is None and (low <= target if sign == 1 else h >= target):
            fill = k
        if leave is None and (c >= far if sign == 1 else c <= far):
            leave = k
    seen = i + n < len(rows)
    if fill is not None and (leave is None or fill <= leave):
        return "filled_before_departure", None, None
    if leave is None:
        return "no_departure" if seen else "right_censored", None, None
    if fill is not None:
        return "filled", leave, fill
    return "unfilled" if seen else "right_censored", leave, None


@pytest.mark.parametrize("follow_up", [1, 7, 40, 400])
def test_traces_equal_a_sequential_scan(spark, follow_up):
    rows = walk(700, follow_up)
    c = candles(spark, rows)
    got = trace.trace(signals.detect(c, 5, RELAXED), c, follow_up).collect()
    assert len(got) > 20
    for r in got:
        assert (r.status, r.departure_index, r.fill_index) == plain_trace(rows, r.bar_index, r.direction_sign, r.wick_target, r.opposite_extreme, follow_up)


def test_first_hits_and_range_maxima_equal_brute_force(spark):
    rows = walk(900, 4)
    rng = random.Random(8)
    asked = []
    for k in range(300):
        a = rng.randrange(-1, 899)
        track = rng.choice(first_hit.TRACKS)
        asked.append((k, "A", "1m", a, min(a + rng.choice((0, 1, 3, 20, 200, 900)), 899), track, (1 if track in ("high", "close") else -1) * rng.uniform(90, 110)))
    value = {"high": lambda r: r[1], "neg_low": lambda r: -r[2], "close": lambda r: r[3], "neg_close": lambda r: -r[3]}
    requests = spark.createDataFrame(asked, "rid int, asset string, timeframe string, after long, last long, track string, level double")
    hits = {r.rid: r.hit for r in first_hit.first_hits(requests, candles(spark, rows), 4, 4).collect()}
    most = {r.rid: r.largest for r in first_hit.range_max(requests, candles(spark, rows), 4, 4).collect()}
    for k, _, _, a, b, t, level in asked:
        seen = [(i, value[t](rows[i])) for i in range(a + 1, b + 1)]
        assert hits.get(k) == next((i for i, v in seen if v >= level), None)
        assert most.get(k) == max((v for _, v in seen), default=None)


def test_later_candles_change_no_signal_or_state(spark):
    rows = walk(300, 6)
    a = signals.detect(candles(spark, rows[:200]), 5, RELAXED).toPandas()
    b = signals.detect(candles(spark, rows[:200] + [(o * 3, h * 3, low * 3, c * 3, v) for o, h, low, c, v in rows[200:]]), 5, RELAXED).where("bar_index < 200").toPandas()
    assert a.sort_values("signal_id").reset_index(drop=True).equals(b.sort_values("signal_id").reset_index(drop=True))


def test_context_crosses_blocks(spark, monkeypatch):
    c = candles(spark, walk(200, 2))
    whole = signals.with_context(c, 5).toPandas().sort_values("bar_index").reset_index(drop=True)
    monkeypatch.setattr(signals, "overlapped", lambda df, n: columns.overlapped(df, n, 32))
    parts = signals.with_context(c, 5).toPandas().sort_values("bar_index").reset_index(drop=True)
    assert len(parts) == 200 and np.allclose(whole.range_vs_prior_20_median.fillna(-1), parts.range_vs_prior_20_median.fillna(-1)) and np.allclose(whole.prior_1h_return_pct.fillna(-1), parts.prior_1h_return_pct.fillna(-1))


def test_one_wide_candle_after_flat_ones(spark):
    flat = [(100, 100.1, 99.9, 100, 1)] * 300
    flat[130] = (100, 101, 99.9, 100, 1)
    got = signals.detect(candles(spark, flat), 60).collect()
    assert [(r.bar_index, r.direction) for r in got] == [(130, "upper_wick")]
    assert signals.detect(candles(spark, [(100, 100, 100, 100, 1)] * 60 + [(100, 105, 99.9, 100, 1)]), 20).count() == 0


def test_early_fill_in_the_departure_bar(spark):
    c = candles(spark, [(100, 110, 100, 100, 1), (100, 111, 100, 110, 1)])
    s = spark.createDataFrame([("s", "A", "1m", 0, 1, 100.0, 110.0)], "signal_id string, asset string, timeframe string, bar_index long, direction_sign int, wick_target double, opposite_extreme double")
    r = trace.trace(s, c, 1).first()
    assert (r.status, r.departure_index, r.fill_index) == ("filled_before_departure", None, None)


def test_competing_outcomes(spark):
    rows = [(3, 3, 10, 10), (3, 5, 10, 10), (7, 5, 10, 10), (None, None, 10, 10), (None, None, 10, 4)]
    df = spark.createDataFrame(rows, "t int, a int, h int, n int").coalesce(1)
    assert [r[0] for r in df.select(outcomes.competing(F.col("t"), F.col("a"), F.col("h"), F.col("n"))).collect()] == ["ambiguous_intrabar", "target_first", "adverse_first", "neither", "right_censored"]


def test_intrabar_bounds(spark):
    rows = [(100, 101, 100, 101, 1), (101, 111, 101, 110, 1), (110, 110, 109, 110, 1), (110, 111, 108, 109, 1), (109, 112, 99, 100, 1), (100, 101, 99, 100, 1), (100, 101, 99, 100, 1)]
    t = spark.createDataFrame([("s", "A", "1m", 1, "lower_wick", 1, 0, 0, 100.0, 1, None, 7)], "signal_id string, asset string, timeframe string, interval_minutes int, direction string, direction_sign int, bar_index long, open_time long, wick_target double, departure_index long, fill_index long, series_bars long")
    c = candles(spark, rows)
    o = outcomes.observations(t, c, [2])
    touched = outcomes.touches(o, c, 3, [1.5])
    r = touched.first()
    assert (r.target_bars, r.adverse_1p5pct_bars, r.available_bars) == (2, 2, 3)
    assert outcomes.outcomes(touched, [3], [1.5]).first().outcome == "ambiguous_intrabar"
    b = outcomes.adverse_bounds(o, touched, c, [3]).first()
    assert b.max_adverse_lower_pct == pytest.approx(111 / 110 * 100 - 100) and b.max_adverse_upper_pct == pytest.approx(112 / 110 * 100 - 100)


def test_missing_ranges(spark):
    c = spark.createDataFrame([("A", "5m", t) for t in (0, 5, 15, 30)], "asset string, timeframe string, open_time long")
    assert sorted((r.gap_start, r.gap_end) for r in C.missing_ranges(c, 5, 0, 40).collect()) == [(10, 15), (20, 30), (35, 40)]


def test_contract_and_csv(spark, tmp_path):
    lines = [",".join(C.RAW.names)] + [f"{k * 60000},1,2,0.5,1.5,10,{k * 60000 + 59999},1,1,1,1,0" for k in range(6)]
    (tmp_path / "a.csv").write_text("\n".join(lines))
    got = C.read_csv(spark, str(tmp_path / "a.csv"), "A", "1m", 60_000, begin_ms=60_000)
    assert [r.bar_index for r in got.orderBy("open_time").collect()] == [0, 1, 2, 3, 4]
    (tmp_path / "b.csv").write_text("\n".join(lines[:3] + lines[4:]))
    with pytest.raises(C.ContractError):
        C.read_csv(spark, str(tmp_path / "b.csv"), "A", "1m", 60_000)
    C.write_parquet(got, str(tmp_path / "store"))
    assert C.read_parquet(spark, str(tmp_path / "store"), "1m").count() == 5


def test_thinning_grid_and_scaled_moves(spark):
    off = spark.createDataFrame([(k, True) for k in (1, 239, 240, 241, 245, 1440, 1441, 1455)], "offset_bars int, candidate boolean")
    assert sorted(r.offset_bars for r in library.thinned(off).collect()) == [1, 239, 240, 245, 1440, 1455]
    m = spark.createDataFrame([(2.0, 7.0)], "current_move_pct double, future_peak_move_pct double")
    for sign, base in ((1, 106), (-1, 94)):
        r = project.projected_moves(m, spark.createDataFrame([(6.0, sign)], "current_move_pct double, direction_sign int")).first()
        assert (r.scale, r.projected_future_pct) == (3.0, 21.0) and r.projected_adverse_pct == pytest.approx(15 / base * 100)


def test_display_candle_of_both_kinds(spark):
    c = spark.createDataFrame([("A", "1m", 0, 10.0, 12.0, 9.0, 11.0, 1.0), ("A", "1m", 60_000, 11.0, 13.0, 10.0, 12.0, 1.0), ("A", "1m", 120_000, 12.0, 15.0, 11.0, 13.0, 1.0), ("A", "1m", 180_000, 13.0, 14.0, 12.0, 14.0, 1.0)], "asset string, timeframe string, open_time long, open double, high double, low double, close double, volume double")
    r = rollup.actual_and_projected(c.where("open_time < 120000"), c.where("open_time >= 120000"), 300_000).first()
    assert (r.phase, r.open, r.high, r.low, r.close) == ("transition", 10, 15, 9, 14)


def test_small_statistics(spark):
    w = spark.createDataFrame([("x", 1.0)] * 8 + [("y", v) for v in (100.0, 1.0, 1.0, 1.0)], "g string, weight double")
    n = {r.g: r.effective_n for r in stats.effective_n(w, "g").collect()}
    assert n["x"] == 8 and n["y"] < 1.1
    q = spark.createDataFrame([("g", 1, 1.0, 1.0), ("g", 2, 5.0, 10.0), ("g", 3, 10.0, 1.0)], "g string, id int, value double, weight double")
    assert stats.weighted_quantile_step(q, 0.5, ["g"]).first()["quantile"] == 5
    rng = np.random.default_rng(1)
    v, wt = rng.normal(size=40), rng.random(40)
    rows = spark.createDataFrame([("g", k, float(a), float(b)) for k, (a, b) in enumerate(zip(v, wt))], "g string, id int, value double, weight double")
    o = np.argsort(v)
    share = np.cumsum(wt[o]) / wt.sum()
    for p in (0.01, 0.3, 0.99):
        assert stats.weighted_quantile_linear(rows, p, ["g"], "id").first()["quantile"] == pytest.approx(np.interp(p, share, v[o]))
    ece = spark.createDataFrame([("a", 0.0, 1), ("a", 0.0, 1), ("a", 0.0, 1), ("b", 0.0, 0)], "e string, score double, label int")
    assert evaluate.balanced_ece(ece, "e").first().ece == pytest.approx(0.5)
    weights = folds.episode_weights(spark.createDataFrame([("a",), ("a",), ("a",), ("b",)], "e string"), "e").collect()
    assert sorted(round(r.weight, 6) for r in weights) == [0.333333] * 3 + [1.0]


def test_neighbours_one_per_group(spark):
    q = spark.createDataFrame([(100, [0.0, 0.0])], "query_id long, vector array<double>")
    c = spark.createDataFrame([(k, g, [float(k), 0.0]) for k, g in enumerate("aabcd")], "candidate_id long, group_id string, vector array<double>")
    assert [r.candidate_id for r in knn.first_of_groups(knn.distances(q, c, 64), 3).orderBy("place").collect()] == [0, 2, 3]
    far = knn.within_radius(knn.distances(q, c.where("candidate_id > 0"), 3), 3, 0.5).collect()
    assert [(r.candidate_id, r.radius_failed) for r in far] == [(1, True)]


def test_stream_in_batches_equals_the_batch(spark, tmp_path):
    rows = walk(400, 3)
    c = candles(spark, rows)
    c.limit(0).write.parquet(f"{tmp_path}/in")
    out = stream.follow(spark.readStream.schema(c.schema).parquet(f"{tmp_path}/in"), 30, 5, RELAXED)
    for a in range(0, 400, 150):
        c.where((F.col("bar_index") >= a) & (F.col("bar_index") < a + 150)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = stream.run_available(spark, out, f"{tmp_path}/q")
    want = trace.trace(signals.detect(c, 5, RELAXED), c, 30).where("status <> 'right_censored'")
    key = lambda df: sorted(tuple(r) for r in df.select("signal_id", "status").collect())
    assert key(got) == key(want) and got.count() > 20


def test_sink_refuses_gaps_and_repeats_nothing(spark, tmp_path):
    c, write = candles(spark, walk(30, 1)), stream.append_in_order(f"{tmp_path}/t", 60_000)
    write(c.where("bar_index < 10"), 0)
    write(c.where("bar_index < 10"), 0)
    write(c.where("bar_index < 20"), 1)
    assert spark.read.parquet(f"{tmp_path}/t").count() == 20
    with pytest.raises(ValueError):
        write(c.where("bar_index >= 21"), 2)


def test_ledger_and_manifest(spark, tmp_path):
    rows = spark.createDataFrame([("A", "1m", "s", 1, "v", 5, None), ("A", "1m", "s", 1, "v", 6, None), ("A", "1m", "s", 2, "v", 5, "x")], "asset string, timeframe string, signal_id string, snapshot_ms long, model_version string, recorded_ms long, note string")
    assert ledger.append_once(rows, f"{tmp_path}/l") == 2 and ledger.append_once(rows, f"{tmp_path}/l") == 0
    held = ledger.with_backfill(spark.read.parquet(f"{tmp_path}/l"), F.col("snapshot_ms") < 3, {"note": F.lit("late")})
    assert {(r.snapshot_ms, r.note) for r in held.collect()} == {(1, "late"), (2, "x")} and ledger.latest(held).first().snapshot_ms == 2
    folder, kept, log = (f"file://{tmp_path}/{n}" for n in ("m", "kept", "log"))
    (tmp_path / "m/x").mkdir(parents=True)
    (tmp_path / "m/x/a.bin").write_bytes(b"1")
    (tmp_path / "m/b.bin").write_bytes(b"22")
    found = {(r.file, r.bytes, r.sha256) for r in manifest.write(spark, folder, kept, "1").collect()}
    assert found == {(n, len(c), hashlib.sha256(c).hexdigest()) for n, c in (("x/a.bin", b"1"), ("b.bin", b"22"))}
    manifest.verify(spark, folder, kept, "1")
    with pytest.raises(AnalysisException):
        manifest.write(spark, folder, kept, "1")
    (tmp_path / "m/x/a.bin").write_bytes(b"2")
    with pytest.raises(ValueError, match="x/a.bin"):
        manifest.verify(spark, folder, kept, "1")
    manifest.promote(spark, log, "1")
    manifest.promote(spark, log, "2")
    assert (manifest.in_use(spark, log), manifest.in_use(spark, log, 1)) == ("2", "1")
