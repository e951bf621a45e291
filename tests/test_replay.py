"""Blocked searches against plain versions: medians over pairs, replays, settings, retrieval, and what crashes must not."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import crossing, match, replay, retrieval, variants


def values(asked, held):
    known = held["t"].to_numpy()[None] <= asked["at"].to_numpy()[:, None]
    off = held["v"].to_numpy(float)[None] - asked["c"].to_numpy(float)[:, None]
    return {"raw": np.where(known, held["v"].to_numpy(float)[None], np.nan), "off": np.where(known, np.abs(off), np.nan)}


@pytest.mark.parametrize("blocks", ((1, 1), (3, 1), (2, 5)))
def test_medians_of_pairs(spark, blocks):
    rng = np.random.default_rng(4)
    held = [(f"e{k}", int(rng.integers(0, 40)), float(rng.choice([-2.0, 0.0, -0.0, 1e-9, 3.5, 7.25, 1e6])) if k % 3 else float(rng.normal())) for k in range(90)]
    asked = [(f"q{k}", int(rng.integers(-2, 45)), float(rng.normal())) for k in range(25)]
    got = crossing.medians(spark.createDataFrame(asked, "query_id string, at long, c double"), spark.createDataFrame(held, "episode_id string, t long, v double"), values, ("raw", "off"), blocks).collect()
    want = {}
    for q, at, c in asked:
        seen = [v for _, t, v in held if t <= at]
        if seen:
            want[q, "raw"] = (len(seen), float(np.median(seen)))
            want[q, "off"] = (len(seen), float(np.median(np.abs(np.array(seen) - c))))
    assert {(r.query_id, r.name): (r.n, pytest.approx(r.median)) for r in got} == want


def library(n=60, seed=2):
    """Episodes that last up to 30 bars, their states and routes."""
    rng = np.random.default_rng(seed)
    episodes, states, paths = [], [], []
    for k in range(n):
        bars, left = int(rng.integers(4, 30)), int(rng.integers(1, 4))
        name, begin = f"ep{k:03}", int(rng.integers(0, 2_000)) * 60_000
        features = [float(x) for x in np.round(rng.uniform(0.05, 1.5, 7), 4)]
        episodes.append((name, "ab"[k % 2], "1m", 1, ("lower_wick", "upper_wick")[k % 3 == 0], 1 if k % 3 else -1, begin, begin + (bars + 1) * 60_000, left, bars, *features))
        moves = np.round(rng.uniform(-0.5, 6.0, bars + 1), 3)
        peaks = np.maximum.accumulate(moves + 0.5)
        for i in range(bars + 1):
            future = float(moves[i + 1 :].max() + 0.5) if i < bars else None
            states.append((name, "ab"[k % 2], "1m", episodes[-1][4], episodes[-1][5], i, float(moves[i]), float(peaks[i]), float(max(peaks[i] - moves[i], 0.0)), bars - i, future, bool(0 < i < bars and i >= left and moves[i] > 0)))
            paths.append((name, i, begin + i * 60_000))
    return episodes, states, paths


def frames(spark, rows):
    episodes, states, paths = rows
    kinds = "episode_id string, asset string, timeframe string, interval_minutes int, direction string, direction_sign int, signal_open_ms long, fill_close_ms long, signal_to_departure_bars long, signal_to_fill_bars long, " + ", ".join(f"{f} double" for f in replay.FEATURES)
    state = "episode_id string, asset string, timeframe string, direction string, direction_sign int, offset_bars long, current_move_pct double, peak_move_pct double, drawdown_pct double, remaining_bars long, future_peak_move_pct double, candidate boolean"
    return spark.createDataFrame(paths, "episode_id string, offset_bars long, open_time long"), spark.createDataFrame(states, state), spark.createDataFrame(episodes, kinds)


def plain_alignments(rows, offsets, k):
    episodes, states, paths = rows
    by_id = {e[0]: e for e in episodes}
    opened = {(p[0], p[1]): p[2] for p in paths}
    weights, shares = list(match.FEATURE_WEIGHTS.values()), list(match.STATE_WEIGHTS.values())
    out = {}
    for s in states:
        own = by_id[s[0]]
        if s[5] not in offsets or s[9] <= 0 or s[5] < own[8] or s[6] <= 0:
            continue
        now = opened[s[0], s[5]] + 60_000
        seen = [e for e in episodes if e[7] <= now and e[0] != s[0]]
        if not seen:
            continue
        table = np.array([e[10:] for e in seen])
        mad = np.median(np.abs(table - np.median(table, axis=0)), axis=0) * 1.4826
        scale = np.where(mad > 1e-12, mad, np.where(table.std(axis=0) > 1e-12, table.std(axis=0), 1.0))
        found = []
        for e in seen:
            best = None
            for c in states:
                if c[0] != e[0] or not c[11]:
                    continue
                mine, theirs = (s[6], s[7], s[8], float(s[5])), (c[6], c[7], c[8], float(c[5]))
                score = sum(w * abs(np.log((max(x, 0) + f) / (max(y, 0) + f))) for (w, f), x, y in zip(shares, theirs, mine))
                if best is None or score < best[0]:
                    best = (score, c[5])
            if best:
                feature = sum(w * abs(a - b) / z for w, a, b, z in zip(weights, e[10:], own[10:], scale))
                found.append((best[0] + 0.5 * feature + 0.35 * (e[1] != own[1]) + 0.10 * (e[4] != own[4]), e[0], best[1]))
        out[f"{s[0]}@{s[5]}"] = (len(seen), len(found), sorted(found)[:k])
    return out


@pytest.mark.parametrize("blocks", ((1, 1), (3, 4)))
def test_alignments_of_all_moments(spark, blocks):
    rows = library()
    paths, states, episodes = frames(spark, rows)
    asked = replay.moments(paths, states, episodes, (2, 5)).where("status = 'ready'")
    held = replay.library_of(episodes, states)
    got = {}
    for r in replay.alignments(replay.scaled_moments(asked, held, blocks), held, 7, blocks).collect():
        got.setdefault(r.query_id, []).append(r)
    want = {q: x for q, x in plain_alignments(rows, (2, 5), 7).items() if x[2]}
    assert len(want) > 30 and got.keys() == want.keys()
    for q, (eligible, matched, found) in want.items():
        mine = sorted(got[q], key=lambda r: (r.match_score, r.episode_id))
        assert [(r.episode_id, r.offset_bars, pytest.approx(r.match_score)) for r in mine] == [(e, o, s) for s, e, o in found]
        assert {(r.eligible, r.matched) for r in mine} == {(eligible, matched)}


def test_replay_never_looks_ahead(spark):
    """A later episode that is the same as a moment's own changes nothing that the moment is told."""
    episodes, states, paths = library()
    before = replay.replay(*frames(spark, (episodes, states, paths)), (2, 5), 15, 12)
    late = max(e[7] for e in episodes)
    extra = [(f"late{k}", *e[1:6], e[6] + late, e[7] + late, *e[8:]) for k, e in enumerate(episodes)]
    more = [(f"late{k}", *s[1:]) for k, e in enumerate(episodes) for s in states if s[0] == e[0]]
    routes = [(f"late{k}", p[1], p[2] + late) for k, e in enumerate(episodes) for p in paths if p[0] == e[0]]
    after = replay.replay(*frames(spark, (episodes + extra, states + more, paths + routes)), (2, 5), 15, 12)
    key = lambda df: {r.query_id: r for r in df.where("NOT query_id LIKE 'late%'").collect()}
    assert key(before) == key(after) and sum(r.status == "evaluated" for r in key(before).values()) > 10
    told = replay.report(before).where("offset_bars IS NULL").first()
    assert told.moments == before.count() and 0 <= told.joint_coverage <= min(told.duration_coverage, told.excursion_coverage)


def test_replay_in_three_modes(spark):
    """Blocks change nothing, the adaptive mode is `replay`'s, pools hold the nearest candles, and routes are measured as stated."""
    episodes, states, paths = library()
    p, s, e = frames(spark, (episodes, states, paths))
    reference = e.where("episode_id = 'ep007'")
    made = lambda blocks: {(r.moment_id, r.mode): r for r in replay.shape_replay(p, s, e, reference, (2, 5), 1e9, 15, 12, 14, (1, 2, 6, 40), blocks).collect()}
    got = made((1, 1))
    assert got == made((3, 4)) and {m for _, m in got} == set(replay.MODES)
    alone = {r.query_id: r for r in replay.replay(p, s, e, (2, 5), 15, 12).collect()}
    same = ("status", "eligible", "actual_future_pct", "duration_covered", "excursion_covered", "duration_log_error", "excursion_error_pct")
    assert {q for q, m in got if m == "adaptive"} == set(alone)
    for q, r in alone.items():
        assert [getattr(got[q, "adaptive"], c) for c in same] == [getattr(r, c) for c in same]
    done = [r for r in got.values() if r.status == "evaluated"]
    assert {r.mode for r in done} == set(replay.MODES)
    assert all(r.eligible <= 14 for r in got.values() if r.mode == "archetype") and any(r.eligible > 14 for r in done)
    near = replay.shape_replay(p, s, e, reference, (2, 5), 30.0, 15, 12, 14, (1, 2, 6, 40))
    assert 0 < near.count() < len(got) and near.agg(F.max("reference_distance")).first()[0] <= 30.0

    # the pools, and the scores of the candle's shape, by plain loops
    def shape(a, b):
        points, factors = list(match.SHAPE_POINTS.values()), list(match.SHAPE_FACTORS.values())
        parts = [abs(x - y) * 100 / u for x, y, u in zip(a, b, points)] + [np.log(x / y) / np.log(f) for x, y, f in zip(a[3:], b[3:], factors)] + [a[6] - b[6]]
        return float(np.sqrt(np.mean(np.square(parts))))

    by_id, opened = {x[0]: x for x in episodes}, {(x[0], x[1]): x[2] for x in paths}
    blocks = (2, 3)
    held, asked = replay.library_of(e, s), replay.moments(p, s, e, (2, 5)).where("status = 'ready'")
    moded = replay.moded(replay.scaled_moments(asked, held, blocks), held, blocks, 14)
    matched = {}
    for r in replay.alignments(moded, held, 60, blocks).where("query_id LIKE '%archetype'").collect():
        matched.setdefault(r.query_id.removesuffix("@archetype"), {})[r.episode_id] = r.match_score
    shares = list(match.STATE_WEIGHTS.values())
    for q, scores in matched.items():
        own, at = q.split("@")
        now = opened[own, int(at)] + 60_000
        seen = sorted((shape(x[10:], by_id[own][10:]), x[0]) for x in episodes if x[7] <= now and x[0] != own)[:14]
        mine = next(x for x in states if x[0] == own and x[5] == int(at))
        want = {}
        for far, name in seen:
            parts = [sum(w * abs(np.log((max(x, 0) + f) / (max(y, 0) + f))) for (w, f), x, y in zip(shares, (c[6], c[7], c[8], c[5]), (mine[6], mine[7], mine[8], mine[5]))) for c in states if c[0] == name and c[11]]
            if parts:
                want[name] = min(parts) + 0.5 * 1.5 * far
        assert scores == pytest.approx(want)

    # routes end at the target
    moves = {(x[0], x[5]): x[6] for x in states}
    case = [("ep001@2", "ep001", 2, by_id["ep001"][9] - 2, "ep002", 3, by_id["ep002"][9] - 3, 1.5)]
    kinds = "query_id string, episode_id string, offset_bars long, actual_remaining_bars long, normal_episode_id string, normal_offset_bars long, normal_remaining_bars long, normal_scale double"
    move = lambda name, at, scale: 0.0 if at >= by_id[name][9] else max(moves[name, at] * scale, 0.0)
    want = np.mean([abs(move("ep002", 3 + h, 1.5) - move("ep001", 2 + h, 1.0)) for h in (1, 2, 6, 40)])
    assert replay.path_errors(spark.createDataFrame(case, kinds), s, (1, 2, 6, 40)).first().path_error_pct == pytest.approx(want)


def test_search_of_variants_equals_single_searches(spark):
    rng = np.random.default_rng(8)
    sizes = {"state": 3, "context": 2, "pre": 2, "recent": 2, "episode": 4}
    vectors = lambda: [[float(x) for x in rng.normal(size=n)] for n in sizes.values()]
    kinds = ", ".join(f"{b} array<double>" for b in sizes)
    asked = [(f"q{k}", *vectors()) for k in range(12)]
    held = [(f"o{k}", f"s{k // 3}", *vectors()) for k in range(60)]
    queries = spark.createDataFrame(asked, f"query_id string, {kinds}")
    history = spark.createDataFrame(held, f"observation_id string, signal_id string, {kinds}").withColumn("place", variants.sample_place("signal_id"))
    place = {r.signal_id: r.place for r in history.collect()}
    settings = {n: (w, 1.0) for n, w in variants.configurations().items()} | {"half": ({"state": 1.0, "pre": 2.0}, 0.5)}
    assert len(variants.configurations()) == 21
    for blocks in ((1, 1), (2, 3)):
        got = {}
        for r in variants.search(queries, history, settings, 5, blocks).collect():
            got.setdefault((r.query_id, r.variant), []).append((r.place, r.observation_id, r.signal_id, pytest.approx(r.distance)))
        for q in asked:
            for name, (weights, share) in settings.items():
                far = []
                for h in held:
                    if place[h[1]] < share:
                        d = sum(weights.get(b, 0) ** 2 * float(((np.array(q[1 + j]) - np.array(h[2 + j])) ** 2).sum()) for j, b in enumerate(sizes))
                        far.append((d**0.5, h[0], h[1]))
                first = {}
                for d, o, s in sorted(far):
                    first.setdefault(s, (d, s, o))
                want = [(n, o, s, d) for n, (d, s, o) in enumerate(sorted(first.values())[:5], 1)]
                assert sorted(got[q[0], name]) == want


def test_retrieval_pools_are_exact(spark):
    rng = np.random.default_rng(3)
    row = lambda: ([float(x) for x in rng.normal(size=3)], [float(x) for x in rng.normal(size=6)], [float(x) for x in rng.normal(size=2)])
    asked, held = [(k, *row()) for k in range(6)], [(100 + k, k % 9, *row()) for k in range(80)]
    kinds = "scalar array<double>, embedding array<double>, forecast array<double>"
    queries, candidates = spark.createDataFrame(asked, f"query_id long, {kinds}"), spark.createDataFrame(held, f"candidate_id long, group_id int, {kinds}")
    found = {}
    for blocks in ((1, 1), (2, 4)):
        pool = retrieval.pools(queries, candidates, 10, blocks)
        found[blocks] = sorted((r.mode, r.query_id, r.place, r.candidate_id, round(r.distance, 9)) for r in retrieval.ranked(pool, 10, 4).collect())
    assert found[1, 1] == found[2, 4]
    cosine = lambda a, b: 1 - float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    hits = 0
    for q in asked:
        scalar = {h[0]: float(np.abs(np.array(q[1]) - np.array(h[2])).sum()) for h in held}
        neural = {h[0]: cosine(np.array(q[2]), np.array(h[3])) for h in held}
        near = lambda d: sorted(d, key=lambda k: (d[k], k))[:10]
        pool = set(near(scalar)) | set(near(neural))
        total = {k: 0.35 * scalar[k] / np.median([scalar[x] for x in pool]) + 0.65 * neural[k] / np.median([neural[x] for x in pool]) for k in scalar}
        group = {h[0]: h[1] for h in held}

        def first(keys):
            best = {}
            for k in sorted(keys, key=lambda k: (total[k], k)):
                best.setdefault(group[k], k)
            return sorted(best.values(), key=lambda k: (total[k], k))[:4]

        mine = [c for mode, who, _, c, _ in found[1, 1] if mode == "hybrid" and who == q[0]]
        assert mine == first(pool)
        hits += len(set(mine) & set(first(total)))
    # recall of the pool against ranking every candidate
    assert hits / (4 * len(asked)) >= 0.8


def test_zero_prices_and_ratios_are_missing_not_fatal(spark):
    columns = [*match.SHAPE_POINTS, *match.SHAPE_FACTORS]
    rows = spark.createDataFrame([("a", *[0.5] * 6), ("b", *[0.0] * 6)], "episode_id string, " + ", ".join(f"{c} double" for c in columns))
    assert match.near_clones(rows, rows.where("episode_id = 'b'")).first().eligible == 2
    from tidemark.operators import trace

    traced = spark.createDataFrame([("A", "1m", "s", "lower_wick", 1, 0, "unfilled", 3, None, 0.0)], "asset string, timeframe string, signal_id string, direction string, direction_sign int, open_time long, status string, departure_index long, fill_index long, wick_target double")
    candles = spark.createDataFrame([("A", "1m", 5, 1.0)], "asset string, timeframe string, bar_index long, close double")
    assert trace.open_signals(traced, candles).count() == 0


def test_observation_matching_in_blocks(spark):
    rng = np.random.default_rng(1)
    names = [*match.FEATURE_WEIGHTS, "entry_distance_pct", "peak_distance_pct", "drawdown_pct", "age_bars"]
    made = lambda p, n: [(f"{p}{k}", *(float(x) for x in np.round(rng.uniform(0.05, 3, len(names)), 3)), "ab"[k % 2], ("1m", "5m")[k % 3 == 0], ("up", "down")[k % 5 == 0]) for k in range(n)]
    kinds = ", ".join(f"{n} double" for n in names) + ", asset string, timeframe string, direction string"
    observed, queries = spark.createDataFrame(made("o", 70), f"observation_id string, {kinds}"), spark.createDataFrame(made("q", 9), f"query_id string, {kinds}")
    scales = spark.createDataFrame([(n, 0.5 + k) for k, n in enumerate(match.FEATURE_WEIGHTS)], "name string, scale double")
    results = [sorted((r.query_id, r.place, r.observation_id, round(r.match_score, 9)) for r in match.observation_scores(observed, queries, scales, k=6, blocks=b).collect()) for b in ((1, 1), (2, 3))]
    assert results[0] == results[1] and len(results[0]) > 30
    facts = {r.observation_id: r for r in observed.collect()} | {r.query_id: r for r in queries.collect()}
    for q, _, o, _ in results[0]:
        a, b = facts[q], facts[o]
        assert a.direction == b.direction and (a.asset == b.asset or "1m" not in (a.timeframe, b.timeframe))


def test_queries_run_on_empty_tables(spark, tmp_path):
    """Every query of the catalogue on tables without rows."""
    from tidemark.plans import catalogue

    for t in ("events", "lineitem", "embeddings"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/{t}.parquet")
    names = ("rolling_folds", "eligible_history", "walk_forward_knn", "matched_observations", "near_clone_audit", "path_replay", "shape_replay", "shape_replay_report", "shape_replay_gains", "age_stratified_cap", "retrieval_modes", "event_props", "knn_topk", "strict_signals")
    for name in names:
        assert catalogue.QUERIES[name](spark, str(tmp_path)).count() == (1 if name == "near_clone_audit" else 0), name
