"""Walk-forward neighbours of all folds against brute force."""

import random

import numpy as np
import pytest

from tidemark.operators import evaluate, folds, walkforward

DAY = 86_400_000


def test_walk_forward_equals_brute_force_in_every_fold(spark):
    rng = random.Random(2)
    features, categories = {"x": 1.0, "y": 0.5}, {"asset": 0.35, "direction": 0.15}
    rows = []
    for k in range(400):
        at = rng.randrange(30 * DAY)
        rows.append((f"o{k}", at, at + DAY, float(rng.random() < 0.4) if k % 9 else None, rng.gauss(0, 1 + at / DAY), 7.0, rng.choice("AB"), rng.choice(["up", "down"])))
    table = spark.createDataFrame(rows, "id string, open_time long, known_ms long, label double, x double, y double, asset string, direction string")
    f = folds.rolling_folds(spark, 0, 30 * DAY, 5 * DAY, 3 * DAY, 3 * DAY, DAY)
    predicted = walkforward.predict(table, f, 11, 60, features, categories)
    got = {(r.fold, r.query_id): r for r in predicted.collect()}
    known = [r for r in rows if r[3] is not None]
    want, scored = 0, set()
    for fold in f.collect():
        history = [r for r in known if r[2] <= fold.test_start]
        asked = [r for r in known if fold.test_start <= r[1] < fold.test_end]
        if len(history) < 60 or not asked:
            continue
        scored.add(fold.fold)
        scale = {}
        for name, c in (("x", 4), ("y", 5)):
            v = np.array([h[c] for h in history])
            mad, sd = np.median(np.abs(v - np.median(v))) * 1.4826, v.std()
            scale[name] = mad if mad > 1e-12 else sd if sd > 1e-12 else 1.0
        for o in asked:
            want += 1
            d = sorted((np.sqrt(((o[4] - h[4]) / scale["x"]) ** 2 + ((o[5] - h[5]) / scale["y"] * 0.5) ** 2 + (o[6] != h[6]) * 0.35**2 + (o[7] != h[7]) * 0.15**2), h[0], h[3]) for h in history)[:11]
            r = got[(fold.fold, o[0])]
            assert (r.label, r.n_train) == (o[3], len(history)) and r.base_score == pytest.approx(np.mean([h[3] for h in history]))
            assert r.score == pytest.approx(sum(y / (x + 0.2) for x, _, y in d) / sum(1 / (x + 0.2) for x, _, _ in d))
    assert want == len(got) and len(scored) >= 6
    for r in walkforward.fold_metrics(predicted).collect():
        mine = [g for (fold, _), g in got.items() if fold == r.fold]
        assert (r.n_test, r.brier) == (len(mine), pytest.approx(np.mean([(g.score - g.label) ** 2 for g in mine])))


def test_bootstrap_interval_of_a_known_gain(spark):
    rng = np.random.default_rng(1)
    a = rng.uniform(1, 3, 600)
    rows = [(k % 150, float(x), float(x * 0.8 + rng.normal(0, 0.2))) for k, x in enumerate(a)]
    df = spark.createDataFrame(rows, "episode long, a double, b double")
    one, two = (evaluate.paired_bootstrap(df.repartition(n), "episode", "a", "b").first() for n in (1, 5))
    assert one.gain == pytest.approx(two.gain) and one.low == pytest.approx(two.low) and one.high == pytest.approx(two.high)
    assert one.low < one.gain < one.high and 0.17 < one.gain < 0.23
    # against the spread of plain resamples
    per = [[np.mean([r[c] for r in rows if r[0] == e]) for e in range(150)] for c in (1, 2)]
    draws = [1 - np.take(per[1], i).sum() / np.take(per[0], i).sum() for i in (rng.integers(0, 150, 150) for _ in range(800))]
    assert one.high - one.low == pytest.approx(np.quantile(draws, 0.975) - np.quantile(draws, 0.025), rel=0.25)
