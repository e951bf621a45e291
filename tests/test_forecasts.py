"""Routes, supervised forecasts and small functions against plain versions."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import features, knn, models, project


def test_routes_take_the_best_free_episode_in_order(spark):
    rng = random.Random(4)
    pool = [(f"e{k:02}", k, rng.randint(1, 30), rng.uniform(0, 30), rng.uniform(1, 4)) for k in range(30)]
    wanted = [("early", 0, 3.0, 5.0, False), ("usual", 1, 8.0, 10.0, False), ("late", 2, 20.0, 20.0, False), ("against_first", 3, 12.0, 40.0, True)]
    matched = spark.createDataFrame(pool, "episode_id string, offset_bars long, remaining_bars long, projected_adverse_pct double, match_score double")
    got = {r.route: r.episode_id for r in project.routes(matched, spark.createDataFrame(wanted, "route string, order int, wait_bars double, adverse_pct double, adverse_first boolean")).collect()}
    mid, taken = np.median([p[4] for p in pool]), {}
    for name, _, wait, adverse, first in wanted:
        score = lambda p: (0.5 * abs(math.log((p[2] + 1) / (wait + 1))) + 0.5 * abs(p[3] - adverse) / max(adverse, 0.25) + 0.1 * p[4] / mid + (100 if first and p[2] <= 1 else 0), p[0])  # noqa: B023, E731
        taken[name] = min((p for p in pool if p[0] not in taken.values()), key=score)[0]
    assert got == taken


def test_supervised_forecasts_learn_rise_with_the_horizon_and_are_saved(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 2))
    rows = [(float(a), float(b), float(a > 0.3), float(a > -0.3), float(abs(b)), float(abs(b) * 2) if k % 9 else None) for k, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, hit_6 double, hit_24 double, adverse_6 double, adverse_24 double")
    fitted = models.fit(df, ["a", "b"], (6, 24), trees=5)
    got = models.predict(df, fitted, (6, 24)).toPandas()
    assert ((got.chance_6 >= 0) & (got.chance_6 <= got.chance_24 + 1e-12) & (got.chance_24 <= 1)).all()
    assert ((got.adverse_forecast_6 >= 0) & (got.adverse_forecast_6 <= got.adverse_forecast_24 + 1e-12)).all()
    assert ((got.chance_6 > 0.5) == (got.hit_6 == 1)).mean() > 0.9
    models.save(fitted, f"file://{tmp_path}/models")
    again = models.predict(df, models.load(f"file://{tmp_path}/models", (6, 24)), (6, 24)).toPandas()
    assert np.allclose(again.chance_24, got.chance_24) and np.allclose(again.adverse_forecast_6, got.adverse_forecast_6)
    span = models.ranges(models.predict(df, fitted, (6, 24)), 24).first()
    miss = (got.adverse_24 - got.adverse_forecast_24).dropna()
    assert (span.low, span.high, span.n) == (pytest.approx(miss.quantile(0.1)), pytest.approx(miss.quantile(0.9)), len(miss))


def test_calendar_groups_and_scales(spark):
    ms = lambda *t: int(dt.datetime(*t, tzinfo=dt.timezone.utc).timestamp() * 1000)
    at = spark.createDataFrame([(ms(2024, 2, 29, 13, 5),), (ms(2024, 3, 31),)], "t long")
    assert [tuple(r) for r in at.select(C.months_before(F.col("t"), 12), C.months_before(F.col("t"), 1), C.month_start(F.col("t")), C.month_start(F.col("t"), 1)).collect()] == [
        (ms(2023, 2, 28, 13, 5), ms(2024, 1, 29, 13, 5), ms(2024, 2, 1), ms(2024, 3, 1)), (ms(2023, 3, 31), ms(2024, 2, 29), ms(2024, 3, 1), ms(2024, 4, 1))]
    v = spark.createDataFrame([(0.5, 59.0), (1.0, 60.0), (30.0, 43_200.0), (None, None)], "d double, m double")
    assert [tuple(r) for r in v.select(C.distance_group(F.col("d")), C.age_group(F.col("m"))).collect()] == [("under_1pct", "under_1h"), ("1_3pct", "1h_6h"), ("over_30pct", "over_30d"), (None, None)]
    got = spark.range(1).select(features.signed_log1p(F.lit(-3.0)), C.epoch_ms(F.lit(1_700_000_000_000_000)), C.epoch_ms(F.lit(1_700_000_000_000)), features.decoded_distance(F.lit(math.log(3.0)), F.lit(5.0)), C.tertile(F.lit(1 / 3)), C.tertile(F.lit(0.9))).first()
    assert tuple(got) == (pytest.approx(-math.log(4)), 1_700_000_000_000, 1_700_000_000_000, pytest.approx(10.0), "low", "high")


@pytest.mark.parametrize("metric", ["euclidean", "manhattan_mean", "cosine"])
def test_metrics_and_weights(spark, metric):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5))
    rows = spark.createDataFrame([(k, [float(v) for v in r], k % 4) for k, r in enumerate(x)] + [(99, None, 0)], "id long, vector array<double>, g long")
    near = knn.distances(rows.where("id % 20 = 0").selectExpr("id AS query_id", "vector"), rows.selectExpr("id AS candidate_id", "g AS group_id", "vector"), 7, metric).collect()
    far = {"euclidean": lambda a, b: np.sqrt(((a - b) ** 2).sum()), "manhattan_mean": lambda a, b: np.abs(a - b).mean(), "cosine": lambda a, b: 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b)}[metric]
    for q in (0, 20, 40):
        want = sorted((far(x[q], x[k]), k) for k in range(60) if k != q)[:7]
        got = sorted((r.place, r.distance, r.candidate_id) for r in near if r.query_id == q)
        assert [g[2] for g in got] == [k for _, k in want] and [g[1] for g in got] == pytest.approx([d for d, _ in want])
    table = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 4.0)], "query_id long, distance double")
    for name, form in (("uniform", lambda d: 1.0), ("inverse", lambda d: 1 / (d / 2 + 0.05)), ("inverse_square", lambda d: 1 / (d / 2 + 0.05) ** 2), ("exponential", lambda d: math.exp(-d / 2)), ("offset", lambda d: 1 / (d + 0.2))):
        assert all(r.weight == pytest.approx(form(r.distance)) for r in knn.weights(table, name).collect())
