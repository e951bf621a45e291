"""Ranks, running sums and quantiles of large groups against plain versions; both plans give the same."""

import random

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import features, folds, ranks, stats


def _rows():
    rng = random.Random(5)
    return [(rng.choice(["a", "a", "a", "b", None]), k, rng.choice([None, 1.0, 2.0, 2.0, rng.random() * 5]), rng.randint(1, 4), rng.randint(0, 1)) for k in range(400)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(_rows(), "g string, id long, value double, weight long, label int")


@pytest.mark.parametrize("local", [10, 1_000_000])
def test_running_sums_and_previous_rows(spark, table, local):
    got = {r.id: r for r in ranks.running(table.fillna(0.5, ["value"]), ["g"], ["value", "id"], "weight", "id", local).collect()}
    pdf = pd.DataFrame(_rows(), columns=["g", "id", "value", "weight", "label"]).fillna({"value": 0.5, "g": "-"}).sort_values(["value", "id"])
    for _, group in pdf.groupby("g"):
        total, before = 0, None
        for r in group.itertuples():
            assert (got[r.id]["_before"], got[r.id]["_all"], got[r.id]["_previous"]) == (total, group.weight.sum(), before)
            total, before = total + r.weight, r.id


@pytest.mark.parametrize("local", [10, 1_000_000])
def test_ranks_and_quantiles(spark, table, local):
    pdf = pd.DataFrame(_rows(), columns=["g", "id", "value", "weight", "label"]).fillna({"g": "-"})
    known = pdf.dropna(subset=["value"])
    want = known.assign(rank=known.groupby("g").value.rank(), pct=known.groupby("g").value.rank(pct=True), top=known.groupby("g").value.rank("max", pct=True)).set_index("id")
    for r in ranks.ranked(table, ["g"], "value", local).collect():
        if r.value is None:
            assert r["rank"] is None and r.percentile is None
        else:
            assert (r["rank"], r.percent_rank, r.percentile) == pytest.approx((want["rank"][r.id], want.pct[r.id], want.top[r.id]))
    qs = [0.0, 0.1, 0.5, 0.77, 1.0]
    for r in ranks.quantiles(table, ["g"], "value", qs, local).collect():
        mine = known[known.g == (r.g or "-")].value
        assert [r[f"q{k}"] for k in range(5)] == pytest.approx(list(np.quantile(mine, qs)))
    long = table.selectExpr("'x' AS name", "value")
    scale = stats.robust_scales(long, local_rows=local).first()
    mad = np.median(np.abs(known.value - known.value.median())) * 1.4826
    assert (scale.center, scale["scale"]) == pytest.approx((known.value.median(), mad if mad > 1e-12 else known.value.std(ddof=0)))
    for r in stats.auc(table.withColumnRenamed("value", "score").where("score IS NOT NULL"), "g", local_rows=local).collect():
        mine = known[known.g == (r.g or "-")]
        pos, neg = mine[mine.label == 1].value.to_numpy(), mine[mine.label == 0].value.to_numpy()
        assert r.auc == pytest.approx(((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg)))
    some = table.where("g IS NOT NULL AND value IS NOT NULL")
    both = [{r.g: r["quantile"] for r in stats.weighted_quantile_linear(some, 0.7, ["g"], "id", n).collect()} for n in (local, 1_000_000)]
    assert both[0] == pytest.approx(both[1])


def test_rolling_windows_longer_than_a_block(spark):
    n, w = 30_000, 10_080
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"asset": "A", "timeframe": "1m", "bar_index": np.arange(n), "close": 100 + rng.normal(0, 1, n).cumsum() * 0.01, "volume": rng.uniform(1, 9, n)})
    pdf["high"], pdf["low"] = pdf.close + 1, pdf.close - 1
    got = features.rolling(spark.createDataFrame(pdf), (12, w)).toPandas().sort_values("bar_index").reset_index(drop=True)
    assert len(got) == n
    change = pdf.close.pct_change() * 100
    mean = pdf.volume.rolling(w, min_periods=2).mean()
    for column, want in ((f"return_{w}", (pdf.close / pdf.close.shift(w) - 1) * 100), (f"volatility_{w}", change.rolling(w, min_periods=2).std(ddof=0)), (f"volume_ratio_{w}", mean / mean.shift(w)), ("return_12", (pdf.close / pdf.close.shift(12) - 1) * 100)):
        np.testing.assert_allclose(got[column].to_numpy(float), want.to_numpy(), rtol=1e-6, atol=1e-9, equal_nan=True)


def test_samples_of_large_tables(spark):
    rows = spark.range(1000).selectExpr("id", "id % 7 AS kind", "1000 - id AS t")
    assert [r.id for r in folds.evenly_spaced(rows, 5, ["t"]).orderBy("t").collect()] == [999, 750, 500, 250, 0]
    found = folds.stratified_sample(rows, 21, ["kind"], ["t"]).groupBy("kind").count().collect()
    assert all(r["count"] == 3 for r in found) and len(found) == 7


@pytest.mark.parametrize("local", [10, 1_000_000])
def test_as_of_takes_the_last_value_strictly_before(spark, local):
    rng = random.Random(9)
    right = [(rng.choice("ab"), rng.randrange(0, 3000, 10), float(k)) for k in range(300)]
    left = [(k, rng.choice(["a", "b", "c", None]), rng.randrange(0, 3000, 5)) for k in range(200)]
    got = {r.id: r.v for r in ranks.as_of(spark.createDataFrame(left, "id long, s string, at long"), spark.createDataFrame(right, "s string, t long, v double"), ["s"], "at", "t", "v", "id", local).collect()}
    assert len(got) == 200
    for k, s, at in left:
        earlier = [(t, v) for r, t, v in right if r == s and t < at]
        assert got[k] == (max(earlier)[1] if earlier else None)
