"""Neighbours in blocks against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import knn


@pytest.mark.parametrize("metric", ["euclidean", "manhattan_mean", "cosine"])
def test_blocks_equal_brute_force(spark, monkeypatch, metric):
    monkeypatch.setattr(knn, "CANDIDATE_BLOCK", (16, 32))
    rng = np.random.default_rng(4)
    x = rng.integers(-3, 4, (150, 3)).astype(float) + 0.5
    c = spark.createDataFrame([(k, k % 7, v.tolist()) for k, v in enumerate(x)], "candidate_id long, group_id long, vector array<double>")
    q = c.where("candidate_id % 2 = 0").select(F.col("candidate_id").alias("query_id"), "vector")
    got = {}
    for r in knn.distances(q, c, 6, metric, query_block=10).collect():
        got.setdefault(r.query_id, []).append((r.place, r.candidate_id, r.group_id, r.distance))
    assert sorted(got) == list(range(0, 150, 2))
    for k, near in got.items():
        if metric == "cosine":
            d = 1 - x @ x[k] / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[k]))
        else:
            d = np.sqrt(((x - x[k]) ** 2).sum(axis=1)) if metric == "euclidean" else np.abs(x - x[k]).mean(axis=1)
        d[k] = np.inf
        near.sort()
        assert [n[0] for n in near] == [1, 2, 3, 4, 5, 6] and all(g == i % 7 for _, i, g, _ in near)
        assert [n[3] for n in near] == pytest.approx(np.sort(d)[:6])
        assert all(d[i] == pytest.approx(v) for _, i, _, v in near)
        if metric != "cosine":
            assert [n[1] for n in near] == sorted(range(150), key=lambda j: (d[j], j))[:6]


def test_more_queries_than_a_driver_took(spark):
    q = spark.range(20_500).select(F.col("id").alias("query_id"), F.array(F.col("id").cast("double")).alias("vector"))
    c = q.where("query_id % 5000 = 0").select(F.col("query_id").alias("candidate_id"), F.lit(0).alias("group_id"), "vector")
    assert knn.distances(q, c, 1).agg(F.count("*")).first()[0] == 20_500
    assert knn.distances(q.limit(0), c, 1).count() == knn.distances(q.limit(5), c.limit(0), 1).count() == 0


def test_a_task_keeps_few_rows_whatever_the_depth(spark, monkeypatch):
    dealt, blocks = knn._dealt, []
    monkeypatch.setattr(knn, "_dealt", lambda rows, own, *rest: (blocks.append(rest[1]) if own == "_q" else None, dealt(rows, own, *rest))[1])
    monkeypatch.setattr(knn, "_CELLS", 4096)
    q = spark.range(3000).select(F.col("id").alias("query_id"), F.array((F.col("id") % 3).cast("double")).alias("vector"))
    c = spark.range(30).select(F.col("id").alias("candidate_id"), F.lit(0).alias("group_id"), F.array((F.col("id") % 2).cast("double")).alias("vector"))
    found = knn.distances(q, c, 512)
    assert -(-3000 // blocks[0]) * 512 <= 1 << 19
    # all are ties of a few distances: every candidate but the query's own, by distance and id
    got = [r.candidate_id for r in found.where("query_id = 7").orderBy("place").collect()]
    assert got == sorted((k for k in range(30) if k != 7), key=lambda k: (abs(k % 2 - 1), k))
