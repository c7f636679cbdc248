from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerflow.llm import topk


def brute(rows, asks, k):
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in {(i, tuple(v)) for i, v in sound if asks(i)}:
        found = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in sound if j != i and len(v) == len(w))
        out += [(i, rank + 1, j, max(-(2**63), min(2**63 - 1, -s))) for rank, (s, j) in enumerate(found[:k])]
    return sorted(out)


def run(spark, rows, asks, k=5):
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, score int, rank string")
    got = topk.top_k(frame, asks, k=k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("seed, dims, n", [(1, 8, 400), (2, 3, 900), (3, 64, 300)])
def test_equals_brute_force(spark, monkeypatch, seed, dims, n):
    monkeypatch.setattr(topk, "BLOCK_BYTES", 8 * dims * 64)
    monkeypatch.setattr(topk, "QUERY_BYTES", 8 * dims * 16)
    draw = random.Random(seed)
    rows = [(i, [draw.gauss(0, 0.4) for _ in range(dims)]) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(200)]
    assert run(spark, rows, F.col("vec_id") % 10 == 0) == brute(rows, lambda i: i % 10 == 0, 5)


def test_odd_vectors(spark):
    rows = [
        (0, [0.5, 0.5]), (1, None), (2, []), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (6, [0.1, -0.2]),
        (7, [0.1, -0.2]), (8, [1.0, 2.0, 3.0]), (50, [1.0, 2.0, 3.0]), (100, [4.0]), (None, [0.5, 0.5]), (9, [1e12, 1e12]), (150, [1e12, -3e11]), (6, [0.1, -0.2]), (0, [0.5, 0.5]),
    ]
    assert run(spark, rows, F.col("vec_id") % 50 == 0) == brute(rows, lambda i: i % 50 == 0, 5)


def test_empty_table(spark):
    assert run(spark, [], F.col("vec_id") % 50 == 0) == []


def test_bounds_hold_at_every_depth():
    draw = np.random.default_rng(5)
    values, queries = np.floor(draw.normal(0, 90, (500, 12))), np.floor(draw.normal(0, 90, (20, 12)))
    lists, exact = topk.SortedLists(values), queries @ values.T
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    widths = []
    for depth in (1, 20, 250, 499, 500):
        a, b, c, d = lists.read(depth)
        upper, lower = up @ a.T + down @ c.T, up @ b.T + down @ d.T
        assert (lower <= exact).all() and (exact <= upper).all()
        widths.append((upper - lower).mean())
    assert widths == sorted(widths, reverse=True) and widths[-1] == 0


def test_only_candidates_that_can_qualify_are_scored():
    draw = np.random.default_rng(9)
    # Each query has near ones among many others, as with embeddings of texts on one subject.
    centres = draw.normal(0, 1, (40, 16)) * (draw.random((40, 16)) < 0.3)
    values = np.floor(256 * (centres[draw.integers(0, 40, 8000)] + draw.normal(0, 0.05, (8000, 16))))
    queries, ids = values[:50], np.arange(8000)
    search = topk.Search(ids[:50], queries, 5)
    for at in range(0, 8000, 1000):
        search.offer(ids[at : at + 1000], values[at : at + 1000])
    exact = queries @ values.T
    for q in range(50):
        order = sorted((c for c in range(8000) if c != q), key=lambda c: (-exact[q, c], c))[:5]
        assert [(i, s) for x, i, s in search.results() if x == q] == [(c, int(exact[q, c])) for c in order]
    assert search.scored < 0.05 * 50 * 8000


def test_vectors_move_once(spark):
    frame = spark.range(2000).select(F.col("id").alias("vec_id"), F.array(*[F.rand(i) for i in range(8)]).alias("embedding"))
    plan = topk.top_k(frame, F.col("vec_id") % 50 == 0)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "CartesianProduct" not in physical and "BroadcastNestedLoopJoin" not in physical and physical.count("RoundRobinPartitioning") == 1
