import math

import numpy as np
from pyspark.sql import functions as F

from readloom.llm import topk
from readloom.llm.topk import ImpactIndex, top_k


def expected(rows, k):
    held = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(256 * float(x)) for x in v]
            held[i] = min(held.get(i, q), q)
    out = []
    for q in held:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(held[q], held[i], strict=True)), i) for i in held if i != q and len(held[i]) == len(held[q]))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.12, 16).astype(np.float32).tolist(), 1) for i in range(700)]
    rows += [(1000 + i, rows[50][1], 1) for i in range(40)]  # ties
    rows += [(1100, rows[7][1], 1), (1100, rows[8][1], 1), (1150, None, 1), (1200, [None] * 16, 1), (1250, [float("nan")] * 16, 1), (1300, [float("inf")] * 16, 1),
             (None, rows[1][1], 1), (1350, [], 1), (1400, [], 1), (1450, [0.5, 1.0], 1), (1451, [1.0, -1.0], 1), (1500, [0.0] * 16, 1), (1550, [100.0, -90.0] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(4)
    for block, queries in ((8192, 1024), (64, 5)):
        monkeypatch.setattr(topk, "BLOCK", block)
        monkeypatch.setattr(topk, "QUERY_BLOCK", queries)
        assert sorted(map(tuple, top_k(df, F.col("vec_id") % 50 == 0, 5).collect())) == expected(rows, 5)
    assert top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_search_stops_only_on_proof():
    rng = np.random.default_rng(1)
    rows = rng.integers(-120, 120, (5000, 32))
    rows[::7] //= 20
    index = ImpactIndex(np.arange(5000), rows)
    assert len(index.groups()) > 1 and index.groups()[-1][1] == len(index.levels)
    queries = rows[:60]
    for q, ids, scores in index.search(np.arange(60), queries, 5):
        exact = rows @ queries[q]
        order = [i for i in np.lexsort((np.arange(5000), -exact)) if i != q][:5]
        assert ids.tolist() == order and scores.tolist() == exact[order].tolist()


def test_even_vectors_stop_on_proof():
    """Vectors whose components are all of a size, as most embeddings are."""
    rng = np.random.default_rng(9)
    rows = np.floor(256 * (x := rng.normal(size=(4000, 64))) / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    index = ImpactIndex(np.arange(4000), rows)
    found = index.search(np.arange(60), rows[:60], 5)
    for q, ids, scores in found:
        exact = rows @ rows[q]
        order = [i for i in np.lexsort((np.arange(4000), -exact)) if i != q][:5]
        assert ids.tolist() == order and scores.tolist() == exact[order].tolist()
    assert len(found) == 60 and index.proved == 60 and index.through == 0
    assert index.touched < 0.9 * 60 * np.count_nonzero(rows)


def test_segments_touched_are_few_where_impacts_are_skewed():
    rng = np.random.default_rng(4)
    rows = (rng.pareto(1.2, (6000, 32)) * 20 * rng.choice([-1, 1], (6000, 32))).astype(np.int64)
    rows[rng.random((6000, 32)) < 0.5] = 0
    index = ImpactIndex(np.arange(6000), rows)
    assert sum(j - i for _, _, i, j in index.segments) == np.count_nonzero(rows)
    lowest = [min(np.abs(index.value[i:j]).min() for r, _, i, j in index.segments if r == run) for run in range(len(index.groups()))]
    assert lowest == sorted(lowest, reverse=True)
    found = index.search(np.arange(40), rows[:40], 5)
    for q, ids, scores in found:
        exact = rows @ rows[q]
        order = [i for i in np.lexsort((np.arange(6000), -exact)) if i != q][:5]
        assert ids.tolist() == order and scores.tolist() == exact[order].tolist()
    assert len(found) == 40 and 0 < index.touched < 0.3 * 40 * np.count_nonzero(rows)


def test_blocks_that_cannot_matter_are_passed_over():
    index = ImpactIndex(np.arange(100), np.ones((100, 4), dtype=np.int64))
    q = np.full((2, 4), 3)
    assert [x[0] for x in index.search(np.array([500, 501]), q, 5, np.array([13.0, 12.0]))] == [501]
    assert index.search(np.array([500]), q[:1], 5)[0][2].tolist() == [12] * 5
    huge = ImpactIndex(np.arange(3), np.array([[1 << 30, 3], [5, 1 << 30], [1, 1]]))
    assert huge.search(np.array([9]), np.array([[1 << 30, 1]]), 2)[0][2].tolist() == [(1 << 60) + 3, 5 * (1 << 30) + (1 << 30)]
