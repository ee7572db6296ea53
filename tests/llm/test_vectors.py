from __future__ import annotations

import math

import numpy as np
import pytest

from millrace.llm import hnsw, topk

SCHEMA = "vec_id long, embedding array<float>, rank int"


def vectors(spark, n=400, dim=12, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * rng.uniform(0.1, 3, size=(n, 1))
    if copies:
        x[n // 3 : n // 3 + copies] = x[0]
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x.astype(np.float32))]
    return spark.createDataFrame(rows, SCHEMA), x.astype(np.float32).astype(float)


def brute(ids, x, every, k, score):
    out = {}
    for i in range(len(ids)):
        if ids[i] % every == 0:
            s = score(x[i], x)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
            out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order]
    return out


@pytest.mark.parametrize("copies", [0, 130])
def test_top_k_is_exact(spark, copies, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    df, x = vectors(spark, copies=copies)
    q = np.floor(256 * x)
    want = brute(np.arange(len(x)), q, 50, 5, lambda a, m: m @ a)
    got = {}
    for r in topk.top_k(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == want


def test_top_k_edge_cases(spark):
    rows = [(0, [0.0, 0.0], 1), (50, None, 1), (1, [1.0, float("nan")], 1), (2, [1.0, None], 1), (3, [0.5, 0.5], 1), (3, [0.5, 0.5], 1), (None, [1.0, 1.0], 1), (4, [], 1), (5, [-1.0], 1), (6, [float("inf"), 0.0], 1), (100, [-1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in topk.top_k(df, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3, 0), (0, 2, 3, 0), (0, 3, 4, 0), (100, 1, 5, 65536), (100, 2, 0, 0), (100, 3, 4, 0)]
    assert topk.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("copies", [0, 500])
def test_hnsw_recall(spark, copies):
    df, x = vectors(spark, n=1500, dim=16, seed=3, copies=copies)
    want = brute(np.arange(len(x)), x, 20, 20, lambda a, m: m @ a)
    got = {}
    for r in hnsw.nearest(df, shard=600).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, found in got.items():
        assert all(abs(s - x[i] @ x[q]) < 1e-9 for i, s in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))


def test_hnsw_edge_cases(spark):
    rows = [(0, [0.0, 0.0], 1), (40, [1.0, 1.0], 1), (60, None, 1), (1, [1.0, float("nan")], 1), (4, [], 1), (3, [0.5, 0.5], 1), (3, [0.5, 0.5], 1), (None, [1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in hnsw.nearest(df).collect()] == [(40, 1, 3, 1.0), (40, 2, 3, 1.0)]
    assert hnsw.nearest(df.limit(0)).count() == 0


def test_top_k_of_large_components_is_exact(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 3))
    x[1], x[7], x[50], x[9], x[10], x[11], x[12] = [300000.0, 0, 0], [1e9, -1e9, 3], [1.0, 2.5e8, -7], [1e200, 1, 1], [1e200, 2, 1], [-1e200, 0, 1], [1e300, -1e300, 0]
    df = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, rank int")
    whole = [[math.floor(256 * c) if abs(256 * c) < 2**53 else int(256 * c) for c in v] for v in x.tolist()]
    for k in (5, 118):
        got = {}
        for r in topk.top_k(df, k=k).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        for q in (0, 50, 100):
            scores = {i: sum(a * b for a, b in zip(whole[q], whole[i])) for i in range(120) if i != q}
            best = sorted(scores, key=lambda i: (-scores[i], i))[:k]
            assert got[q] == [(i, max(-(2**63), min(2**63 - 1, scores[i]))) for i in best]


def test_hnsw_with_a_very_long_vector(spark):
    df, x = vectors(spark, n=900, dim=16, seed=8)
    x[13], x[40, 0], x[77] = 1e200, -3e155, -1e200
    df = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, rank int")
    want = brute(np.arange(len(x)), x, 20, 20, lambda a, m: m @ a)
    got = {}
    for r in hnsw.nearest(df, shard=300).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))
