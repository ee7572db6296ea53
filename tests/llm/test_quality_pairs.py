"""The classifier learns from every lesson and every pair of them."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from millrace.llm import quality


def brute_model(f, y, ridge=1e-3):
    """Newton steps over all pairs, written out."""
    mean, scale = f.mean(0), np.maximum(f.std(0), 1e-6)
    x = np.clip((f - mean) / scale, -8, 8)
    diff = (x[y == 1][:, None] - x[y == 0][None]).reshape(-1, f.shape[1])
    w = np.zeros(f.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(diff @ w))
        w = w - np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + ridge * np.eye(len(w)), ridge * w - (diff * p[:, None]).mean(0))
    s = x @ w
    return w, np.quantile(s, (y == 0).mean()), 6 / max(np.median(s[y == 1]) - np.median(s[y == 0]), 1e-3)


def rows_of(seed, n, apart):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.7).astype(np.int8)
    f = rng.random((n, len(quality.FEATURES)))
    f[:, 0] += apart * y
    f[:, 5] = np.round(f[:, 5] - 0.02 * y)
    f[: n // 5] = f[0]  # repeated scores
    return f, y


@pytest.mark.parametrize("seed, apart, cut", [(1, 0.3, 400), (2, 5.0, 70), (3, 0.0, 33)])
def test_all_pairs_and_exact_quantiles(seed, apart, cut):
    f, y = rows_of(seed, 400, apart)
    blocks = [(f[i : i + cut], y[i : i + cut]) for i in range(0, len(y), cut)]
    got = quality.learn(lambda step: [step(*b) for b in blocks])
    w, threshold, slope = brute_model(f, y)
    assert np.allclose(got.weights, w, atol=1e-7) and np.isclose(got.threshold, threshold, atol=1e-6) and np.isclose(got.slope, slope, rtol=1e-5)


def test_every_label_is_a_lesson(spark):
    marks = spark.range(60_000).selectExpr("id AS doc_id", "CAST(id % 3 > 0 AS INT) AS quality")
    want = sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(60_000))
    assert quality.lessons(marks).count() == want > 30_000


def test_blocks_in_spark_give_the_model_of_one_block(spark, monkeypatch):
    rows = [(i, ("some words. go on here " * (1 + i % 7) + f"w{i}") if i % 4 else "LOUD!! " * (3 + i % 5) + f"w{i} and more") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 4 != 0 or i % 16 == 0)) for i in range(300)], "doc_id long, quality int")
    whole = {r.doc_id: r.score for r in quality.classify(df, marks).collect()}
    monkeypatch.setattr(quality, "BLOCK_ROWS", 40)
    monkeypatch.setattr("millrace.llm.common.BROADCAST_BYTES", 0)
    parted = {r.doc_id: r.score for r in quality.classify(df, marks).collect()}
    assert max(abs(whole[i] - parted[i]) for i in whole) < 1e-6 and len(set(whole.values())) > 2
    assert {r.doc_id for r in quality.keep_good(df, marks).collect()} == {i for i, s in parted.items() if s >= 0.5}
