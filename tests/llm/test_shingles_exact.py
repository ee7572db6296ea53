"""No pair of similar texts is lost, whatever else stands in their bands."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from millrace.llm import common, shingles, simhash
from millrace.llm.common import stored
from test_shingles import brute_shingles


def classes(texts, least=0.8):
    sets, up = list(map(brute_shingles, texts)), list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if up[i] != up[j] and len(a & b) >= least * len(a | b) > 0:
                old, new = max(up[i], up[j]), min(up[i], up[j])
                up = [new if x == old else x for x in up]
    return set(up)


def family(seed, n, words, edits):
    """Texts that differ from one base by so many words, so that few pairs are just similar enough."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for at in rng.sample(range(words), edits):
            own[at] = f"x{rng.randrange(10**9)}"
        out.append(" ".join(own))
    return out


def texts_of(seed):
    return family(seed, 120, 300, 5) + family(seed + 50, 60, 120, 2) + [None, "", "one two", "Two words", "one  TWO", "a b c d e", "a b c d e f", "x " * 500, "x " * 700]


@pytest.mark.parametrize("seed, meet", [(1, 2048), (2, 7)])
def test_every_similar_pair_is_linked(spark, monkeypatch, seed, meet):
    monkeypatch.setattr(shingles, "MEET", meet)
    texts = texts_of(seed)
    df = spark.createDataFrame(list(enumerate(texts)) + [(1000 + i, t) for i, t in enumerate(texts[:20])], "doc_id long, text string").repartition(5)
    want = classes(texts) - {texts.index("")}  # null and empty texts are copies of one another
    assert {r.doc_id for r in simhash.one_of_each(df, least=0.8, radius=0).select("doc_id").collect()} == want


def test_the_rest_alone_holds_all_pairs(spark):
    """Without any quick link every similar pair is among the candidates, and the bounds rule most others out."""
    texts = [t for t in texts_of(3) if t and t.split()]
    docs = stored(spark.createDataFrame(list(enumerate(texts)), "_h long, text string").repartition(3), "test")
    sets = [shingles.shingles(t, xxhash.xxh64_intdigest) for t in texts]
    own = stored(spark.createDataFrame([(i, i, len(s), shingles.parities(s)) for i, s in enumerate(sets)], "_h long, root long, size int, parities binary"), "test")
    got = {(r._h, r.rep) for r in shingles.rest(shingles.meetings(docs), own).collect()}
    plain = list(map(brute_shingles, texts))
    pairs = [(i, j, len(plain[i] & plain[j]) / len(plain[i] | plain[j])) for i in range(len(texts)) for j in range(i)]
    assert {(i, j) for i, j, s in pairs if s >= 0.8} <= got and len(got) < 0.8 * len(pairs)
    assert not any(s < 0.5 for i, j, s in pairs if (i, j) in got)


def test_parities_bound_the_difference():
    rng = np.random.default_rng(1)
    for n in (1, 30, 900):
        a = np.unique(rng.integers(0, 2**64, n, np.uint64))
        b = np.unique(np.concatenate((a[: n // 2], rng.integers(0, 2**64, n // 3, np.uint64))))
        bits = np.frombuffer(shingles.parities(a), np.uint8) ^ np.frombuffer(shingles.parities(b), np.uint8)
        assert len(bits) * 8 == shingles.PARITIES and np.bitwise_count(bits).sum() <= len(np.setxor1d(a, b))


def test_wide_parities_bound_the_difference_of_sets_of_any_size():
    rng = np.random.default_rng(2)
    for n, m in ((0, 5), (1, 1), (30, 25), (255, 257), (900, 1100), (5000, 300)):
        a = np.unique(rng.integers(0, 2**64, n, np.uint64))
        b = np.unique(np.concatenate((a[: n // 2], rng.integers(0, 2**64, m - min(m, n // 2), np.uint64))))
        apart = shingles.wide_apart(shingles.wide_parities(a), shingles.wide_parities(b))
        assert apart == shingles.wide_apart(shingles.wide_parities(b), shingles.wide_parities(a)) <= len(np.setxor1d(a, b))
        assert shingles.wide_apart(shingles.wide_parities(a), shingles.wide_parities(a)) == 0


def test_long_texts_that_are_not_similar_are_not_verified(spark):
    """Long texts with a common half: the fixed parities let their pairs pass, the wide ones do not, and no similar pair is ruled out."""
    rng = random.Random(8)
    half = [f"w{rng.randrange(10**6)}" for _ in range(1500)]
    texts = [" ".join(half + [f"x{rng.randrange(10**9)}" for _ in range(1500)]) for _ in range(12)]
    texts += [" ".join(["changed" if rng.random() < 0.02 else w for w in t.split()]) for t in texts[:6]]
    sets = [shingles.shingles(t, xxhash.xxh64_intdigest) for t in texts]
    pairs = [(i, j, shingles.shared(sets[i], sets[j])) for i in range(len(texts)) for j in range(i)]
    wide = stored(spark.createDataFrame([(i, len(s), shingles.wide_parities(s)) for i, s in enumerate(sets)], "_h long, size int, wide binary"), "test")
    got = {(r._h, r.rep) for r in shingles.not_ruled_out(spark.createDataFrame([(i, j) for i, j, _ in pairs], "_h long, rep long"), wide).collect()}
    narrow = [(i, j) for i, j, _ in pairs if wide_of(sets[i], sets[j]) <= (len(sets[i]) + len(sets[j])) // 9]
    assert {(i, j) for i, j, s in pairs if s >= 0.8} == got and len(got) == 6
    assert len(narrow) > 100


def wide_of(a, b):
    return int(np.bitwise_count(np.frombuffer(shingles.parities(a), np.uint8) ^ np.frombuffer(shingles.parities(b), np.uint8)).sum())


def test_shuffle_files_go_when_a_table_is_stored(spark):
    """No shuffle of a stored table stays on disk, and the setting is as before."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {str(at.getAllFiles().apply(i)) for i in range(at.getAllFiles().size())}
    before, rows = {x for x in files() if "shuffle_" in x}, spark.range(50000).selectExpr("id % 777 AS k", "id")
    told = spark.conf.get(common.CLEANUP)
    df = stored(rows.groupBy("k").sum("id"), "test")
    assert not {x for x in files() if "shuffle_" in x} - before and df.count() == 777
    assert spark.conf.get(common.CLEANUP) == told


def test_only_the_links_stay_of_their_steps(spark, tmp_path):
    texts = texts_of(4)[:12]
    texts += [t + " tail" for t in texts]
    docs = stored(spark.createDataFrame(list(enumerate(texts)), "_h long, text string"), "test")
    sets = [shingles.shingles(t, xxhash.xxh64_intdigest) for t in texts]
    keys = [(i, *(x.tolist() if n == 0 else x for n, x in enumerate(shingles.band_keys(s))), len(s), shingles.parities(s), shingles.wide_parities(s)) for i, s in enumerate(sets)]
    keys = stored(spark.createDataFrame(keys, "_h long, keys array<long>, sketch binary, size int, parities binary, wide binary"), "test")
    mark = common._within.set(f"file://{tmp_path}")
    try:
        found = shingles.links(docs, keys)
    finally:
        common._within.reset(mark)
    assert {p.name.split("-")[1] for p in tmp_path.iterdir()} == {"similar"} and found.count() >= 12
