from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from millrace.llm import graph, simhash


def brute_fingerprint(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius):
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


def test_fingerprint_matches_brute_force():
    rng = random.Random(1)
    lanes = simhash._lanes()
    texts = [None, "", " \t", "One", "a b c", "a b c d", "A b\x0bC d", "é ü x y z"] + [" ".join(rng.choice("aa bb cc dd ee ff".split()) for _ in range(n)) for n in (5, 40, 254, 255, 256, 300, 1200)]
    for t in texts:
        assert simhash.fingerprint(t, 4, xxhash.xxh64_intdigest, lanes) == brute_fingerprint(t)


def test_spark_hash_is_the_same_function(spark):
    words = ["", "abc", "x" * 100, "é ü"]
    got = spark.createDataFrame([(w,) for w in words], "w string").selectExpr("xxhash64(w) AS h").collect()
    assert [r.h & (2**64 - 1) for r in got] == [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]


@pytest.mark.parametrize("radius", [0, 3, 4])
def test_links_find_every_pair(spark, radius):
    rng = random.Random(radius)
    fps = {rng.getrandbits(64) for _ in range(60)} | {0}
    for f in list(fps)[:40]:  # neighbours at every distance, and chains of them
        for d in (1, 2, 3, 4, 5, 6):
            g = f
            for b in rng.sample(range(64), d):
                g ^= 1 << b
            fps.add(g)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), radius)
    roots = {r.node: r.root for r in graph.components(edges).collect()}
    got = [roots.get(s, s) for s in signed]
    want = brute_components(fps, radius)
    assert len({(a, b) for a, b in zip(got, want)}) == len(set(got)) == len(set(want))


def test_long_chains_settle(spark):
    edges = spark.range(1, 200).selectExpr("id AS u", "id - 1 AS v")
    assert {(r.node, r.root) for r in graph.components(edges).collect()} == {(i, 0) for i in range(200)}


def test_near_duplicates_edge_cases(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(5, text, "x"), (3, text.upper(), "y"), (3, text, "z"), (9, "quite another text of more words than four", "x"), (None, text, "n"), (7, None, "e"), (8, "", "e"), (6, " \n", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (9, 9), (None, 3), (7, 6), (8, 6), (6, 6)], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 6, 9]


def test_one_of_each_keeps_one_of_equal_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f g")] * 3 + [(2, "a b c d e f g"), (None, "other words that stand here alone")], "doc_id long, text string")
    assert sorted(map(str, simhash.one_of_each(df).collect())) == sorted(map(str, [df.first(), df.where("doc_id IS NULL").first()]))


def test_large_bucket_is_not_expanded_into_pairs():
    rng = np.random.default_rng(1)
    members = np.unique(np.uint64(1 << 40) ^ (np.uint64(1) << rng.integers(0, 20, 3000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 20, 3000).astype(np.uint64)))
    assert len(simhash._links(members, 4)) == len(members) - 1
