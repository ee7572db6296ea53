from __future__ import annotations

import random

import xxhash

from millrace.llm import shingles, simhash
from test_simhash import brute_components, brute_fingerprint


def brute_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_similar_sets_are_linked_exactly():
    rng = random.Random(3)
    base = [rng.choice("abcdefgh") for _ in range(60)]
    texts = [" ".join(base[:n] + [str(n)] * k) for n in (20, 30, 45, 60) for k in (0, 1, 2, 9)]
    sets = [shingles.shingles(t, xxhash.xxh64_intdigest) for t in texts]
    want = [(i, j) for i, a in enumerate(map(brute_shingles, texts)) for j, b in enumerate(map(brute_shingles, texts)) if i < j and len(a & b) >= 0.8 * len(a | b)]
    up = list(range(len(texts)))
    for links in (want, shingles.similar(sets)):
        roots = list(up)
        for _ in texts:
            for a, b in links:
                roots[a] = roots[b] = min(roots[a], roots[b])
        assert links and (links is want or roots == before)
        before = roots


def test_near_copies_beyond_four_bits_go(spark):
    rng = random.Random(4)
    rows, far = [], 0
    for i in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        copy = list(words)
        for at in (rng.randrange(0, 90), rng.randrange(100, 190)):
            copy[at] = "changed"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
        far += (brute_fingerprint(rows[-1][1]) ^ brute_fingerprint(rows[-2][1])).bit_count() > 4
    rows += [(100, None), (101, ""), (102, "one two"), (103, "other words here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(r.doc_id for r in simhash.one_of_each(df, least=0.8).collect())
    assert far > 10 and kept == [*range(0, 60, 2), 100, 102, 103]
    assert len({brute_components([brute_fingerprint(t) for _, t in rows], 4)[i] for i in range(60)}) > 30  # the fingerprints alone keep copies
    assert simhash.one_of_each(df.limit(0), least=0.8).count() == 0


def test_a_dense_family_costs_a_candidate_a_band_and_loses_no_class(spark):
    """Variants that are alike but rarely similar, with true copies among them: their bands are full of texts that must not be linked."""
    from millrace.llm.common import stored

    rng = random.Random(9)
    base = [f"w{rng.randrange(900)}" for _ in range(260)]
    texts = []
    for _ in range(250):
        words = list(base)
        for at in rng.sample(range(260), 9):
            words[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    for i in range(0, 250, 5):
        words = texts[i].split()
        words[rng.randrange(260)] = "again"
        texts.append(" ".join(words))
    sets = list(map(brute_shingles, texts))
    up = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                old, new = max(up[i], up[j]), min(up[i], up[j])
                up = [new if x == old else x for x in up]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in simhash.one_of_each(df, least=0.8, radius=0).select("doc_id").collect()}
    assert kept == set(up) and 150 < len(kept) <= 250
    own = [(i, *shingles.band_keys(shingles.shingles(t, xxhash.xxh64_intdigest))) for i, t in enumerate(texts)]
    own = spark.createDataFrame([(i, k.tolist(), s) for i, k, s in own], "_h long, keys array<long>, sketch binary")
    assert shingles.candidates(stored(own, "test")).count() <= len(texts) * shingles.BANDS
