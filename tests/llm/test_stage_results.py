"""What single stages of the pipeline decide, against plain versions of their rules."""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from millrace.llm import mixing, packing
from millrace.llm.common import tables
from test_shingles import brute_shingles
from test_simhash import brute_fingerprint

SF_DIR = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@needs_data
def test_near_duplicate_stage_by_both_rules(spark):
    docs = tables(spark, SF_DIR, "documents")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    prints, sets = [brute_fingerprint(r.text) for r in rows], [brute_shingles(r.text) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4 or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if x == old else x for x in root]
    want = sorted(rows[i].doc_id for i in set(root))
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF_DIR).collect()) == want and len(want) < len(rows)


@needs_data
def test_mixing_stage_by_plain_raking(spark):
    docs = tables(spark, SF_DIR, "documents")
    rows = docs.collect()

    def cell(r):
        text, n = r.text or "", len(re.findall(r"[^ \t\n\x0b\f\r]+", r.text or ""))
        form = "listing" if text.count("|") * 50 > len(text) else "brief" if n < 100 else "article" if n < 1000 else "treatise"
        return (r.source or "", r.lang or "", form), max(n, 1)

    tokens = Counter()
    for r in rows:
        c, n = cell(r)
        tokens[c] += n
    total = sum(tokens.values())
    weight = dict(tokens)
    targets = []
    for axis, name in enumerate(mixing.AXES):
        sums = defaultdict(float)
        for c, n in tokens.items():
            sums[c[axis]] += n
        powers = {v: s ** mixing.POWERS[name] for v, s in sums.items()}
        targets.append({v: p / sum(powers.values()) * total * mixing.KEPT_SHARE for v, p in powers.items()})
    for _ in range(mixing.ROUNDS):
        for axis, target in enumerate(targets):
            now = defaultdict(float)
            for c, w in weight.items():
                now[c[axis]] += w
            weight = {c: min(tokens[c], w * target[c[axis]] / now[c[axis]]) for c, w in weight.items()}
    low, high = 0.0, 1e6  # the factor at which capped weights sum to the share
    for _ in range(200):
        factor = (low + high) / 2
        if sum(min(tokens[c], factor * w) for c, w in weight.items()) < mixing.KEPT_SHARE * total:
            low = factor
        else:
            high = factor
    kept = [r.doc_id for r in rows if int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:8], 16) / 2**32 < min(1.0, factor * weight[cell(r)[0]] / tokens[cell(r)[0]])]
    assert sorted(r.doc_id for r in corpus_pipeline.mixing_stage(spark, docs, SF_DIR).collect()) == sorted(kept) and 0 < len(kept) < len(rows)


@pytest.mark.parametrize("seed", range(4))
def test_packing_takes_the_least_sum_of_squares(seed):
    rng = np.random.default_rng(seed)
    capacity, lengths = 40, rng.integers(1, 41, 300)
    bins, offsets = packing.pack(lengths, capacity)
    room: dict[int, int] = {}
    for i in np.argsort(-lengths, kind="stable").tolist():
        s, b = int(lengths[i]), int(bins[i])
        if s == capacity:
            continue
        counts = Counter(room.values())

        def squares(gap):
            after = counts.copy()
            after[gap] -= 1
            after[gap - s] += 1
            return sum(n * n for g, n in after.items() if g)

        fitting = {g for g, n in counts.items() if g >= s and n}
        if fitting:
            assert b in room and squares(room[b]) == min(map(squares, fitting))
        else:
            assert b not in room
        gap = room.get(b, capacity)
        assert offsets[i] == capacity - gap
        room[b] = gap - s


def test_pipeline_on_an_empty_table_and_clashing_columns(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"words of document number {i} that is long enough to stay " * 8, "en", "s", 1, "own") for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long, _n string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    for name, rows in (("empty", docs.limit(0)), ("clash", docs)):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").count()
        assert (got == 0) == (name == "empty")
