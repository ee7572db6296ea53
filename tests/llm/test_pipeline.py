"""The stages against brute-force versions on a small corpus, and the registered queries."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from millrace.llm import quality, queries, secrets, topk
from millrace.llm.common import stored, tables
from test_simhash import brute_components, brute_fingerprint

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


def test_stages(spark):
    docs = tables(spark, SF_DIR, "documents")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(stored(stage(spark, steps[-1], SF_DIR), "test"))
    for df in steps[:-1]:
        assert df.columns == docs.columns
    ids = [sorted(r.doc_id for r in df.select("doc_id").distinct().collect()) for df in steps]
    good = quality.classify(docs, tables(spark, SF_DIR, "labels")).where("predicted = 1")
    assert ids[1] == sorted(r.doc_id for r in good.collect())
    rows = sorted(steps[1].collect(), key=lambda r: r.doc_id)
    roots = brute_components([brute_fingerprint(r.text) for r in rows], 4)
    assert ids[2] == sorted(rows[i].doc_id for i in set(roots))
    assert ids[3] == ids[2]
    left = secrets.secret_report(steps[3])
    assert left.where("n_assign + n_access + n_hex > 0").count() == 0
    assert all(r.n_chars == len(r.text) for r in steps[3].collect())
    assert set(ids[4]) < set(ids[3]) and ids[5] == ids[4]


def test_queries_are_registered():
    names = entry.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF_DIR)
    found = con.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(str, found.fetchall()))
    assert topk.ORACLE
