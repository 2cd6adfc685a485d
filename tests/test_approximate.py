"""Registered queries that SQL can't express, with their own widths, probes and candidate counts, against brute force."""

import math
import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.functions.stemmer import stem
from tessera.operators.encoders import HashEncoder
from tessera.operators.text import STOPWORDS
from tessera.plans import catalogue
from tessera.plans.catalogue import ORACLE, QUERIES

LEAST = 0.9
SEEDS = (7, 100, 555, 901, 1500)
TESTED = {"ivf_trained_topk", "hierarchical_topk", "two_bit_rerank_topk", "fde_late_topk", "stemmed_bm25"}


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    """A folder with 2,000 clustered unit vectors of 64 dimensions, and the vectors."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20, 64))[rng.integers(0, 20, 2000)] + 0.6 * rng.normal(size=(2000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    path = tmp_path_factory.mktemp("made")
    rows = pa.table({"vec_id": pa.array(range(2000), pa.int64()), "embedding": pa.array(x.tolist(), pa.list_(pa.float32())), "label": pa.array([i % 10 for i in range(2000)], pa.int32())})
    pq.write_table(rows, path / "embeddings.parquet")
    return str(path), x.astype(np.float64)


def recall(found, want):
    return len(set(found) & set(want)) / len(want)


def test_all_are_tested():
    assert set(QUERIES) - set(ORACLE) == TESTED


@pytest.mark.parametrize("name", ["ivf_trained_topk", "hierarchical_topk", "two_bit_rerank_topk"])
def test_nearest(spark, made, monkeypatch, name):
    folder, x = made
    got = []
    for seed in SEEDS:
        monkeypatch.setattr(catalogue, "vector", lambda *_, seed=seed: x[seed].tolist())
        score = 1 - x @ x[seed] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[seed])
        want = sorted(range(len(x)), key=lambda i: (score[i], str(i)))[:10]
        rows = QUERIES[name](spark, folder).collect()
        assert len(rows) == 10 and all(r["score"] == pytest.approx(score[r["id"]], abs=2e-6) for r in rows)
        got.append(recall([r["id"] for r in rows], want))
    assert np.mean(got) >= LEAST, got


def test_hierarchical_takes_few_jobs(spark, made):
    """The jobs of a query don't grow with the nodes of its tree: there are over 20 here."""
    spark.sparkContext.setJobGroup("hierarchical", "")
    rows = QUERIES["hierarchical_topk"](spark, made[0]).collect()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("hierarchical")
    spark.sparkContext.setJobGroup("rest", "")
    assert len(rows) == 10 and len(jobs) <= 12


@pytest.mark.xfail(strict=True, reason="50 candidates by the registered encoding: recall 0.6 here; 0.64 on average over 20 queries of sf0.1")
def test_late(spark, made):
    folder, x = made
    score = [(x[i : i + 5] @ x[:3].T).max(axis=0).sum() for i in range(0, len(x), 5)]
    want = sorted(range(len(score)), key=lambda i: (-score[i], str(i)))[:10]
    rows = QUERIES["fde_late_topk"](spark, folder).collect()
    assert len(rows) == 10 and all(r["score"] == pytest.approx(score[r["id"]], abs=2e-6) for r in rows)
    assert recall([r["id"] for r in rows], want) >= LEAST


def test_stemmed(spark, sf):
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    terms = lambda t: [stem(w) for w in re.findall(r"\w+", t.lower()) if len(w.encode()) <= 40 and w not in STOPWORDS]
    docs = {r["doc_id"]: Counter(terms(r["text"])) for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist() if r["text"]}
    docs = {i: c for i, c in docs.items() if c}
    mean = sum(c.total() for c in docs.values()) / len(docs)
    score = Counter()
    for w in terms("having there from"):
        having = [i for i in docs if docs[i][w]]
        idf = math.log((len(docs) - len(having) + 0.5) / (len(having) + 0.5) + 1)
        for i in having:
            tf = docs[i][w]
            score[i] += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * docs[i].total() / mean))
    want = sorted(score, key=lambda i: (-score[i], str(i)))[:20]
    rows = QUERIES["stemmed_bm25"](spark, sf).collect()
    assert len(rows) == len(want) and all(r["score"] == pytest.approx(score[r["id"]], abs=2e-6) for r in rows)
    assert not want or recall([r["id"] for r in rows], want) >= LEAST


def test_encoders(spark, sf):
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    texts = pq.read_table(f"{sf}/benchmark.parquet", columns=["text"]).column("text").to_pylist()
    ready = [len(HashEncoder().query(t)) for t in texts if t and t.strip()]
    got = {r["status"]: (r["n"], r["vectors"]) for r in QUERIES["encoder_coverage"](spark, sf).collect()}
    assert got["ready"] == (len(ready), sum(ready)) and sum(n for n, _ in got.values()) == len(texts)
