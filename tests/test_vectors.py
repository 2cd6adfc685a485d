"""Vectors, codes, clusters, late interaction, governance and sizing."""

import numpy as np
import pytest

from tessera.errors import Denied, ValidationError
from tessera.functions.stemmer import stem
from tessera.operators import ann, codecs, late, quant
from tessera.operators.governance import Grant, decide, stamped, violations
from tessera.plans import sizing
from tessera.spec import IndexConfig, NamespaceSpec, TextField, cluster_count, default_nprobe


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(12, 32))
    x = (centers[rng.integers(0, 12, 600)] + 0.3 * rng.normal(size=(600, 32))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, values array<float>").repartition(3).cache()
    return x.astype(np.float64), df


def nearest(x, q, metric, k):
    d = ann._block_distances(metric, q[None], x)[0]
    return sorted(range(len(x)), key=lambda i: (d[i], str(i)))[:k]


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot_product"])
def test_exact_and_batch(data, metric):
    x, df = data
    assert [r["id"] for r in ann.exact(df, x[5], metric, 10).collect()] == nearest(x, x[5], metric, 10)
    got = ann.batch_knn(df, df.where("id < 40"), metric, 5, block=16).collect()
    for q in range(40):
        mine = [r["id"] for r in sorted((r for r in got if r["query_id"] == str(q)), key=lambda r: r["rank"])]
        assert mine == nearest(x, x[q], metric, 5)


def recall(found, want):
    return len(set(found) & set(want)) / len(want)


def test_approximate_paths(data):
    x, df = data
    q = x[7]
    want = nearest(x, q, "euclidean", 10)
    centers = ann.train_centroids(df, 12)
    assigned = ann.assign(df, centers).cache()
    assert recall([r["id"] for r in ann.ivf_search(assigned, centers, q, "euclidean", 10, 6).collect()], want) >= 0.9
    assert [r["id"] for r in ann.ivf_search(assigned, centers, q, "euclidean", 10, 12).collect()] == want
    lo, hi = quant.bounds(quant.calibrate(df))
    coarse = quant.sq8_topk(df, q, "euclidean", 40, lo, hi)
    assert [r["id"] for r in quant.reranked(df, coarse, q, "euclidean", 10).collect()] == want
    for metric in ("euclidean", "cosine", "dot_product"):
        found = [r["id"] for r in quant.two_bit_topk(df, q, metric, 60).collect()]
        assert recall(found, nearest(x, q, metric, 10)) >= 0.9
    books = quant.train_pq(df, 8, 32)
    found = [r["id"] for r in quant.pq_topk(quant.encode_pq(df, books), books, q, "euclidean", 60).collect()]
    assert recall(found, want) >= 0.9
    tree, held = ann.Tree.build(df, 3, 60)
    assert [r["id"] for r in tree.search(held, q, "euclidean", 10, 1000).collect()] == want
    assert len(ann.balanced(df, centers)) >= len(centers)


@pytest.mark.parametrize("numbers, most", [(1 << 21, 12), (8000, 120)])
def test_a_tree_takes_few_passes(spark, data, monkeypatch, numbers, most):
    """Jobs grow with the levels above the subtrees of single tasks, and not with the nodes."""
    x, df = data
    monkeypatch.setattr(ann, "SUBTREE", numbers)
    spark.sparkContext.setJobGroup(f"tree {numbers}", "build")
    tree, held = ann.Tree.build(df, 3, 20)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"tree {numbers}")
    spark.sparkContext.setJobGroup("rest", "")
    sizes = {r["leaf_id"]: r["count"] for r in held.groupBy("leaf_id").count().collect()}
    assert len(jobs) <= most and sum(sizes.values()) == len(x) and max(sizes.values()) <= 20
    assert not any(tree.children[leaf] for leaf in sizes)
    assert [r["id"] for r in tree.search(held, x[7], "euclidean", 10, len(tree.centers)).collect()] == nearest(x, x[7], "euclidean", 10)
    assert recall([r["id"] for r in tree.search(held, x[7], "euclidean", 10, 12).collect()], nearest(x, x[7], "euclidean", 10)) >= 0.9


@pytest.mark.parametrize("numbers", [1 << 21, 40])
def test_a_tree_keeps_equal_rows_in_one_leaf(spark, monkeypatch, numbers):
    monkeypatch.setattr(ann, "SUBTREE", numbers)
    df = spark.createDataFrame([(i, [1.0, 2.0] if i < 50 else [3.0, float(i)]) for i in range(60)], "id long, values array<float>").repartition(2)
    tree, held = ann.Tree.build(df, 2, 4)
    sizes = sorted(r["count"] for r in held.groupBy("leaf_id").count().collect())
    assert sizes[-1] == 50 and sum(sizes) == 60 and sizes[-2] <= 4
    for rows in (df.where("id < 50"), df.where("id < 0")):
        tree, held = ann.Tree.build(rows, 2, 4)
        assert tree.children == [[]] and held.where("leaf_id = 0").count() == rows.count()


def test_late_interaction(spark, data):
    x, _ = data
    mats = [x[i * 4 : i * 4 + 4] for i in range(100)]
    df = spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(mats)], "id long, matrix array<array<double>>").repartition(2)
    q = x[:3]
    want = sorted(range(100), key=lambda i: (-(mats[i] @ q.T).max(axis=0).sum(), str(i)))[:5]
    assert [r["id"] for r in late.maxsim_matrices(df, q, 5).collect()] == want
    flat = df.selectExpr("id", "explode(matrix) as vec")
    assert [r["id"] for r in late.maxsim(flat, q, 5).collect()] == want
    encoder = late.FixedEncoder(32, planes=3, repetitions=8)
    got = [r["id"] for r in late.late_search(df, late.encode_documents(df, encoder), encoder, q, 5, 40).collect()]
    assert recall(got, want) >= 0.8
    with pytest.raises(ValidationError):
        encoder.document([[0.0] * 32])
    assert late.pooled([[1.0], [3.0], [5.0]]).tolist() == [[2.0], [5.0]]


def test_governance(spark):
    grants = [Grant(frozenset(["query"]), filter={"op": "eq", "field": "a", "value": 1}, mask=frozenset(["x"])), Grant(frozenset(["query", "write"]), "n*", mask=frozenset(["y"]), stamp={"t": "z"}, forbid_set=frozenset(["p"]))]
    d = decide(grants, "query", "ns")
    assert d.mask == {"x", "y"} and d.filter == grants[0].filter
    with pytest.raises(Denied):
        decide(grants, "write", "other")
    df = spark.createDataFrame([("1", "new"), ("2", None)], "id string, p string")
    w = decide(grants, "write", "ns")
    assert [r["id"] for r in violations(df, w).collect()] == ["1"]
    old = spark.createDataFrame([("1", "old")], "id string, p string")
    assert {(r["id"], r["p"], r["t"]) for r in stamped(df, w, old).collect()} == {("1", "old", "z"), ("2", None, "z")}


def test_rules():
    assert cluster_count(10_000) == 256 and cluster_count(100) == 100 and cluster_count(10**9) == 4096
    assert default_nprobe(256) == 48 and default_nprobe(10) == 10
    assert [sizing.row_bytes(q, 768) for q in ("none", "scalar", "two_bit", "one_bit", "product")] == [3072, 768, 200, 104, 8]
    assert [sizing.row_bytes("two_bit", d) for d in (100, 1536)] == [72, 392]
    for bad in (lambda: TextField(k1=0), lambda: NamespaceSpec("-x", 2), lambda: IndexConfig(quantization="product", pq_m=3).check(4), lambda: IndexConfig(hierarchical=True).check(4)):
        with pytest.raises(ValidationError):
            bad()
    spec = NamespaceSpec("a", 4, "cosine", {"t": TextField(b=0.5)})
    assert NamespaceSpec.from_dict(spec.to_dict()) == spec


def test_stemmer():
    pairs = {"running": "run", "happiness": "happi", "flies": "fli", "agreed": "agre", "hoping": "hope", "hopping": "hop", "relational": "relat", "generously": "generous", "skies": "sky", "national": "nation"}
    assert {w: stem(w) for w in pairs} == pairs


def test_matrix_codecs(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(7, 64))
    assert np.array_equal(codecs.unpack(codecs.pack(x)), x.astype(np.float16).astype(np.float64))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    back = codecs.unpack(codecs.pack(x, 32))
    assert np.abs(np.linalg.norm(back, axis=1) - 1).max() < 1e-3 and (back * unit).sum(1).min() > 0.999
    assert not codecs.unpack(codecs.pack(np.zeros((2, 16)), 16)).any()
    assert codecs.unpack(codecs.pack([])).shape == (0, 0)
    for bad in (lambda: codecs.pack([[np.inf]]), lambda: codecs.pack([[1e6]]), lambda: codecs.pack(x, 48), lambda: codecs.unpack(b"TMXH"), lambda: codecs.unpack(codecs.pack(x)[:-1])):
        with pytest.raises(ValidationError):
            bad()
    df = spark.createDataFrame([(1, [[1.0, 2.0]]), (2, None), (3, [])], "id long, matrix array<array<double>>")
    got = df.select("id", codecs.packed(df["matrix"]).alias("b"))
    assert [r[0] for r in got.select(codecs.unpacked(got["b"]).alias("m"), "id").orderBy("id").select("m").collect()] == [[[1.0, 2.0]], None, []]


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot_product"])
def test_one_bit_codes(data, metric):
    x, df = data
    want = nearest(x, x[5], metric, 10)
    for four_bits in (False, True):
        found = [r["id"] for r in quant.two_bit_topk(df, x[5], metric, 120, encode=quant.one_bit, four_bits=four_bits).collect()]
        assert recall(found, want) >= 0.9


def test_four_bit_query_has_no_bias():
    q = np.random.default_rng(3).normal(size=256)
    step = (q.max() - q.min()) / 15
    forms = np.stack([quant.four_bit_query(q, seed) for seed in range(400)])
    assert np.abs(forms - q).max() <= step + 1e-9
    assert np.abs(forms.mean(axis=0) - q).max() < 0.2 * step
    assert np.array_equal(quant.four_bit_query(np.ones(4)), np.ones(4))
