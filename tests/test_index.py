"""The stored index against brute force, and the plans that read it."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.stemmer import stem
from tessera.operators import text
from tessera.plans.catalogue import ORACLE, QUERIES
from tessera.plans.request import answer
from tessera.sources import index
from tessera.sources.store import Namespace
from tessera.spec import IndexConfig, NamespaceSpec, TextField

N, SPEC = 3000, NamespaceSpec("ix", 16, "cosine", {"body": TextField(stemming=False)}, IndexConfig(nlist=24, quantization="scalar"))
KINDS = T.StructType([T.StructField("kind", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("body", T.StringType())])


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(24, 16))[rng.integers(0, 24, N)] + 0.5 * rng.normal(size=(N, 16))
    rows = [(f"v{i}", x[i].tolist(), f"k{i % 7}" if i % 11 else None, int(i % 50), f"word{i % 13} common tail{i % 3}") for i in range(N)]
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("values", T.ArrayType(T.FloatType())), *KINDS.fields])
    namespace = Namespace.create(spark, str(tmp_path_factory.mktemp("ix")), SPEC, KINDS)
    namespace.load(spark.createDataFrame(rows, schema))
    return namespace, x.astype(np.float32).astype(np.float64), rows


def order(x, q, keep):
    score = 1 - x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q)
    return sorted((i for i in range(len(x)) if keep(i)), key=lambda i: (score[i], f"v{i}"))


def test_recall_with_few_probes(made):
    namespace, x, _ = made
    hits = 0
    for seed in (3, 500, 1500, 2500, 2999):
        got = {r["id"] for r in namespace.nearest(x[seed].tolist(), 10, nprobe=5).collect()}
        hits += len(got & {f"v{i}" for i in order(x, x[seed], lambda i: True)[:10]})
    assert hits >= 45


def test_filters_widen_the_probe_until_enough_rows_pass(made):
    namespace, x, rows = made
    node = {"op": "and", "filters": [{"op": "eq", "field": "kind", "value": "k3"}, {"op": "in", "field": "n", "values": [4, 5.0, "4"]}]}
    keep = lambda i: rows[i][2] == "k3" and rows[i][3] in (4, 5)
    want = order(x, x[9], keep)
    got = [r["id"] for r in namespace.nearest(x[9].tolist(), len(want), nprobe=1, node=node).collect()]
    assert sorted(got) == sorted(f"v{i}" for i in want)


def test_bitmaps_count_what_filters_pass(made, spark):
    namespace, _, rows = made
    m = namespace.manifest()
    about, path = m["segment"]["index"], namespace.folder(m)
    assert about["bitmaps"] == ["body", "kind", "n"] and about["codes"] and about["clusters"] == 24
    for node, keep in (
        ({"op": "eq", "field": "kind", "value": "k1"}, lambda r: r[2] == "k1"),
        ({"op": "or", "filters": [{"op": "eq", "field": "kind", "value": "k1"}, {"op": "in", "field": "n", "values": [1, 2]}]}, lambda r: r[2] == "k1" or r[3] in (1, 2)),
        ({"op": "and", "filters": [{"op": "eq", "field": "kind", "value": "k1"}, {"op": "eq", "field": "n", "value": 1.5}]}, lambda r: False),
    ):
        counted = index.counted(spark, path, node, about, namespace.row_schema)
        assert (counted.agg(F.sum("rows")).first()[0] or 0) == sum(map(keep, rows))
    assert index.counted(spark, path, {"op": "not", "filter": {"op": "eq", "field": "n", "value": 1}}, about, namespace.row_schema) is None


def plan_of(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_plans_prune(made, spark):
    namespace, x, _ = made
    plan = plan_of(namespace.nearest(x[0].tolist(), 5, nprobe=2))
    assert "PartitionFilters: [isnotnull(cluster_id" in plan or "PartitionFilters: [cluster_id" in plan
    coarse = next(line for line in plan.split("\n") if "ReadSchema" in line and "codes" in line)
    assert "values" not in coarse
    plan = plan_of(index.bm25(spark, namespace.folder(namespace.manifest()), "body", "word3 common", SPEC.text_fields["body"]))
    assert "In(term, [common,word3])" in plan and "regexp" not in plan and "Python" not in plan


def test_stored_postings_score_like_texts(made, spark):
    namespace, _, _ = made
    rows, path, config = namespace.snapshot(), namespace.folder(namespace.manifest()), SPEC.text_fields["body"]
    for query, prefix in (("word3 common word3", False), ("common word1", True), ("absent", False), ("the", False)):
        got = {r["id"]: r["score"] for r in index.bm25(spark, path, "body", query, config, prefix).collect()}
        want = {r["id"]: r["score"] for r in text.bm25(rows, "id", "body", query, config, prefix).collect()}
        assert got == pytest.approx(want)
    rank = ["Sum", [["body", "BM25", "word3"], ["Product", 2.0, ["body", "BM25", "tail1"]]]]
    top = answer({"rank_by": rank, "top_k": 5}, namespace).results.collect()
    want = sorted(((r["id"], r["score"]) for r in text.ranked(rows, "id", rank, SPEC.text_fields).collect()), key=lambda p: (-p[1], p[0]))[:5]
    assert [(r["id"], pytest.approx(r["score"])) for r in top] == want


def test_centroids_stay_until_the_namespace_has_grown(spark, tmp_path):
    namespace = Namespace.create(spark, str(tmp_path), NamespaceSpec("grow", 2, "euclidean", index=IndexConfig(nlist=4)), T.StructType([]))
    add = lambda lo, hi: namespace.upsert(spark.createDataFrame([(f"r{i}", [float(i % 17), float(i % 5)]) for i in range(lo, hi)], "id string, values array<float>"))
    add(0, 40)
    assert namespace.compact()["segment"]["index"]["retrained"]
    add(40, 60)
    about = namespace.compact()["segment"]["index"]
    assert not about["retrained"] and about["rows"] == 60
    add(60, 500)
    assert namespace.compact()["segment"]["index"]["retrained"]
    assert namespace.nearest([3.0, 3.0], 500, nprobe=4).count() == 500


def test_an_empty_namespace(spark, tmp_path):
    namespace = Namespace.create(spark, str(tmp_path), NamespaceSpec("none", 2), T.StructType([]))
    assert namespace.nearest([1.0, 0.0], 3).count() == 0
    namespace.upsert(spark.createDataFrame([("a", [1.0, 0.0])], "id string, values array<float>"))
    namespace.delete_ids(["a"])
    namespace.compact()
    assert namespace.nearest([1.0, 0.0], 3).count() == 0 and namespace.snapshot().count() == 0


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    """A folder of embeddings, most of whose ids lie beyond 20,000."""
    x = np.random.default_rng(4).normal(size=(300, 64))
    ids = [*range(40), *range(20_000, 20_260)]
    path = tmp_path_factory.mktemp("far")
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(x.astype(np.float32).tolist(), pa.list_(pa.float32())), "label": pa.array([i % 10 for i in ids], pa.int32())}), path / "embeddings.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["index_log_overlay_filtered", "index_log_overlay_topk"])
def test_the_log_changes_rows_of_any_id(spark, far, name):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{far}/embeddings.parquet'")
    assert [(r["id"], r["score"]) for r in QUERIES[name](spark, far).collect()] == con.execute(ORACLE[name]).fetchall()


def test_upserts_of_any_number_go_in_batches(spark, tmp_path):
    namespace = Namespace.create(spark, str(tmp_path), NamespaceSpec("many", 2), T.StructType([]))
    namespace.upsert_all(spark.createDataFrame([(f"r{i}", [1.0, float(i)]) for i in range(500)], "id string, values array<float>"), most=100)
    m = namespace.manifest()
    sizes = [r["count"] for r in namespace.log(m).groupBy("seq").count().collect()]
    assert len(m["batches"]) > 4 and sum(sizes) == 500 and max(sizes) <= 100
    assert namespace.snapshot().count() == 500


def test_words_reach_the_stemmer_once_and_postings_are_shuffled_once(spark, tmp_path):
    words = ["running", "runs", "flies", "the", "nation"]
    docs = spark.createDataFrame([(i, " ".join(words[: i % 6] * 40) if i % 7 else None) for i in range(300)] + [(5, "running again")], "id long, body string")
    plan = plan_of(text.postings(docs, "id", "body", TextField()))
    assert "EvalPython" not in plan and "Exchange" not in plan and "MapInArrow" in plan
    want = {}
    for i, body in ((r["id"], r["body"]) for r in docs.collect()):
        kept = [stem(w) for w in (body or "").split() if w != "the"]
        for w in set(kept):
            tf, lengths = want.get((w, i), (0, set()))
            want[w, i] = tf + kept.count(w), lengths | {len(kept)}
    index.write_text(docs, "id", {"body": TextField()}, str(tmp_path))
    got = spark.read.parquet(f"{tmp_path}/postings").collect()
    assert len(got) == len(want) and all(want[r["term"], r["id"]][0] == r["tf"] and r["dl"] in want[r["term"], r["id"]][1] for r in got)
    stemmed = {r["id"]: r["t"] for r in docs.where("id <> 5").select("id", text.tokens(F.col("body"), TextField()).alias("t")).collect()}
    assert stemmed[7] is None and stemmed[6] == [] and stemmed[8] == ["run", "run"] * 40
