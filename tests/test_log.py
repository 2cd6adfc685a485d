"""Replay against a model, and namespaces from creation to collection."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import Conflict, Denied, NotFound, PointInTimeNotRetained, ValidationError
from tessera.operators.governance import Lock
from tessera.sources import log as replay
from tessera.sources.store import Files, Namespace, list_namespaces
from tessera.spec import NamespaceSpec
from tessera.streaming.ingest import ingest


def model(batches, deletes_first=True):
    rows = {}
    for _, upserts, deletes in batches:
        steps = [("d", deletes), ("u", upserts)] if deletes_first else [("u", upserts), ("d", deletes)]
        for kind, items in steps:
            for x in items:
                rows[x[0] if kind == "u" else x] = x[1] if kind == "u" else None
    return rows


def test_replay_matches_model(spark):
    rng = random.Random(3)
    batches = [(s, [(f"k{rng.randint(0, 8)}", rng.random()) for _ in range(rng.randint(0, 3))], [f"k{rng.randint(0, 8)}" for _ in range(rng.randint(0, 2))]) for s in range(25)]
    flat = [(k, s, "upsert", i, v) for s, ups, _ in batches for i, (k, v) in enumerate(ups)] + [(k, s, "delete", i, None) for s, _, dels in batches for i, k in enumerate(dels)]
    log = spark.createDataFrame(flat, "id string, seq long, op string, ord long, value double").coalesce(2)
    for first in (True, False):
        want = {k: v for k, v in model(batches, first).items() if v is not None}
        assert {r["id"]: r["value"] for r in replay.live(log, first).collect()} == want
    touched = {b[0] for b in batches if b[2]}
    want = {k for k, v in model([b for b in batches if b[0] in touched]).items() if v is None}
    assert {r["id"] for r in replay.eventual_tombstones(log).collect()} == want


def test_overriding_row_that_fails_the_filter_still_hides_the_old_one(spark):
    segment = spark.createDataFrame([("a", 1)], "id string, value int")
    log = spark.createDataFrame([("a", 1, "upsert", 9)], "id string, seq long, op string, value int")
    assert replay.strong(segment, log).where("value < 5").count() == 0
    assert replay.eventual(segment, log).where("value < 5").count() == 1


ATTRIBUTES = T.StructType([T.StructField("color", T.StringType())])


def rows(spark, *items):
    return spark.createDataFrame([(i, v, c) for i, v, c in items], "id string, values array<float>, color string").coalesce(1)


def test_namespace_life(spark, tmp_path):
    root = str(tmp_path)
    spec = NamespaceSpec("life", 2, "euclidean")
    ns = Namespace.create(spark, root, spec, ATTRIBUTES)
    Namespace.create(spark, root, spec, ATTRIBUTES)
    with pytest.raises(Conflict):
        Namespace.create(spark, root, NamespaceSpec("life", 3), ATTRIBUTES)
    ns.upsert(rows(spark, ("a", [1.0, 0.0], "red"), ("b", [0.0, 1.0], "blue")))
    first = ns.put_snapshot("first")
    ns.upsert(rows(spark, ("a", [2.0, 0.0], "green")))
    ns.delete_where({"op": "eq", "field": "color", "value": "blue"})
    ids = lambda df: sorted((r["id"], r["color"]) for r in df.collect())
    assert ids(ns.snapshot()) == [("a", "green")]
    assert ids(ns.snapshot("snapshot:first")) == [("a", "red"), ("b", "blue")] == ids(ns.snapshot(first))
    fork, copy = ns.fork("child", first), ns.clone("copy", first)
    fork.upsert(rows(spark, ("c", [0.0, 0.0], "black")))
    assert ids(fork.snapshot()) == [("a", "red"), ("b", "blue"), ("c", "black")]
    assert ids(copy.snapshot()) == [("a", "red"), ("b", "blue")]
    assert ids(ns.snapshot(consistency="eventual")) == []
    ns.compact()
    assert ns.status()["ready"] and ids(ns.snapshot()) == [("a", "green")] == ids(ns.snapshot(consistency="eventual"))
    assert ids(ns.snapshot("snapshot:first")) == [("a", "red"), ("b", "blue")]
    with pytest.raises(PointInTimeNotRetained):
        ns.snapshot("2000-01-01T00:00:00Z")
    with pytest.raises(Denied):
        ns.delete_ids(["a"], (Lock("namespace", "life"),))
    for bad in ([("a", [1.0], "x")], [("a", [float("nan"), 0.0], "x")], [("bad id", [0.0, 0.0], "x")]):
        with pytest.raises(ValidationError):
            ns.upsert(rows(spark, *bad))
    ns.collect((fork,), keep=1)
    assert ids(ns.snapshot()) == [("a", "green")] and len(ids(fork.snapshot())) == 3
    assert list_namespaces(spark, root) == ["child", "copy", "life"]
    copy.delete()
    with pytest.raises(NotFound):
        Namespace.open(spark, root, "copy")


def test_nothing_in_use_is_collected(spark, tmp_path):
    ns = Namespace.create(spark, str(tmp_path), NamespaceSpec("kept", 2, "euclidean"), ATTRIBUTES)
    ids = lambda x: sorted(r["id"] for r in x.snapshot().collect())
    ns.upsert(rows(spark, ("a", [1.0, 0.0], "red")))
    grandchild = ns.fork("one").fork("two")
    ns.upsert(rows(spark, ("b", [1.0, 0.0], "red")))
    ns.compact()
    unpublished = f"{tmp_path}/kept/log/staged"
    rows(spark, ("c", [1.0, 0.0], "red")).write.parquet(unpublished)
    ns.collect(keep=1)
    assert spark.read.parquet(unpublished).count() == 1
    with pytest.raises(Conflict):
        ns.delete()
    gone = ns.collect(keep=1, grace=0)
    assert "log/staged" in gone and ids(ns) == ["a", "b"] and ids(grandchild) == ["a"]
    grandchild.delete()
    assert Namespace.open(spark, str(tmp_path), "one").snapshot().count() == 1


def test_guarded_write_selects_again_after_a_lost_race(spark, tmp_path):
    ns = Namespace.create(spark, str(tmp_path), NamespaceSpec("g", 2, "euclidean"), ATTRIBUTES)
    ns.upsert(rows(spark, ("a", [1.0, 0.0], "red"), ("b", [1.0, 0.0], "blue")))
    seen = []

    def select(snapshot):
        if not seen:
            ns.upsert(rows(spark, ("c", [0.0, 1.0], "red")))
        seen.append(1)
        return snapshot.where("color = 'red'")

    ns.guarded(select)
    assert len(seen) == 2 and [r["id"] for r in ns.snapshot().collect()] == ["b"]


def test_probe_of_a_store(spark, tmp_path):
    assert all(Files(spark, str(tmp_path)).probe().values())


def test_streams_do_not_share_their_numbers(spark, tmp_path):
    ns = Namespace.create(spark, str(tmp_path / "store"), NamespaceSpec("s", 2), ATTRIBUTES)
    schema = "id string, values array<float>, color string, op string"
    for i, key in enumerate("ab"):
        spark.createDataFrame([(key, [1.0, 0.0], "red", "upsert")], schema).write.parquet(str(tmp_path / f"in{i}"))
        ingest(spark.readStream.schema(schema).parquet(str(tmp_path / f"in{i}")), ns, str(tmp_path / f"check{i}")).awaitTermination()
    assert sorted(r["id"] for r in ns.snapshot().collect()) == ["a", "b"] and len(ns.manifest()["streams"]) == 2
    spark.createDataFrame([("bad", [1.0], "red", "upsert")], schema).write.parquet(str(tmp_path / "in2"))
    with pytest.raises(Exception, match="refused batch"):
        ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "in2")), ns, str(tmp_path / "check2")).awaitTermination()


def test_streaming_ingest_commits_each_batch_once(spark, tmp_path):
    ns = Namespace.create(spark, str(tmp_path / "store"), NamespaceSpec("s", 2), ATTRIBUTES)
    source = str(tmp_path / "in")
    for i, data in enumerate([[("a", [1.0, 0.0], "red", "upsert")], [("a", None, None, "delete"), ("b", [1.0, 1.0], "blue", "upsert")]]):
        spark.createDataFrame(data, "id string, values array<float>, color string, op string").coalesce(1).write.parquet(f"{source}/{i}")
        stream = spark.readStream.schema("id string, values array<float>, color string, op string").option("recursiveFileLookup", "true").parquet(source)
        ingest(stream, ns, str(tmp_path / "check")).awaitTermination()
    assert [r["id"] for r in ns.snapshot().collect()] == ["b"]
    version = ns.manifest()["version"]
    ingest(stream, ns, str(tmp_path / "check")).awaitTermination()
    assert ns.manifest()["version"] == version


def test_fetch(spark):
    snapshot = spark.createDataFrame([("a", 1), ("b", 2)], "id string, value int")
    found, missing = replay.fetch(snapshot, ["b", "x", "a"])
    assert [r["id"] for r in found.collect()] == ["b", "a"] and [r["id"] for r in missing.collect()] == ["x"]
    assert snapshot.where(F.col("id") == "a").count() == 1
