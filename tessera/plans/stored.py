"""What the registered queries search: indexes made once of the tables at hand and kept in the warehouse.

A folder's name comes from the sizes and times of its tables' files, so other
data never meets an old index. It is written beside its place and renamed, so
that a reader sees all of it or nothing.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources import index, upserts
from tessera.sources.store import Files, Namespace
from tessera.spec import IndexConfig, NamespaceSpec, TextField


def once(spark: SparkSession, sf: str, tables: tuple[str, ...], what: str, make: Callable[[str], None]) -> str:
    """Folder of something made of some tables; made if it isn't there."""
    data = Files(spark, sf)
    seen = [f"{t}:{data.size(f'{t}.parquet')}:{data.modified(f'{t}.parquet')}" for t in tables]
    name = hashlib.sha256("|".join([data.root, what, *seen]).encode()).hexdigest()[:24]
    place = Files(spark, f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tessera")
    if place.read(f"{name}/ready") is None:
        draft = f"{name}-{uuid.uuid4().hex}"
        make(f"{place.root}/{draft}")
        place.create(f"{draft}/ready", what)
        if not place.rename(draft, name):
            place.remove(draft)
    return f"{place.root}/{name}"


def text_index(spark: SparkSession, sf: str, fields: dict[str, TextField]) -> str:
    """Folder of the postings of some fields of ``documents``."""

    def make(path: str) -> None:
        index.write_text(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", fields, path)

    return once(spark, sf, ("documents",), f"text {sorted(fields.items())}", make)


def _filled(spark: SparkSession, root: str, spec: NamespaceSpec, rows: DataFrame) -> Namespace:
    attributes = T.StructType([f for f in rows.schema.fields if f.name not in ("id", "values")])
    namespace = Namespace.create(spark, root, spec, attributes)
    namespace.load(rows.withColumn("id", F.col("id").cast("string")))
    return namespace


def vectors(spark: SparkSession, sf: str, changed: bool = False) -> Namespace:
    """The embeddings as a loaded namespace of 16 clusters; ``changed``: then with every tenth row deleted, and others turned round and relabelled, in the log."""
    spec = NamespaceSpec("vectors", 64, "cosine", index=IndexConfig(nlist=16, quantization="scalar"))

    def make(path: str) -> None:
        rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("values"), "label")
        namespace = _filled(spark, path, spec, rows)
        if changed:
            turned = rows.where("id % 10 = 1").select(F.col("id").cast("string").alias("id"), F.transform("values", lambda x: -x).alias("values"), F.lit(99).alias("label"))
            namespace.upsert_all(turned)
            namespace.guarded(lambda held: held.where("cast(id as long) % 10 = 0"))

    return Namespace.open(spark, once(spark, sf, ("embeddings",), f"vectors {'all changed' if changed else changed}", make), "vectors")


def hybrid(spark: SparkSession, sf: str, spec: NamespaceSpec, rows: Callable[[], DataFrame]) -> Namespace:
    """Vectors with texts and labels as a loaded namespace."""

    def make(path: str) -> None:
        _filled(spark, path, spec, rows())

    return Namespace.open(spark, once(spark, sf, ("embeddings", "documents", "labels"), f"hybrid {spec}", make), spec.name)


def suppliers(spark: SparkSession, sf: str) -> str:
    """Folder of a namespace that lived: loaded, named snapshot, deletes by filter and by id, both forms of upserts, a fork, a clone and a compacted fork."""
    spec = NamespaceSpec("suppliers", 2, "euclidean", index=IndexConfig(nlist=4, quantization="none"))

    def make(path: str) -> None:
        rows = spark.read.parquet(f"{sf}/supplier.parquet")
        values = F.array(F.col("s_acctbal").cast("float"), F.col("s_nationkey").cast("float"))
        main = _filled(spark, path, spec, rows.select(F.col("s_suppkey").alias("id"), values.alias("values"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")))
        main.put_snapshot("loaded")
        main.delete_where({"op": "range", "field": "balance", "lt": 0})
        main.delete_ids(["1", "2", "3"])
        deleted = main.manifest()["version"]
        main.upsert(upserts.from_json(spark, {"vectors": [{"id": "2", "values": [1, 2], "attributes": {"nation": 77}}, {"id": "new", "values": [3, 4]}]}, main.attributes))
        packed = np.array([[5, 6], [7, 8]], "<f4").tobytes()
        main.upsert(upserts.from_columns(spark, ["new", "4"], 2, packed, {"balance": [1.5, 2.5]}))
        child = main.fork("child", "snapshot:loaded")
        child.delete_where({"op": "eq", "field": "nation", "value": 7})
        main.clone("copy", deleted)
        main.fork("packed").compact()

    return once(spark, sf, ("supplier",), "suppliers", make)
