"""Upsert forms and encoders."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import types as T

from tessera.errors import DimensionMismatch, ValidationError
from tessera.operators import encoders, late
from tessera.sources import upserts


def test_forms(spark):
    attributes = T.StructType([T.StructField("color", T.StringType())])
    a = upserts.from_json(spark, {"vectors": [{"id": "x", "values": [1, 2.5], "attributes": {"color": "red"}}, {"id": "y", "values": [0, 0]}]}, attributes)
    packed = np.array([[1, 2.5], [0, 0]], "<f4").tobytes()
    b = upserts.from_columns(spark, ["x", "y"], 2, packed, {"color": ["red", None]})
    assert [tuple(r) for r in a.collect()] == [tuple(r) for r in b.collect()] == [("x", [1.0, 2.5], "red"), ("y", [0.0, 0.0], None)]
    with pytest.raises(DimensionMismatch):
        upserts.from_columns(spark, ["x"], 2, packed)
    with pytest.raises(ValidationError):
        upserts.from_json(spark, {"vectors": []}, attributes)
    ids = [r["id"] for r in upserts.with_server_ids(a).collect()]
    assert len(set(ids)) == 2 and all(i.startswith("row_") for i in ids)


def test_units_and_encoders(spark):
    rows = spark.createDataFrame([("1", "text", "red fox", None), ("2", "text", "blue whale", None), ("3", "text", " ", None)], "id string, type string, text string, image binary")
    units = upserts.units(rows).cache()
    assert units.first()["content_hash"] == hashlib.sha256(b'{"type":"text","text":"red fox"}').hexdigest()
    with pytest.raises(ValidationError):
        upserts.units(spark.createDataFrame([("1", "image", "x", None)], rows.schema))
    encoder = encoders.HashEncoder(16)
    done = encoders.enrich(units, encoder).cache()
    assert {r["id"]: r["status"] for r in done.collect()} == {"1": "ready", "2": "ready", "3": "failed"}
    assert encoders.pending(units, done, "dev").count() == 0 and encoders.pending(units, done, "next").count() == 3
    found = late.maxsim_matrices(done.where("status = 'ready'").select("id", "matrix"), encoder.query("whale"), 1).collect()
    assert [(r["id"], round(r["score"], 6)) for r in found] == [("2", 1.0)]
