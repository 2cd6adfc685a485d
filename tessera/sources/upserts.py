"""Upsert forms: JSON rows, columnar batches with packed vectors, retrieval units."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import DimensionMismatch, ValidationError

MAX_BATCH = 50_000
UNIT_TYPES = ("text", "image", "image_text")


def from_json(spark: SparkSession, body: dict, attributes: T.StructType) -> DataFrame:
    """Rows of ``{"vectors": [{"id", "values", "attributes"}]}``."""
    items = body.get("vectors")
    if not items or len(items) > MAX_BATCH:
        raise ValidationError("a batch has 1 to 50000 rows")
    names = attributes.names
    rows = []
    for item in items:
        if set(item) - {"id", "values", "attributes"}:
            raise ValidationError(f"unknown keys: {sorted(item)}")
        held = item.get("attributes") or {}
        rows.append((item["id"], [float(x) for x in item["values"]], *[held.get(n) for n in names]))
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("values", T.ArrayType(T.FloatType())), *attributes.fields])
    return spark.createDataFrame(rows, schema)


def from_columns(spark: SparkSession, ids: Sequence[str], dimensions: int, values_f32_le: bytes, attributes: dict[str, Sequence] | None = None) -> DataFrame:
    """Rows of a columnar batch; the vectors are little-endian 32-bit floats one after another. Goes in as one Arrow table."""
    flat = np.frombuffer(values_f32_le, "<f4")
    if len(flat) != len(ids) * dimensions:
        raise DimensionMismatch(f"{len(ids)} rows of {dimensions} need {len(ids) * dimensions} numbers, got {len(flat)}")
    offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * dimensions)
    columns = {"id": pa.array(list(ids), pa.string()), "values": pa.ListArray.from_arrays(offsets, pa.array(flat))}
    columns |= {k: pa.array(list(v)) for k, v in (attributes or {}).items()}
    return spark.createDataFrame(pa.table(columns))


def content_hash(*fields: str) -> Column:
    """SHA-256 of the canonical JSON of an input's fields."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def with_server_ids(rows: DataFrame) -> DataFrame:
    """Rows with ids of the engine's own making, for writers whose scope is imposed on them."""
    return rows.withColumn("id", F.concat(F.lit("row_"), F.replace(F.uuid(), F.lit("-"), F.lit(""))))


def units(rows: DataFrame) -> DataFrame:
    """Retrieval units (id, type, text, image, parent_id, unit_ordinal) with their content hashes; malformed ones are refused."""
    well = (
        F.when(F.col("type") == "text", F.col("text").isNotNull())
        .when(F.col("type") == "image", F.col("image").isNotNull())
        .when(F.col("type") == "image_text", F.col("text").isNotNull() & F.col("image").isNotNull())
        .otherwise(False)
    )
    if not rows.where(~F.coalesce(well, F.lit(False))).isEmpty():
        raise ValidationError("a unit lacks its input")
    return rows.withColumn("content_hash", content_hash("type", "text", "image"))
