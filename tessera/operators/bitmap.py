"""Value bitmaps and cardinality summaries of attributes by cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_CARDINALITY = 10_000
BITS = 32_768


def value_key(col: Column, kind: T.DataType) -> Column:
    """Typed key of a value: s:, i:, f: or b: and the value."""
    if isinstance(kind, T.BooleanType):
        tag = "b:"
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        tag = "i:"
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        tag = "f:"
    else:
        tag = "s:"
    return F.concat(F.lit(tag), col.cast("string"))


def key_of(value, kind: T.DataType) -> str | None:
    """Key of a filter's value in a field of some type; None where no row can equal it."""
    if isinstance(kind, T.ArrayType):
        return key_of(value, kind.elementType) if isinstance(value, bool) == isinstance(kind.elementType, T.BooleanType) else None
    if isinstance(kind, T.BooleanType):
        return f"b:{str(value).lower()}" if isinstance(value, bool) else None
    if isinstance(value, bool):
        return None
    if isinstance(kind, T.StringType):
        return f"s:{value}" if isinstance(value, str) else None
    return f"i:{int(value)}" if isinstance(value, (int, float)) and value == int(value) else None


def exploded(rows: DataFrame, fields: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep..., field, key): a row for each value of each field, list elements one by one, missing values left out."""
    parts = []
    for f in fields:
        kind = rows.schema[f].dataType
        col = F.col(f"`{f}`")
        if isinstance(kind, T.ArrayType):
            keys = F.array_distinct(F.transform(col, _keyed(kind.elementType)))
        else:
            keys = F.array(value_key(col, kind))
        parts.append(F.transform(F.coalesce(keys, F.array().cast("array<string>")), _with_field(f)))
    each = rows.select(*keep, F.explode(F.flatten(F.array(*parts))).alias("x")).where("x.key is not null")
    return each.select(*keep, "x.field", "x.key")


def _keyed(kind: T.DataType):
    return lambda x: value_key(x, kind)


def _with_field(field: str):
    return lambda k: F.struct(F.lit(field).alias("field"), k.alias("key"))


def cardinality_summary(rows: DataFrame, fields: Sequence[str], cluster: str = "cluster_id") -> DataFrame:
    """(field, key, total_rows, clusters): rows with each value and the clusters that hold it."""
    each = exploded(rows, fields, [cluster])
    by_cluster = each.groupBy("field", "key", cluster).agg(F.count("*").alias("n"))
    return by_cluster.groupBy("field", "key").agg(F.sum("n").alias("total_rows"), F.count("*").alias("clusters"))


def build(rows: DataFrame, fields: Sequence[str], cluster: str = "cluster_id", position: str = "pos", limit: int = MAX_CARDINALITY) -> DataFrame:
    """(cluster, field, key, bucket, bits): a bitmap of row positions for each value; fields with more than ``limit`` values are left out."""
    each = exploded(rows, fields, [cluster, position])
    wide = each.select("field", "key").distinct().groupBy("field").agg(F.count("*").alias("n")).where(F.col("n") <= limit).select("field")
    p = F.col(position)
    return (
        each.join(F.broadcast(wide), "field")
        .groupBy(cluster, "field", "key", F.bitmap_bucket_number(p).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(p)).alias("bits"))
    )


def union_count(bitmaps: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Rows that any of some bitmaps holds, by ``keep``."""
    joined = bitmaps.groupBy(*keep, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return joined.groupBy(*keep).agg(F.sum(F.bitmap_count("bits")).alias("rows"))
