"""The index of a segment, written at compaction, and searches over it.

A segment folder holds Parquet tables only:

* ``rows``: rows by ``cluster_id`` as partitions, each with its 8-bit codes beside
  the vector, so that a coarse pass reads codes of the probed clusters alone;
* ``centroids`` and ``bounds``: what a query needs on the driver (one row a
  cluster, one row a dimension);
* ``bitmaps``: bitmaps of row positions for attribute values, by cluster;
* ``postings`` (field, term, id, tf, dl), sorted by term, so that the few row
  groups of a query's terms are read; ``terms`` with document counts; ``lengths``
  with one row of statistics a field.

Centroids are trained on a sample of bounded size and kept by later compactions
while the namespace grows moderately; every row is assigned to one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import ann, bitmap, quant
from tessera.operators import text as fulltext
from tessera.operators.distance import distance, literal
from tessera.spec import NamespaceSpec, TextField, cluster_count, default_nprobe

#: Rows that train one centroid.
TRAINING = 64
#: A compaction trains anew when the log holds more than this many times the rows of the segment.
RETRAIN = 5.0
#: Candidates of the coarse pass for each row wanted.
WIDER = 4
#: Of words that go to the stemmer at once.
BATCH_BYTES = "8m"


def centroids_of(rows: DataFrame, n: int, spec: NamespaceSpec, old: np.ndarray | None, added: float) -> np.ndarray | None:
    """The old centroids while the namespace grew moderately, else new ones from a sample."""
    if old is not None and added <= RETRAIN:
        return old
    clusters = cluster_count(n, spec.index.nlist)
    if clusters < 2:
        return None
    share = min(1.0, 1.2 * TRAINING * clusters / n)
    sample = rows.select("id", "values") if share == 1.0 else rows.select("id", "values").sample(False, share, 7)
    return ann.train_centroids(sample, clusters, iterations=10)


def write(rows: DataFrame, spec: NamespaceSpec, path: str, old: np.ndarray | None = None, added: float = 0.0) -> dict:
    """Write the index of some rows (id, values, attributes) under a path; what the manifest says about it."""
    spark = rows.sparkSession
    n = rows.count()
    centers = centroids_of(rows, n, spec, old, added) if n else None
    placed = ann.assign(rows, centers) if centers is not None else rows.withColumn("cluster_id", F.lit(0).cast("long"))
    about = {"rows": n, "clusters": 0 if centers is None else len(centers), "retrained": centers is not None and centers is not old, "codes": False, "text": [], "bitmaps": []}
    if n and spec.index.quantization != "none":
        limits = quant.calibrate(rows)
        limits.write.parquet(f"{path}/bounds")
        lo, hi = quant.bounds(spark.read.parquet(f"{path}/bounds"))
        placed = placed.withColumn("codes", quant.encode_sq8(F.col("values"), lo, hi).cast("array<smallint>"))
        about["codes"] = True
    # one shuffle: rows of a cluster are numbered for the bitmaps and written by the task that holds them
    numbered = placed.withColumn("pos", (F.row_number().over(Window.partitionBy("cluster_id").orderBy("id")) - 1).cast("long"))
    numbered.write.partitionBy("cluster_id").parquet(f"{path}/rows")
    if centers is not None:
        table = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)], "cluster_id long, centroid array<double>")
        table.coalesce(1).write.parquet(f"{path}/centroids")
    fields = [f.name for f in rows.schema.fields if f.name not in ("id", "values") and _indexable(f.dataType)]
    if spec.index.bitmap_index and n and fields:
        maps = bitmap.build(read_rows(spark, path, rows.schema, ("pos",)), fields)
        maps.write.partitionBy("cluster_id").parquet(f"{path}/bitmaps")
        about["bitmaps"] = sorted(r["field"] for r in spark.read.parquet(f"{path}/bitmaps").select("field").distinct().collect())
    if spec.index.fts_index and n and spec.text_fields:
        write_text(rows, "id", spec.text_fields, path)
        about["text"] = sorted(spec.text_fields)
    return about


def _indexable(kind: T.DataType) -> bool:
    """Values whose keys equality means: real numbers are compared with a tolerance and have none."""
    if isinstance(kind, T.ArrayType):
        return _indexable(kind.elementType)
    return isinstance(kind, (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType))


_OWN = {"codes": T.StructField("codes", T.ArrayType(T.ShortType())), "pos": T.StructField("pos", T.LongType())}


def read_rows(spark: SparkSession, path: str, schema: T.StructType, more: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a segment with their cluster_id, the partition column."""
    return spark.read.schema(T.StructType([*schema.fields, *[_OWN[c] for c in more], T.StructField("cluster_id", T.LongType())])).parquet(f"{path}/rows")


def read_centroids(spark: SparkSession, path: str) -> np.ndarray:
    """Centroids in order; there are 4,096 at most."""
    return np.array([r["centroid"] for r in spark.read.parquet(f"{path}/centroids").orderBy("cluster_id").collect()])


def probe(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    about: dict,
    vector: Sequence[float],
    metric: str,
    k: int,
    nprobe: int | None = None,
    node: dict | None = None,
    where: Column | None = None,
    without: DataFrame | None = None,
) -> DataFrame:
    """(id, score) of the k best rows of the probed clusters that ``where``, the predicate of the filter ``node``, passes.

    With codes a coarse pass reads codes alone, and the exact vectors are read
    for its candidates. ``without`` are ids that newer rows hide; they go before
    the cut, so k rows come back if there are so many. Where bitmaps can answer
    the filter, clusters without a passing row are left out, and the probe widens
    until the clusters hold k passing rows.
    """
    order = ann.probed(read_centroids(spark, path), vector, metric, about["clusters"]) if about["clusters"] else [0]
    wanted = order[: min(nprobe or default_nprobe(len(order)), len(order))]
    passing = counted(spark, path, node, about, schema) if node else None
    if passing is not None:
        held = {r["cluster_id"]: r["rows"] for r in passing.collect()}  # a row for each cluster at most
        wanted, total = [], 0
        for no, c in enumerate(order):
            if no >= (nprobe or default_nprobe(len(order))) and total >= k:
                break
            if held.get(c):
                wanted.append(c)
                total += held[c]
    rows = read_rows(spark, path, schema, ("codes",) if about["codes"] else ()).where(F.col("cluster_id").isin(wanted) if wanted else F.lit(False))
    rows = rows if where is None else rows.where(where)
    rows = rows if without is None else rows.join(without.select("id"), "id", "left_anti")
    if not about["codes"]:
        return ann.exact(rows, vector, metric, k)
    lo, hi = quant.bounds(spark.read.parquet(f"{path}/bounds"))
    found = ann.ordered(rows.select("id", distance(metric, quant.decode_sq8(F.col("codes"), lo, hi), literal(vector)).alias("score")), WIDER * k).select("id")
    full = read_rows(spark, path, schema).where(F.col("cluster_id").isin(wanted) if wanted else F.lit(False))
    return ann.exact(full.join(F.broadcast(found), "id", "left_semi"), vector, metric, k)  # 4 k ids at most


def counted(spark: SparkSession, path: str, node: dict, about: dict, schema: T.StructType) -> DataFrame | None:
    """(cluster_id, rows) that a filter passes, from bitmaps alone; None where they can't answer it."""
    passing = evaluated(spark, path, node, about, schema)
    return None if passing is None else passing.groupBy("cluster_id").agg(F.sum(F.bitmap_count("bits")).cast("long").alias("rows"))


def evaluated(spark: SparkSession, path: str, node: dict, about: dict, schema: T.StructType) -> DataFrame | None:
    """(cluster_id, bucket, bits) of the rows that a tree of eq, in, and, or passes."""
    if not answerable(node, set(about["bitmaps"])):
        return None
    maps = spark.read.parquet(f"{path}/bitmaps")

    def of(node: dict) -> DataFrame:
        op = node["op"]
        if op in ("eq", "in"):
            kind = schema[node["field"]].dataType
            keys = [k for v in ([node["value"]] if op == "eq" else node["values"]) if (k := bitmap.key_of(v, kind)) is not None]
            held = maps.where((F.col("field") == node["field"]) & (F.col("key").isin(keys) if keys else F.lit(False)))
            return held.groupBy("cluster_id", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        parts = [of(c).withColumn("part", F.lit(i)) for i, c in enumerate(node["filters"])]
        both = reduce(DataFrame.unionByName, parts)
        if op == "or":
            return both.groupBy("cluster_id", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        met = both.groupBy("cluster_id", "bucket").agg(F.count("*").alias("k"), F.bitmap_and_agg("bits").alias("bits"))
        return met.where(F.col("k") == len(parts)).select("cluster_id", "bucket", "bits")

    return of(node)


def answerable(node: dict, indexed: set[str]) -> bool:
    """True if bitmaps alone answer a filter: they hold the rows with a value, so not the rows without one."""
    if node["op"] in ("eq", "in"):
        values = [node["value"]] if node["op"] == "eq" else node["values"]
        return node["field"] in indexed and not any(isinstance(v, (list, tuple)) for v in values)
    return node["op"] in ("and", "or") and bool(node["filters"]) and all(answerable(c, indexed) for c in node["filters"])


# full text


@contextmanager
def _batches(spark: SparkSession, size: str) -> Iterator[None]:
    """Meanwhile Arrow batches hold about so many bytes: 10,000 long texts a batch would fill an executor."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(name, None)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


def write_text(rows: DataFrame, key: str, fields: dict[str, TextField], path: str) -> None:
    """Postings, terms and lengths of text fields. Postings of a field are dealt out by ranges of (term, id), so a frequent term takes several files."""
    spark = rows.sparkSession
    parts = []
    for field, config in fields.items():
        dealt = fulltext.postings(rows, key, field, config).repartitionByRange("term", "id")
        if config.stemming:  # after the only shuffle: of a range all rows are in one task
            dealt = dealt.groupBy("term", "id").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))
        parts.append(dealt.sortWithinPartitions("term", "id").select(F.lit(field).alias("field"), "term", "id", "tf", "dl"))
    with _batches(spark, BATCH_BYTES):
        reduce(DataFrame.unionByName, parts).write.option("parquet.block.size", 4 << 20).parquet(f"{path}/postings")
    stored = spark.read.parquet(f"{path}/postings")
    terms = stored.groupBy("field", "term").agg(F.count("*").alias("df"))
    terms.repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.parquet(f"{path}/terms")
    each = stored.groupBy("field", "id").agg(F.first("dl").alias("dl"))
    each.groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).coalesce(1).write.parquet(f"{path}/lengths")


def bm25(spark: SparkSession, path: str, field: str, query: str, config: TextField, last_as_prefix: bool = False) -> DataFrame:
    """(id, score) of the rows that match, from stored postings. No text is read."""
    wanted = fulltext.query_tokens(query, config, last_as_prefix)
    held = spark.read.parquet(f"{path}/postings").where(F.col("field") == field)
    if not wanted:
        return held.where(F.lit(False)).select("id", F.lit(0.0).alias("score"))
    prefix = wanted[-1] if last_as_prefix else None
    exact = wanted[:-1] if last_as_prefix else wanted

    def asked(term: Column) -> Column:
        test = term.isin(*dict.fromkeys(exact)) if exact else F.lit(False)
        return test | term.startswith(prefix) if prefix else test

    rarity = spark.read.parquet(f"{path}/terms").where((F.col("field") == field) & asked(F.col("term"))).select("term", "df")
    one = spark.read.parquet(f"{path}/lengths").where(F.col("field") == field).first()
    if one is None:
        return held.where(F.lit(False)).select("id", F.lit(0.0).alias("score"))
    # as many rows as the query has words; those of a prefix are as many as the index has, and Spark decides
    rarity = rarity if prefix else F.broadcast(rarity)
    times = F.lit(0)
    for w in dict.fromkeys(exact):
        times = F.when(F.col("term") == w, times + exact.count(w)).otherwise(times)
    if prefix:
        times = times + F.when(F.col("term").startswith(prefix), 1).otherwise(0)
    hits = held.where(asked(F.col("term"))).select("term", "id", "tf", "dl").join(rarity, "term")
    score = times * fulltext.term_score(fulltext.idf(F.lit(one["n"]), F.col("df")), F.col("tf"), F.col("dl"), F.lit(one["avgdl"]), config)
    return hits.groupBy("id").agg(F.sum(score).alias("score"))


def ranked(spark: SparkSession, path: str, rank_by: list, fields: dict[str, TextField], last_as_prefix: bool = False) -> DataFrame:
    """(id, score) by a rank expression over stored postings; only positive scores."""
    return fulltext.ranked_by(rank_by, fields, lambda field, query: bm25(spark, path, field, query, fields[field], last_as_prefix))
