"""Retrieval algebra: fusion, reranking, facets, grouping, cursors, projection.

A source is (id, score); ``lower`` says that lower scores are better.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import ValidationError
from tessera.operators.ann import ordered
from tessera.operators.distance import distance, literal
from tessera.operators.text import bm25
from tessera.spec import TextField

F32_EPSILON = 1.1920928955078125e-07


def default_candidates(top_k: int) -> int:
    return max(4 * top_k, 100)


def with_rank(source: DataFrame, lower: bool) -> DataFrame:
    """A source with ranks from 1. A source is at most candidate_k rows, so one window holds it."""
    score = F.col("score").asc() if lower else F.col("score").desc()
    return source.withColumn("rank", F.row_number().over(Window.orderBy(score, F.col("id").cast("string").asc())))


def contributions_rrf(sources: Sequence[tuple[DataFrame, bool]], k: int = 60) -> DataFrame:
    """(id, source, raw, normalized, contribution): 1 / (k + rank) of each source."""
    if k <= 0:
        raise ValidationError("the rank constant must be positive")
    parts = []
    for i, (source, lower) in enumerate(sources):
        r = with_rank(source, lower)
        parts.append(r.select("id", F.lit(i).alias("source"), F.col("score").alias("raw"), F.lit(None).cast("double").alias("normalized"), (1.0 / (k + F.col("rank"))).alias("contribution")))
    return _union(parts)


def contributions_weighted(sources: Sequence[tuple[DataFrame, bool]], weights: Sequence[float]) -> DataFrame:
    """The same for weighted min-max scores; a source without spread counts fully."""
    if len(weights) != len(sources) or any(w != w or abs(w) == float("inf") for w in weights):
        raise ValidationError("one finite weight for each source")
    parts = []
    for i, ((source, lower), weight) in enumerate(zip(sources, weights, strict=True)):
        span = source.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
        width = F.col("hi") - F.col("lo")
        up = (F.col("hi") - F.col("score")) if lower else (F.col("score") - F.col("lo"))
        normalized = F.when(width < F32_EPSILON, F.lit(1.0)).otherwise(up / width)
        r = source.crossJoin(F.broadcast(span)).withColumn("normalized", normalized)
        parts.append(r.select("id", F.lit(i).alias("source"), F.col("score").alias("raw"), "normalized", (F.lit(float(weight)) * F.col("normalized")).alias("contribution")))
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fused(contributions: DataFrame, k: int | None = None) -> DataFrame:
    """(id, score): sums of contributions, best first."""
    total = contributions.groupBy("id").agg(F.sum("contribution").alias("score"))
    return total if k is None else ordered(total, k, descending=True)


def explained(contributions: DataFrame, results: DataFrame) -> DataFrame:
    """Contribution rows of the results, with the fused score."""
    return contributions.join(F.broadcast(results.select("id", F.col("score").alias("fused_score"))), "id")


def rerank_vector(rows: DataFrame, candidates: DataFrame, vector: Sequence[float], metric: str, k: int) -> DataFrame:
    """Candidates by their exact distance to a vector."""
    held = rows.join(F.broadcast(candidates.select("id")), "id", "left_semi")
    return ordered(held.select("id", distance(metric, F.col("values"), literal(vector)).alias("score")), k)


def rerank_bm25(rows: DataFrame, candidates: DataFrame, field: str, query: str, k: int, config: TextField = TextField(stemming=False)) -> DataFrame:  # noqa: B008
    """Candidates by BM25 with the statistics of the candidates alone; those without a match keep score 0."""
    held = rows.join(F.broadcast(candidates.select("id")), "id", "left_semi")
    found = bm25(held, "id", field, query, config)
    return ordered(candidates.select("id").join(found, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score")), k, descending=True)


def facets(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, value, count) over the rows; each list element counts, missing values don't. All fields in one pass."""
    parts = []
    for f in dict.fromkeys(fields):
        kind = rows.schema[f].dataType
        col = F.col(f"`{f}`")
        values = F.transform(col, lambda x: x.cast("string")) if isinstance(kind, T.ArrayType) else F.array(col.cast("string"))
        parts.append(F.transform(F.coalesce(values, F.array().cast("array<string>")), _tag(f)))
    each = rows.select(F.explode(F.flatten(F.array(*parts))).alias("x")).where("x.value is not null")
    return each.groupBy("x.field", "x.value").agg(F.count("*").alias("count"))


def _tag(field: str):
    return lambda v: F.struct(F.lit(field).alias("field"), v.alias("value"))


def group_key(field: str, kind: T.DataType) -> Column:
    """Key of a row's group; a missing value is a group of its own row and meets no real value."""
    col = F.col(f"`{field}`")
    value = F.array_join(F.transform(col, lambda x: x.cast("string")), ",") if isinstance(kind, T.ArrayType) else col.cast("string")
    return F.when(col.isNull(), F.concat(F.lit("missing:"), F.col("id").cast("string"))).otherwise(F.concat(F.lit("field:"), value))


def grouped(rows: DataFrame, field: str, top_groups: int, max_per_group: int, lower: bool) -> DataFrame:
    """(group_rank, group_key, id, score, rank_in_group) of the first groups in order of their best rows. ``rows`` are at most candidate_k."""
    score = F.col("score").asc() if lower else F.col("score").desc()
    r = with_rank(rows, lower).withColumn("group_key", group_key(field, rows.schema[field].dataType))
    in_group = Window.partitionBy("group_key").orderBy(score, F.col("id").cast("string").asc())
    r = r.withColumn("rank_in_group", F.row_number().over(in_group)).withColumn("__first", F.min("rank").over(Window.partitionBy("group_key")))
    r = r.withColumn("group_rank", F.dense_rank().over(Window.orderBy("__first")))
    return r.where((F.col("group_rank") <= top_groups) & (F.col("rank_in_group") <= max_per_group)).select("group_rank", "group_key", "id", "score", "rank_in_group")


def after(frontier: DataFrame, score: float, key: str, lower: bool, k: int) -> DataFrame:
    """Page of rows strictly after (score, id)."""
    s, i = F.col("score"), F.col("id").cast("string")
    beyond = (s > score) if lower else (s < score)
    return ordered(frontier.where(beyond | ((s == score) & (i > key))), k, descending=not lower)


class Cursors:
    """Page tokens, signed and bound to the query and the policy version."""

    FREE = ("cursor", "debug", "explain", "facets", "include_attributes", "projection")

    def __init__(self, secret: bytes):
        self.secret = secret

    def fingerprint(self, request: dict) -> str:
        bound = {k: v for k, v in request.items() if k not in self.FREE}
        return hashlib.sha256(json.dumps(bound, sort_keys=True).encode()).hexdigest()

    def issue(self, request: dict, score: float, key: str, policy: int = 0) -> str:
        body = json.dumps({"s": score, "i": key, "p": policy, "q": self.fingerprint(request)}, sort_keys=True).encode()
        return base64.urlsafe_b64encode(hmac.digest(self.secret, body, "sha256") + body).decode()

    def read(self, token: str, request: dict, policy: int = 0) -> tuple[float, str]:
        try:
            raw = base64.urlsafe_b64decode(token.encode())
        except ValueError as e:
            raise ValidationError("bad cursor") from e
        mark, body = raw[:32], raw[32:]
        if not hmac.compare_digest(mark, hmac.digest(self.secret, body, "sha256")):
            raise ValidationError("cursor is not ours")
        got = json.loads(body)
        if got["q"] != self.fingerprint(request):
            raise ValidationError("cursor belongs to another query")
        if got["p"] != policy:
            raise ValidationError("the policy has changed since the cursor was issued")
        return got["s"], got["i"]


def projected(rows: DataFrame, attributes: Sequence[str], include: bool | Sequence[str] = True, denied: Sequence[str] = ()) -> DataFrame:
    """Id, score and the wanted attributes that the caller may see."""
    wanted = list(attributes) if include is True else [] if include is False else [a for a in include if a in attributes]
    return rows.select("id", "score", *[F.col(f"`{a}`") for a in wanted if a not in set(denied)])
