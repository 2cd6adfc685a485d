"""Late interaction: MaxSim over multi-vectors, fixed-dimension encodings, and coverage."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import ValidationError
from tessera.operators.ann import ordered


def maxsim(rows: DataFrame, query: Sequence[Sequence[float]], k: int) -> DataFrame:
    """(id, score): sum over the query's vectors of the best dot product with a row's vectors. Rows are (id, vec), one per vector."""
    from tessera.operators.distance import dot, literal

    best = [F.max(dot(F.col("vec"), literal(q))).alias(f"m{i}") for i, q in enumerate(query)]
    total = F.lit(0.0)
    for i in range(len(query)):
        total = total + F.col(f"m{i}")
    return ordered(rows.groupBy("id").agg(*best).select("id", total.alias("score")), k, descending=True)


def matrix_scores(rows: DataFrame, query: Sequence[Sequence[float]]) -> DataFrame:
    """(id, score) of all rows (id, matrix: array of vectors), as one matrix product a row."""
    q = np.asarray(query, np.float64)

    @F.arrow_udf(T.DoubleType())
    def score(matrix: pa.Array) -> pa.Array:
        return pa.array([float((np.array(m, np.float64) @ q.T).max(axis=0).sum()) if m else float("-inf") for m in matrix.to_pylist()])

    return rows.select("id", score("matrix").alias("score"))


def maxsim_matrices(rows: DataFrame, query: Sequence[Sequence[float]], k: int) -> DataFrame:
    """The best k of them."""
    return ordered(matrix_scores(rows, query), k, descending=True)


class FixedEncoder:
    """Fixed-dimension encodings of multi-vectors.

    Every repetition draws hyperplanes whose signs choose a bucket; a query's
    vectors are summed by bucket, a document's averaged, and an empty document
    bucket takes the first vector of the populated bucket at the least Hamming
    distance (of equal ones the least bucket). ``projection`` shrinks vectors
    by random signs before that.
    """

    def __init__(self, dimensions: int, planes: int = 3, repetitions: int = 4, projection: int | None = None, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.planes = [rng.standard_normal((planes, dimensions)) for _ in range(repetitions)]
        inner = projection or dimensions
        self.inner = [np.eye(dimensions) if projection is None else rng.choice([-1.0, 1.0], (dimensions, inner)) / np.sqrt(inner) for _ in range(repetitions)]
        self.buckets, self.width = 1 << planes, inner

    def _bucket(self, planes: np.ndarray, x: np.ndarray) -> np.ndarray:
        return ((x @ planes.T > 0) * (1 << np.arange(len(planes)))).sum(axis=1)

    def query(self, vectors) -> np.ndarray:
        x = np.asarray(vectors, np.float64)
        out = np.zeros((len(self.planes), self.buckets, self.width))
        for r, (planes, inner) in enumerate(zip(self.planes, self.inner, strict=True)):
            np.add.at(out[r], self._bucket(planes, x), x @ inner)
        return out.ravel()

    def document(self, vectors) -> np.ndarray:
        x = np.asarray(vectors, np.float64)
        if not len(x) or (np.abs(x).sum(axis=1) == 0).any():
            raise ValidationError("a document needs vectors other than zero")
        out = np.zeros((len(self.planes), self.buckets, self.width))
        for r, (planes, inner) in enumerate(zip(self.planes, self.inner, strict=True)):
            bucket, y = self._bucket(planes, x), x @ inner
            full = np.unique(bucket)
            for b in range(self.buckets):
                if b in full:
                    out[r, b] = y[bucket == b].mean(axis=0)
                else:
                    near = min(full, key=lambda f: (bin(int(f) ^ b).count("1"), f))  # noqa: B023
                    out[r, b] = y[np.flatnonzero(bucket == near)[0]]
        return out.ravel()


def encode_documents(rows: DataFrame, encoder: FixedEncoder) -> DataFrame:
    """(id, values) of rows (id, matrix)."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = [encoder.document(m) for m in batch.column("matrix").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(coded, pa.list_(pa.float64()))], ["id", "values"])

    return rows.select("id", "matrix").mapInArrow(run, f"id {kind}, values array<double>")


def late_search(rows: DataFrame, encoded: DataFrame, encoder: FixedEncoder, query: Sequence[Sequence[float]], k: int, candidate_k: int = 1000, where=None) -> DataFrame:
    """Candidates by the encodings' dot products, filtered before the cut, then exact MaxSim over their matrices."""
    from tessera.operators.distance import dot, literal

    pool = encoded if where is None else encoded.join(rows.where(where).select("id"), "id", "left_semi")
    first = ordered(pool.select("id", dot(F.col("values"), literal(encoder.query(query))).alias("score")), candidate_k, descending=True)
    return maxsim_matrices(rows.join(F.broadcast(first.select("id")), "id", "left_semi"), query, k)


def matched(rows: DataFrame, query: Sequence[Sequence[float]], k: int, candidates: int | None = None) -> DataFrame:
    """(id, score) of rows (id, matrix) by MaxSim: of all rows, or of the best ``candidates`` by their encodings. Rows without vectors match nothing."""
    rows = rows.where(F.size("matrix") > 0)
    if candidates is None:
        return maxsim_matrices(rows, query, k)
    encoder = FixedEncoder(len(query[0]))
    return late_search(rows, encode_documents(rows, encoder), encoder, query, k, max(k, candidates))


def overlay(segment: DataFrame, log: DataFrame, touched: DataFrame, k: int) -> DataFrame:
    """Scored segment rows that the log has not touched, and scored log rows."""
    return ordered(segment.join(touched.select("id").distinct(), "id", "left_anti").unionByName(log), k, descending=True)


def pooled(matrix: Sequence[Sequence[float]], step: int = 2) -> np.ndarray:
    """Means of neighbouring vectors."""
    x = np.asarray(matrix, np.float64)
    return np.stack([x[i : i + step].mean(axis=0) for i in range(0, len(x), step)])


def coverage(live: DataFrame, embedded: DataFrame) -> DataFrame:
    """One row: total, covered, failed and pending live rows. ``embedded`` has id, version and status (ready or failed)."""
    joined = live.select("id", "version").join(embedded.select("id", "version", "status"), ["id", "version"], "left")
    return joined.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "ready").alias("covered"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status").isNull()).alias("pending"),
    )
