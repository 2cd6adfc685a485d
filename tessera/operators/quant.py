"""Quantized codes: 8-bit scalar, product, and 2-bit and 1-bit codes of rotated residuals."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.ann import ordered, scores, train_centroids
from tessera.operators.distance import distance, literal

BLOCK = 256


# 8-bit scalar codes


def calibrate(rows: DataFrame, values: str = "values") -> DataFrame:
    """(dim, lo, hi) of every dimension."""
    each = rows.select(F.posexplode(values).alias("dim", "x"))
    return each.groupBy(F.col("dim").cast("long").alias("dim")).agg(F.min(F.col("x").cast("double")).alias("lo"), F.max(F.col("x").cast("double")).alias("hi"))


def bounds(calibration: DataFrame) -> tuple[list[float], list[float]]:
    """Lower and upper bounds by dimension; as many rows as dimensions reach the driver."""
    found = sorted(calibration.collect(), key=lambda r: r["dim"])
    return [r["lo"] for r in found], [r["hi"] for r in found]


def encode_sq8(values: Column, lo: Sequence[float], hi: Sequence[float]) -> Column:
    """Codes 0 to 255; a dimension without range is 0."""

    def code(v: Column, b: Column) -> Column:
        width = b["hi"] - b["lo"]
        scaled = (v.cast("double") - b["lo"]) * 255.0 / width
        return F.when(width <= 0, F.lit(0)).otherwise(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), scaled)))).cast("int")

    return F.zip_with(values, F.arrays_zip(literal(lo).alias("lo"), literal(hi).alias("hi")), code)


def decode_sq8(codes: Column, lo: Sequence[float], hi: Sequence[float]) -> Column:
    limits = F.arrays_zip(literal(lo).alias("lo"), literal(hi).alias("hi"))
    return F.zip_with(codes, limits, lambda c, b: b["lo"] + c.cast("double") * (b["hi"] - b["lo"]) / 255.0)


def sq8_topk(rows: DataFrame, vector: Sequence[float], metric: str, k: int, lo: Sequence[float], hi: Sequence[float]) -> DataFrame:
    """Distances of the vector to the decoded codes."""
    decoded = decode_sq8(encode_sq8(F.col("values"), lo, hi), lo, hi)
    return ordered(rows.select("id", distance(metric, decoded, literal(vector)).alias("score")), k)


def reranked(rows: DataFrame, coarse: DataFrame, vector: Sequence[float], metric: str, k: int) -> DataFrame:
    """Exact distances of the rows that a coarse search found: 4 k of them at most, so they are broadcast."""
    return ordered(scores(rows.join(F.broadcast(coarse.select("id")), "id", "left_semi"), vector, metric).select("id", "score"), k)


# product codes


def train_pq(rows: DataFrame, m: int, codes: int = 256, seed: int = 7) -> np.ndarray:
    """Codebooks (m, codes, width); short ones repeat their last centroid."""
    width = len(rows.first()["values"]) // m
    n = rows.count()
    books = []
    for i in range(m):
        part = rows.select(F.slice("values", i * width + 1, width).alias("values"))
        book = train_centroids(part, max(2, min(codes, n)), seed)
        books.append(np.concatenate([book, np.repeat(book[-1:], codes - len(book), axis=0)]) if len(book) < codes else book)
    return np.stack(books)


def encode_pq(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, codes): nearest codebook entry of every sub-space, the first of equally near ones."""
    m, _, width = books.shape
    kind = rows.schema["id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("values").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, m, width)
                codes = np.stack([((x[:, i, None, :] - books[i][None]) ** 2).sum(-1).argmin(1) for i in range(m)], axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(codes), pa.list_(pa.int32()))], ["id", "codes"])

    return rows.select("id", "values").mapInArrow(encode, f"id {kind}, codes array<int>")


def adc_table(books: np.ndarray, vector: Sequence[float], metric: str) -> np.ndarray:
    """Distance of every sub-vector to every codebook entry; cosine uses squared Euclidean distance."""
    q = np.asarray(vector, np.float64).reshape(books.shape[0], 1, -1)
    return -(books * q).sum(-1) if metric == "dot_product" else ((books - q) ** 2).sum(-1)


def pq_topk(coded: DataFrame, books: np.ndarray, vector: Sequence[float], metric: str, k: int) -> DataFrame:
    """Sums of table entries; the table has m times 256 numbers."""
    table = adc_table(books, vector, metric)
    entries = F.array(*[literal(t) for t in table])
    score = F.aggregate(F.zip_with("codes", entries, lambda c, t: F.get(t, c)), F.lit(0.0), lambda s, x: s + x)
    return ordered(coded.select("id", score.alias("score")), k)


# 2-bit codes


class Rotation:
    """Three rounds of sign flips, normalized Hadamard transform on blocks of 256, and a permutation; drawn from a seed."""

    def __init__(self, dimensions: int, seed: int = 7):
        self.size = -(-dimensions // BLOCK) * BLOCK
        rng = np.random.default_rng(seed)
        self.rounds = [(rng.choice([-1.0, 1.0], self.size), rng.permutation(self.size)) for _ in range(3)]

    def apply(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.size))
        out[:, : x.shape[1]] = x
        for signs, order in self.rounds:
            out = (out * signs).reshape(len(x), -1, BLOCK)
            step = 1
            while step < BLOCK:
                pairs = out.reshape(*out.shape[:2], BLOCK // (2 * step), 2, step)
                out = np.stack((pairs[..., 0, :] + pairs[..., 1, :], pairs[..., 0, :] - pairs[..., 1, :]), axis=-2).reshape(len(x), -1, BLOCK)
                step *= 2
            out = out.reshape(len(x), self.size)[:, order] / np.sqrt(BLOCK)
        return out


def rotated(rows: DataFrame, rotation: Rotation) -> DataFrame:
    """(id, values) with the vectors rotated; lengths and dot products stay."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def turn(values: pa.Array) -> pa.Array:
        x = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)
        return pa.array(list(rotation.apply(x)), pa.list_(pa.float64()))

    return rows.select("id", turn("values").alias("values"))


def two_bit(residual: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Levels (-1.5, -0.5, 0.5, 1.5) of rotated residuals, their norms, and the dot of each code with its unit residual.

    Of all thresholds that split a residual's magnitudes into small and large,
    the one whose code has the greatest cosine with the residual is taken.
    """
    norm = np.linalg.norm(residual, axis=1)
    unit = residual / np.where(norm > 0, norm, 1)[:, None]
    size = np.abs(unit)
    order = np.argsort(-size, axis=1, kind="stable")
    ranked = np.take_along_axis(size, order, axis=1)
    n = residual.shape[1]
    large = np.arange(n + 1)
    dots = 0.5 * size.sum(1)[:, None] + np.concatenate([np.zeros((len(unit), 1)), np.cumsum(ranked, axis=1)], axis=1)
    cosine = dots / np.sqrt(0.25 * n + 2.0 * large)
    count = cosine.argmax(axis=1)
    rank = np.argsort(order, axis=1, kind="stable")
    code = np.sign(np.where(unit == 0, 1.0, unit)) * np.where(rank < count[:, None], 1.5, 0.5)
    length = np.linalg.norm(code, axis=1)
    return code, norm, (code * unit).sum(1) / length


def one_bit(residual: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signs (-1, 1) of rotated residuals, their norms, and the dot of each code with its unit residual."""
    norm = np.linalg.norm(residual, axis=1)
    unit = residual / np.where(norm > 0, norm, 1)[:, None]
    return np.where(unit < 0, -1.0, 1.0), norm, np.abs(unit).sum(1) / np.sqrt(residual.shape[1])


def four_bit_query(query: np.ndarray, seed: int = 7) -> np.ndarray:
    """The query in 16 equal steps from its least to its greatest number, rounded at random with the seed's draws so that sums have no bias."""
    low, step = query.min(), (query.max() - query.min()) / 15
    if step == 0:
        return query.copy()
    draws = np.random.default_rng(seed).random(len(query))
    return low + step * np.clip(np.floor((query - low) / step + draws), 0, 15)


def two_bit_scores(code: np.ndarray, norm: np.ndarray, fit: np.ndarray, query: np.ndarray, metric: str, query_norm: float | None = None) -> np.ndarray:
    """Estimated distances of rotated codes to a rotated query, both relative to the same centroid.

    ``query_norm`` is the norm of the query itself where ``query`` is a coarser form of it.
    """
    length = np.linalg.norm(code, axis=1)
    cross = norm * (code @ query) / np.where(length * fit > 0, length * fit, 1)
    if metric == "dot_product":
        return -cross
    squared = norm**2 + (query @ query if query_norm is None else query_norm**2) - 2 * cross
    return squared if metric == "euclidean" else squared / 2


def two_bit_topk(
    rows: DataFrame,
    vector: Sequence[float],
    metric: str,
    k: int,
    centroid: Sequence[float] | None = None,
    seed: int = 7,
    encode=two_bit,
    rotate: bool = True,
    four_bits: bool = False,
) -> DataFrame:
    """Best k rows by 2-bit estimates against one centroid (the origin by default). Vectors of a cosine namespace are taken at length 1.

    ``encode`` may be ``one_bit``; ``four_bits`` takes the query in its 4-bit form.
    """
    q = np.asarray(vector, np.float64)
    rotation, c = Rotation(len(q), seed), np.zeros(len(q)) if centroid is None else np.asarray(centroid, np.float64)
    turn = rotation.apply if rotate else np.asarray
    q = q / np.linalg.norm(q) if metric == "cosine" else q
    offset = float(q @ c)
    whole = turn(q[None] if metric == "dot_product" else (q - c)[None])[0]
    query, size = four_bit_query(whole, seed) if four_bits else whole, float(np.linalg.norm(whole))

    @F.arrow_udf(T.DoubleType())
    def estimate(values: pa.Array) -> pa.Array:
        x = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)
        if metric == "cosine":
            x /= np.linalg.norm(x, axis=1, keepdims=True)
        out = two_bit_scores(*encode(turn(x - c)), query, metric, size)
        return pa.array(out - offset if metric == "dot_product" else out)

    return ordered(rows.select("id", estimate("values").alias("score")), k)
