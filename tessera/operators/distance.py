"""Vector distances as Columns over arrays; sums are doubles. Lower is better for all three metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import DimensionMismatch, ValidationError

F32_EPSILON = 1.1920928955078125e-07


def literal(vector: Sequence[float]) -> Column:
    """A vector as a constant array of doubles."""
    return F.array(*[F.lit(float(x)) for x in vector])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    difference = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(difference, F.lit(0.0), lambda s, x: s + x * x)


def dot_product(a: Column, b: Column) -> Column:
    """Negated dot product."""
    return -dot(a, b)


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine similarity, the similarity held between -1 and 1; 1 where a norm is next to nothing."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    similarity = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm))
    return F.when(norm < F32_EPSILON, F.lit(1.0)).otherwise(1.0 - similarity)


def distance(metric: str, a: Column, b: Column) -> Column:
    """Distance by a namespace's metric."""
    match metric:
        case "cosine":
            return cosine(a, b)
        case "euclidean":
            return euclidean(a, b)
        case "dot_product":
            return dot_product(a, b)
    raise ValidationError(f"unknown metric: {metric}")


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """The vector at length 1; as it is where its norm is next to nothing."""
    n = norm(a)
    return F.when(n <= F32_EPSILON, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def centered(a: Column, mean: Sequence[float], renormalize: bool = True) -> Column:
    """The vector less a mean, at length 1 if asked."""
    out = F.zip_with(a, literal(mean), lambda x, m: x.cast("double") - m)
    return normalized(out) if renormalize else out


def check_dimensions(vector: Sequence[float], dimensions: int) -> list[float]:
    """The vector as floats, if it fits and is finite."""
    if len(vector) != dimensions:
        raise DimensionMismatch(f"expected {dimensions} dimensions, got {len(vector)}")
    out = [float(x) for x in vector]
    if any(x != x or x in (float("inf"), float("-inf")) for x in out):
        raise ValidationError("vector is not finite")
    return out


def finite(a: Column) -> Column:
    """True where all elements are finite numbers."""
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
