"""Binary forms of multi-vector matrices: half floats, and 8-bit integers with a scale per group.

A stored matrix has a head (four letters that tell the form, then rows, columns
and group size), so a reader needs nothing else and refuses what isn't one.
Numbers are little-endian.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import ValidationError

HEAD = struct.Struct("<4sIII")
HALF, GROUPED = b"TMXH", b"TMXG"
MOST = 65504.0  # the greatest half float


def pack(matrix, group: int | None = None) -> bytes:
    """Half floats, or with ``group`` 8-bit integers.

    A group's scale makes its largest number 127. The scales also hold the
    normalization: rows that are read back have length 1, rows of zeros stay.
    """
    x = np.asarray(matrix, np.float64)
    x = x.reshape(len(x), -1) if x.size else np.zeros((0, 0))
    if not np.isfinite(x).all():
        raise ValidationError("a matrix must hold finite numbers")
    rows, width = x.shape
    if group is None:
        if x.size and np.abs(x).max() > MOST:
            raise ValidationError(f"half floats end at {MOST}")
        return HEAD.pack(HALF, rows, width, 0) + x.astype("<f2").tobytes()
    if group < 1 or width % group:
        raise ValidationError("the group size must divide the vectors' dimensions")
    parts = x.reshape(rows, width // group, group)
    scale = np.abs(parts).max(axis=2) / 127
    codes = np.rint(parts / np.where(scale > 0, scale, 1)[:, :, None])
    length = np.sqrt(((codes * scale[:, :, None]) ** 2).sum(axis=(1, 2)))
    scale = scale / np.where(length > 0, length, 1)[:, None]
    return HEAD.pack(GROUPED, rows, width, group) + scale.astype("<f2").tobytes() + codes.astype(np.int8).tobytes()


def unpack(data: bytes) -> np.ndarray:
    """The matrix of ``pack``'s bytes."""
    if len(data) < HEAD.size:
        raise ValidationError("not a stored matrix")
    kind, rows, width, group = HEAD.unpack_from(data)
    body = data[HEAD.size :]
    if kind == HALF and len(body) == 2 * rows * width:
        return np.frombuffer(body, "<f2").astype(np.float64).reshape(rows, width)
    if kind == GROUPED and group and width % group == 0 and len(body) == rows * (width // group) * 2 + rows * width:
        of = rows * (width // group)
        scale = np.frombuffer(body[: 2 * of], "<f2").astype(np.float64).reshape(rows, width // group, 1)
        codes = np.frombuffer(body[2 * of :], np.int8).astype(np.float64).reshape(rows, width // group, group)
        return (codes * scale).reshape(rows, width)
    raise ValidationError("not a stored matrix")


def packed(matrix: Column, group: int | None = None) -> Column:
    """A column of matrices as bytes; null stays null."""

    @F.arrow_udf(T.BinaryType())
    def run(matrices: pa.Array) -> pa.Array:
        return pa.array([None if m is None else pack(m, group) for m in matrices.to_pylist()], pa.binary())

    return run(matrix)


def unpacked(data: Column) -> Column:
    """A column of ``packed`` bytes as matrices; null stays null."""

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def run(stored: pa.Array) -> pa.Array:
        return pa.array([None if b is None else unpack(b).tolist() for b in stored.to_pylist()], pa.list_(pa.list_(pa.float64())))

    return run(data)
