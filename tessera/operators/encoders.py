"""Pluggable encoders from inputs to multi-vectors, run as Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Encoder(Protocol):
    """Encodes texts; every text gives a matrix of vectors of ``dimensions`` numbers."""

    dimensions: int
    epoch: str

    def documents(self, texts: list[str]) -> list[np.ndarray]: ...

    def query(self, text: str) -> np.ndarray: ...


class HashEncoder:
    """Deterministic encoder for tests: a unit vector for each word, drawn from the word's hash."""

    def __init__(self, dimensions: int = 32, epoch: str = "dev"):
        self.dimensions, self.epoch = dimensions, epoch

    def _word(self, word: str) -> np.ndarray:
        seed = int.from_bytes(hashlib.sha256(f"{self.epoch}:{word}".encode()).digest()[:8], "little")
        v = np.random.default_rng(seed).standard_normal(self.dimensions)
        return v / np.linalg.norm(v)

    def query(self, text: str) -> np.ndarray:
        return np.stack([self._word(w) for w in text.lower().split()] or [np.zeros(self.dimensions)])

    def documents(self, texts: list[str]) -> list[np.ndarray]:
        return [self.query(t) for t in texts]


def enrich(units: DataFrame, encoder: Encoder, text: str = "text") -> DataFrame:
    """(id, content_hash, epoch, status, matrix) of units; a unit whose input can't be encoded is marked failed, the others go on."""
    rows = units.select(F.col("id").cast("string").alias("id"), "content_hash", F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            status, matrices = [], []
            for t in batch.column("text").to_pylist():
                try:
                    matrices.append(encoder.documents([t])[0].tolist() if t and t.strip() else None)
                except ValueError:
                    matrices.append(None)
                status.append("failed" if matrices[-1] is None else "ready")
            cols = [batch.column("id"), batch.column("content_hash"), pa.array([encoder.epoch] * batch.num_rows), pa.array(status), pa.array(matrices, pa.list_(pa.list_(pa.float64())))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "content_hash", "epoch", "status", "matrix"])

    return rows.mapInArrow(run, "id string, content_hash string, epoch string, status string, matrix array<array<double>>")


def pending(units: DataFrame, encoded: DataFrame, epoch: str) -> DataFrame:
    """Units whose present content the encoder of an epoch has not seen."""
    done = encoded.where(F.col("epoch") == epoch).select("id", "content_hash")
    return units.join(done, ["id", "content_hash"], "left_anti")
