"""Frozen descriptions of namespaces, full-text fields and indexes, with their rules."""

from __future__ import annotations

import re
import uuid
from dataclasses import asdict, dataclass, field, replace
from math import ceil

from tessera.errors import ValidationError

METRICS = ("cosine", "euclidean", "dot_product")
QUANTIZATIONS = ("none", "scalar", "two_bit", "product")
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,254}")
_ID = re.compile(r"[A-Za-z0-9._-]+")


def valid_name(name: str) -> str:
    """Namespace names: 1 to 255 letters, digits, dots, dashes or underscores, the first a letter or digit."""
    if not _NAME.fullmatch(name):
        raise ValidationError(f"bad namespace name: {name!r}")
    return name


def valid_id(key: str, longest: int = 1024) -> str:
    """Row ids: letters, digits, dots, dashes and underscores."""
    if not _ID.fullmatch(key) or len(key) > longest:
        raise ValidationError(f"bad id: {key!r}")
    return key


@dataclass(frozen=True)
class TextField:
    """Analyzer and BM25 parameters of a full-text field."""

    language: str = "english"
    stemming: bool = True
    remove_stopwords: bool = True
    case_sensitive: bool = False
    k1: float = 1.2
    b: float = 0.75
    max_token_length: int = 40

    def __post_init__(self):
        if not 0 < self.k1 <= 10:
            raise ValidationError("k1 must be over 0 and at most 10")
        if not 0 <= self.b <= 1:
            raise ValidationError("b must lie between 0 and 1")
        if self.max_token_length < 1:
            raise ValidationError("max_token_length must be 1 or more")


@dataclass(frozen=True)
class IndexConfig:
    """Physical choices of the batch index."""

    nlist: int | None = None
    quantization: str = "two_bit"
    pq_m: int = 8
    hierarchical: bool = False
    fts_index: bool = True
    bitmap_index: bool = True

    def check(self, dimensions: int) -> IndexConfig:
        if self.quantization not in QUANTIZATIONS:
            raise ValidationError(f"unknown quantization: {self.quantization}")
        if self.quantization == "product" and (self.pq_m < 1 or dimensions % self.pq_m):
            raise ValidationError("pq_m must divide the dimensions")
        if self.hierarchical and self.quantization == "two_bit":
            raise ValidationError("hierarchical indexes take no two-bit codes")
        return self


@dataclass(frozen=True)
class NamespaceSpec:
    """A table of vectors with attributes."""

    name: str
    dimensions: int
    metric: str = "cosine"
    text_fields: dict[str, TextField] = field(default_factory=dict)
    index: IndexConfig = field(default_factory=IndexConfig)

    def __post_init__(self):
        valid_name(self.name)
        if not 1 <= self.dimensions <= 65_536:
            raise ValidationError("dimensions must lie between 1 and 65536")
        if self.metric not in METRICS:
            raise ValidationError(f"unknown metric: {self.metric}")
        self.index.check(self.dimensions)

    def with_index(self, **changes) -> NamespaceSpec:
        return replace(self, index=replace(self.index, **changes))

    def to_dict(self) -> dict:
        return asdict(self)

    @staticmethod
    def from_dict(raw: dict) -> NamespaceSpec:
        raw = dict(raw)
        raw["text_fields"] = {k: TextField(**v) for k, v in raw.get("text_fields", {}).items()}
        raw["index"] = IndexConfig(**raw.get("index", {}))
        return NamespaceSpec(**raw)


def generated_name() -> str:
    return f"ns-{uuid.uuid4()}"


def cluster_count(rows: int, configured: int | None = None) -> int:
    """Clusters of an index: rows / 3000 between 256 and 4096, never more than rows."""
    wanted = configured or min(max(ceil(rows / 3000), 256), 4096)
    return max(1, min(wanted, rows)) if rows else 0


def default_nprobe(clusters: int) -> int:
    """Clusters to probe: three sixteenths, at least 32, at most 256, never more than there are."""
    return min(min(max(ceil(clusters * 3 / 16), 32), 256), clusters)
