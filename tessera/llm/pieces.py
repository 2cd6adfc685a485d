"""Pieces of a SentencePiece model file and the splitting of texts into independent words.

A piece has the space mark only at its front, so the best segmentation of a
text is that of its words one by one: each run of spaces goes with the
characters that follow it. Spaces and the mark character itself are one and the
same to such a model.

Scores are the model's own. A character that no piece has costs ``UNKNOWN``
below the least score and becomes its UTF-8 bytes, as byte fallback asks.

Models that this can't follow are refused: those with a piece that has the mark
behind other characters, with user-defined pieces, without byte pieces, or with a
normalizer that changes texts.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable

import numpy as np
import pyarrow.compute as pc

MARK = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xC2B2AE3D27D4EB4F)
SHIFT = np.uint64(48)
UNKNOWN = 10
NEVER = np.float64(-1e300)

_UNITS = re.compile(" *[^ ]+| +")


def default_path() -> str:
    """The installed public model file."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        c = data[at]
        at += 1
        value |= (c & 127) << shift
        if c < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterable[tuple[int, object]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _varint(data, at)
            value = data[at : at + size]
            at += size
        yield key >> 3, value


class Pieces:
    """Piece table: sorted 64-bit keys of the ordinary pieces with their ids and scores, and the byte pieces."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        ordinary: list[tuple[str, int, float]] = []
        self.byte_ids = np.full(256, -1, np.int32)
        self.byte_of: dict[int, int] = {}
        for number, value in _fields(model):
            if number == 3 and dict(_fields(value)).get(1, b"identity") not in (b"identity", b""):
                raise ValueError("the model normalizes texts")
            if number != 1:
                continue
            piece = dict(_fields(value))
            text, kind = piece[1].decode("utf-8"), piece.get(3, 1)
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            no = len(self.pieces)
            self.pieces.append(text)
            if kind == 6:
                byte = int(text[3:5], 16)
                self.byte_ids[byte] = no
                self.byte_of[no] = byte
            elif kind == 1:
                if MARK in text.lstrip(MARK):
                    raise ValueError(f"a mark inside a piece: {text!r}")
                ordinary.append((text, no, score))
            elif kind == 4:
                raise ValueError(f"a user-defined piece: {text!r}")
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte pieces")
        self.surface = [p.replace(MARK, " ") for p in self.pieces]
        self.max_chars = max(len(t) for t, _, _ in ordinary)
        self.unknown = min(s for _, _, s in ordinary) - UNKNOWN
        self.power = np.ones(self.max_chars + 1, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(1, self.max_chars + 1):
                self.power[k] = self.power[k - 1] * BASE
        # for each length: sorted keys, their ids and scores, and a sieve that most other keys don't pass
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for k in range(self.max_chars + 1):
            own = sorted((int(self.key(t)), no, score) for t, no, score in ordinary if len(t) == k)
            keys = np.array([x[0] for x in own], np.uint64)
            if len(np.unique(keys)) != len(keys):
                raise ValueError("two pieces have one key")
            sieve = np.zeros(1 << 16, np.bool_)
            sieve[(keys >> SHIFT).astype(np.int64)] = True
            self.tables.append((keys, np.array([x[1] for x in own], np.int32), np.array([x[2] for x in own], np.float64), sieve))

    @staticmethod
    def key(piece: str) -> np.uint64:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in piece:
                h = h * BASE + np.uint64(ord(c) + 1)
            return h * MIX

    def find(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the substrings of one length are pieces, with their ids and scores."""
        keys, ids, scores, sieve = self.tables[size]
        mixed = hashes * MIX
        maybe = np.flatnonzero(sieve[mixed >> SHIFT])
        if not len(maybe) or not len(keys):
            return maybe[:0], ids[:0], scores[:0]
        wanted = mixed[maybe]
        at = np.searchsorted(keys, wanted)
        at[at == len(keys)] = 0
        good = keys[at] == wanted
        at = at[good]
        return maybe[good], ids[at], scores[at]


def units(text: str) -> list[str]:
    """Words of a text, each without the one space that stands in front of every word (the model puts one before the text)."""
    if MARK in text:
        text = text.replace(MARK, " ")
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [u[1:] for u in _UNITS.findall(" " + text)]
    return text.split(" ")


def coded(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words with their front spaces, one after another; the start and the length of each."""
    flat = np.frombuffer((" " + " ".join(words)).encode("utf-32-le", "surrogatepass"), np.uint32) if words else np.zeros(0, np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.concatenate(([0], np.cumsum(size)[:-1])) if words else np.zeros(0, np.int64)
    mark = np.uint32(ord(MARK))
    return np.where(flat == 32, mark, flat), start, size


def utf8_size(codes: np.ndarray) -> np.ndarray:
    """Bytes that each code point takes."""
    return 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)


def slices(texts: list[str], chars: int):
    """(from, to) of stretches of about ``chars`` characters."""
    at = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= chars:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def stretches(column, size: int):
    """(from, to, texts) of stretches of an Arrow text column of about ``size`` bytes, made into strings one at a time."""
    lengths = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        before = lengths[at - 1] if at else 0
        to = min(len(column), int(np.searchsorted(lengths, before + size)) + 1)
        yield at, to, column.slice(at, to - at).to_pylist()
        at = to
