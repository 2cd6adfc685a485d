"""SentencePiece encoding and decoding by a batched numpy Viterbi search.

The ids are those of the best-scoring segmentation into the model's pieces (of
equal scores the one whose last piece is longer, at each place), which is what
the SentencePiece library gives for these pieces as a unigram model. The
distinct new words of a stretch of texts are grouped by length; words of one
length advance together: for each end and piece length the substrings' hashes
probe the sorted piece keys, and a vectorised maximum stores the back pointer.
A word is searched once per task, as long as the task's table has room.

Nothing is shuffled; a task holds one stretch of texts and a bounded table.

Defined results: null and empty texts have no ids. The model knows no
difference between a space and its mark, so decoding gives spaces for both, and
any other text back exactly. Repeated rows each get a row. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import lightened, table, text_of, tidied
from tessera.llm.pieces import BASE, MARK, NEVER, Pieces, coded, default_path, slices, units

LONG = 256
ROOM = 300_000
CHARS = 6_000_000


class Codec:
    """Encoder and decoder with a bounded table of words already searched."""

    def __init__(self, pieces: Pieces, room: int = ROOM):
        self.p, self.room = pieces, room
        self.known: dict[str, bytes] = {}
        surface = [s.encode("utf-8") for s in pieces.surface]
        for no, byte in pieces.byte_of.items():
            surface[no] = bytes([byte])
        self.surface = surface

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        split = [units(t) for t in texts]
        if len(self.known) > self.room:
            self.known.clear()
        self.learn({w for ws in split for w in ws if w not in self.known})
        get = self.known.__getitem__
        return [b"".join(map(get, ws)) for ws in split]

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; the space before the first word goes."""
        data = b"".join(map(self.surface.__getitem__, ids))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")

    def learn(self, words: set[str]) -> None:
        order = sorted(words, key=len)
        flat, start, size = coded(order)
        at = 0
        while at < len(order):
            n = int(size[at])
            to = int(np.searchsorted(size, n, "right"))
            if n > LONG:
                for i in range(at, to):
                    self.known[order[i]] = self.long_word(flat[start[i] : start[i] + n])
            else:
                for a in range(at, to, 200_000):
                    b = min(to, a + 200_000)
                    self.advance(order[a:b], flat[start[a] : start[a] + n * (b - a)].reshape(b - a, n))
            at = to

    def advance(self, words: list[str], codes: np.ndarray) -> None:
        """Search words of one length at once."""
        p = self.p
        m, n = codes.shape
        best = np.full((n + 1, m), NEVER)
        best[0] = 0
        back = np.zeros((n + 1, m), np.int64)
        token = np.zeros((n + 1, m), np.int32)
        prefix = np.zeros((n + 1, m), np.uint64)
        rows = np.arange(m)
        with np.errstate(over="ignore"):
            for j in range(1, n + 1):
                c = codes[:, j - 1].astype(np.uint64) + np.uint64(1)
                prefix[j] = prefix[j - 1] * BASE + c
                single = np.zeros(m, np.bool_)
                for k in range(min(j, p.max_chars), 0, -1):
                    hit, ids, scores = p.find(prefix[j] - prefix[j - k] * p.power[k], k)
                    if k == 1:
                        single[hit] = True
                    if not len(hit):
                        continue
                    score = best[j - k].take(hit) + scores
                    better = score > best[j].take(hit)
                    hit = hit[better]
                    best[j, hit], back[j, hit], token[j, hit] = score[better], k, ids[better]
                lone = np.flatnonzero(~single)
                if len(lone):
                    score = best[j - 1, lone] + p.unknown
                    better = score > best[j, lone]
                    hit = lone[better]
                    best[j, hit], back[j, hit], token[j, hit] = score[better], 1, -1 - codes[hit, j - 1].astype(np.int32)
        out = np.zeros((m, n), np.int32)
        at, left = np.full(m, n), np.full(m, n)
        live = rows
        while len(live):
            left[live] -= 1
            out[live, left[live]] = token[at[live], live]
            at[live] -= back[at[live], live]
            live = live[at[live] > 0]
        odd = (out < 0).any(axis=1)
        for i, word in enumerate(words):
            ids = out[i, left[i] :]
            self.known[word] = self.with_bytes(ids) if odd[i] else ids.tobytes()

    def with_bytes(self, ids: np.ndarray) -> bytes:
        """Ids with the byte pieces of characters that no piece has."""
        done: list[int] = []
        for x in ids.tolist():
            done.extend([x] if x >= 0 else (int(self.p.byte_ids[b]) for b in chr(-1 - x).encode("utf-8", "surrogatepass")))
        return np.array(done, np.int32).tobytes()

    def long_word(self, codes: np.ndarray) -> bytes:
        """One very long word: all substrings of a length are probed at once, then one pass over the ends."""
        p, n = self.p, len(codes)
        prefix = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            h = np.uint64(0)
            for j, c in enumerate(codes.tolist()):
                h = h * BASE + np.uint64(c + 1)
                prefix[j + 1] = h
            ends: dict[int, list[tuple[int, int, int]]] = {}
            single = np.zeros(n + 1, np.bool_)
            for k in range(min(n, p.max_chars), 0, -1):
                hit, ids, scores = p.find(prefix[k:] - prefix[:-k] * p.power[k], k)
                if k == 1:
                    single[hit + 1] = True
                for j, no, score in zip((hit + k).tolist(), ids.tolist(), scores.tolist(), strict=True):
                    ends.setdefault(j, []).append((k, score, no))
        best, back = [0] * (n + 1), [(0, 0)] * (n + 1)
        for j in range(1, n + 1):
            top = None
            for k, score, no in ends.get(j, ()):
                if top is None or best[j - k] + score > top:
                    top, back[j] = best[j - k] + score, (k, no)
            if not single[j] and (top is None or best[j - 1] + p.unknown > top):
                top, back[j] = best[j - 1] + p.unknown, (1, -1 - int(codes[j - 1]))
            best[j] = top
        out = []
        while n:
            out.append(back[n][1])
            n -= back[n][0]
        return self.with_bytes(np.array(out[::-1], np.int32))


def normal(text: str) -> str:
    """What decoding gives back: the text with spaces for marks."""
    return text.replace(MARK, " ") if MARK in text else text


def encode(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), model_path: str | None = None) -> DataFrame:
    """``keep`` columns, ids, n_tokens and round_trip (decoding the ids gave the text back)."""
    lightened(docs.sparkSession)
    with open(model_path or default_path(), "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(*[F.col(k).alias(k) for k in keep], text_of(text).alias("__t"))
    head = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(Pieces(shared.value))
        for batch in batches:
            texts = batch.column("__t").to_pylist()
            for a, b in slices(texts, CHARS):
                packed = codec.encode(texts[a:b])
                size = np.fromiter(map(len, packed), np.int64, b - a) // 4
                flat = np.frombuffer(b"".join(packed), np.int32)
                same = [codec.decode(np.frombuffer(x, np.int32).tolist()) == normal(t) for x, t in zip(packed, texts[a:b], strict=True)]
                offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                cols = {k: batch.column(k).slice(a, b - a) for k in keep}
                cols |= {"ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), "n_tokens": pa.array(size), "round_trip": pa.array(same)}
                yield pa.RecordBatch.from_pydict(cols)
        del codec
        tidied()

    return rows.mapInArrow(run, f"{head}, ids array<int>, n_tokens bigint, round_trip boolean")


def decode(encoded: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), model_path: str | None = None) -> DataFrame:
    """``keep`` columns and the text of the ids; null ids give an empty text."""
    with open(model_path or default_path(), "rb") as file:
        shared = encoded.sparkSession.sparkContext.broadcast(file.read())
    rows = encoded.select(*[F.col(k).alias(k) for k in keep], F.col(ids).alias("__ids"))
    head = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(Pieces(shared.value))
        for batch in batches:
            cols = {k: batch.column(k) for k in keep}
            cols["text"] = pa.array([codec.decode(x or []) for x in batch.column("__ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_pydict(cols)
        tidied()

    return rows.mapInArrow(run, f"{head}, text string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
