"""Token counts by dynamic programming over a trie of the distinct pre-tokens.

The distinct new words of a stretch of texts are sorted, which lays out their
trie level by level: words with a common prefix stand together. The unigram
forward score of a prefix (best score of a segmentation that ends there, and
the number of its tokens) is computed once per trie node for all words that
share it. The number at a word's last node is its token count; a text's count
is the sum over its words. The counts are the lengths of the ids that
``sentencepiece_viterbi.encode`` gives.

Nothing is shuffled; a task holds one stretch of texts, its trie and a bounded
table of counts.

Defined results: null and empty texts have 0 tokens and 0 pre-tokens. Repeated
rows each get a row. Extra columns are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, text_of
from tessera.llm.pieces import BASE, NEVER, Pieces, coded, default_path, slices, units, utf8_size
from tessera.llm.sentencepiece_viterbi import CHARS, LONG, ROOM, Codec


class Counter:
    """Token counts of words, computed through tries and kept in a bounded table."""

    def __init__(self, pieces: Pieces, room: int = ROOM):
        self.p, self.room = pieces, room
        self.known: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        """(tokens, pre-tokens) of each text."""
        split = [units(t) for t in texts]
        if len(self.known) > self.room:
            self.known.clear()
        self.learn(sorted({w for ws in split for w in ws if w not in self.known}))
        get = self.known.__getitem__
        return [(sum(map(get, ws)), len(ws)) for ws in split]

    def learn(self, words: list[str]) -> None:
        far = [w for w in words if len(w) >= LONG]
        if far:
            codec = Codec(self.p)
            for w in far:
                flat, _, _ = coded([w])
                self.known[w] = len(codec.long_word(flat)) // 4
            words = [w for w in words if len(w) < LONG]
        if not words:
            return
        flat, start, size = coded(words)
        ends = self.trie(flat, start, size)
        self.known.update(zip(words, ends.tolist(), strict=True))

    def trie(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Terminal counts of sorted words."""
        p = self.p
        result = np.zeros(len(start), np.int64)
        live = np.arange(len(start))
        node = np.zeros(len(start), np.int64)
        # of the last max_chars + 1 levels, newest last: score, tokens, hash of each node and its parent in the level above
        levels = [(np.zeros(1), np.zeros(1, np.int64), np.zeros(1, np.uint64), np.zeros(1, np.int64))]
        level = 0
        with np.errstate(over="ignore"):
            while len(live):
                code = flat[start[live] + level]
                fresh = np.ones(len(live), np.bool_)
                fresh[1:] = (node[1:] != node[:-1]) | (code[1:] != code[:-1])
                first = np.flatnonzero(fresh)
                parent, char = node[first], code[first]
                node = np.cumsum(fresh) - 1
                level += 1
                hashes = levels[-1][2][parent] * BASE + (char.astype(np.uint64) + np.uint64(1))
                above, ups = parent, []
                for depth in range(1, min(level, p.max_chars) + 1):
                    ups.append(above)
                    if depth < min(level, p.max_chars):
                        above = levels[-depth][3][above]
                best, tokens = np.full(len(first), NEVER), np.zeros(len(first), np.int64)
                single = np.zeros(len(first), np.bool_)
                for k in range(len(ups), 0, -1):
                    up, (scores, counts, prefix, _) = ups[k - 1], levels[-k]
                    hit, _, value = p.find(hashes - prefix[up] * p.power[k], k)
                    if k == 1:
                        single[hit] = True
                    score = scores[up[hit]] + value
                    better = score > best[hit]
                    hit = hit[better]
                    best[hit], tokens[hit] = score[better], counts[up[hit]] + 1
                lone = np.flatnonzero(~single)
                score = levels[-1][0][parent[lone]] + p.unknown
                better = score > best[lone]
                lone = lone[better]
                best[lone], tokens[lone] = score[better], levels[-1][1][parent[lone]] + utf8_size(char[lone])
                levels.append((best, tokens, hashes, parent))
                if len(levels) > p.max_chars + 1:
                    levels.pop(0)
                last = size[live] == level
                result[live[last]] = tokens[node[last]]
                live, node = live[~last], node[~last]
        return result


def token_counts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), model_path: str | None = None) -> DataFrame:
    """``keep`` columns, n_tokens and n_pretokens of each row."""
    with open(model_path or default_path(), "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(*[F.col(k).alias(k) for k in keep], text_of(text).alias("__t"))
    head = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(Pieces(shared.value))
        for batch in batches:
            texts = batch.column("__t").to_pylist()
            counts = [x for a, b in slices(texts, CHARS) for x in counter.count(texts[a:b])]
            cols = {k: batch.column(k) for k in keep}
            cols |= {"n_tokens": pa.array([x[0] for x in counts], pa.int64()), "n_pretokens": pa.array([x[1] for x in counts], pa.int64())}
            yield pa.RecordBatch.from_pydict(cols)

    return rows.mapInArrow(run, f"{head}, n_tokens bigint, n_pretokens bigint")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
