"""Language identification with language-bitmask n-gram filters.

Learning: letters' 1-, 2- and 3-grams (with the word's edges) are counted per
language over all learning rows, and an n-gram belongs to a language when its
share there is at least ``min_share`` and at least ``min_lift`` of its greatest
share in any language. All these go into one bit-sliced Bloom filter: a slot
holds a bit per language, so that the AND of an n-gram's slots gives all
languages that contain it.

Prediction: per-language popcounts over a text's n-grams, corrected for the
false positives that the filter's filling makes likely, decide; the score is
the corrected share of the text's n-grams that the language contains.

An n-gram needs a share of ``min_share``, so a language has at most 1 / min_share
of each length, whatever the corpus; the filter has eight slots an n-gram, at
most ``MAX_SLOTS`` (room for over a hundred languages), so its broadcast has a fixed bound. Words
are looked up once per task while its table has room.

Defined results: a null or letterless text is ``und`` with score 0, and so is
every text when nothing was learnt. Rows with a null lang teach nothing. A null
doc_id counts as the empty string for the fold. Ties go to the language with
more learning rows, then to the lesser name. Repeated rows each get a row.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import lightened, table, tidied
from tessera.llm.pieces import slices

MIN_SHARE = 2e-5
MIN_LIFT = 0.05
HASHES = 3
MAX_SLOTS = 1 << 25
CHARS = 6_000_000
ROOM = 300_000

_WORDS = re.compile(r"[^\W\d_]+")
_MULTIPLY = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters (general category L) of a text."""
    found = _WORDS.findall(text.lower())
    if text.isascii():
        return found
    # \w also holds numbers like ² and Ⅷ
    return [w for run in found for w in ([run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split())]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the three n-grams at each letter of the words, and the letters of each word. A key holds 21 bits a character."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    at = np.flatnonzero(flat != 32)
    one, b = flat[at], np.uint64(21)
    two = flat[at - 1] << b | one
    three = two << b | flat[at + 1]
    return np.stack((one, two, three), axis=1), size


def slots(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """Places of n-grams in a filter of 2 ** bits slots."""
    with np.errstate(over="ignore"):
        mixed = keys ^ (keys >> np.uint64(31))
        return [((mixed * m) >> np.uint64(64 - bits)).astype(np.int64) for m in _MULTIPLY[:HASHES]]


class Model:
    """The filter, the languages by rank, and the rate of false positives of each."""

    def __init__(self, languages: list[str], bits: int, masks: np.ndarray):
        self.languages, self.bits, self.masks = languages, bits, masks
        fill = [(masks[:, i // 63] >> np.uint64(i % 63) & np.uint64(1)).mean() for i in range(len(languages))]
        self.false = np.minimum(np.array(fill) ** HASHES, 0.99)

    def hits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Popcount per word and language, and n-grams per word."""
        keys, size = grams(words)
        a, *rest = slots(keys.ravel(), self.bits)
        mask = self.masks[a]
        for s in rest:
            mask &= self.masks[s]
        ends = np.cumsum(size * 3)
        out = np.zeros((len(words), len(self.languages)), np.int32)
        for i in range(len(self.languages)):
            total = np.concatenate(([0], np.cumsum(mask[:, i // 63] >> np.uint64(i % 63) & np.uint64(1))))
            out[:, i] = total[ends] - total[ends - size * 3]
        return out, (size * 3).astype(np.int32)


class Predictor:
    def __init__(self, model: Model, room: int = ROOM):
        self.model, self.room = model, room
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.model.languages) + 1), np.int32)

    def learn(self, words: list[str]) -> None:
        if not words:
            return
        need = len(self.known) + len(words)
        if need > len(self.table):
            bigger = np.zeros((2 * need, self.table.shape[1]), np.int32)
            bigger[: len(self.known)] = self.table[: len(self.known)]
            self.table = bigger
        hits, size = self.model.hits(words)
        at = len(self.known)
        self.table[at:need, :-1], self.table[at:need, -1] = hits, size
        self.known.update(zip(words, range(at, need), strict=True))

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        if len(self.known) > self.room:
            self.forget()
        split = [words_of(t) for t in texts]
        self.learn(list({w for ws in split for w in ws if w not in self.known}))
        get, false, out = self.known.__getitem__, self.model.false, []
        for ws in split:
            if not ws or not self.model.languages:
                out.append(("und", 0.0))
                continue
            total = self.table[np.fromiter(map(get, ws), np.int64, len(ws))].sum(axis=0, dtype=np.int64)
            share = (total[:-1] / total[-1] - false) / (1 - false)
            best = int(share.argmax())
            out.append((self.model.languages[best], float(min(1.0, max(0.0, share[best])))))
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-gram counts of a task's texts, by language."""
    words: dict[str, Counter] = {}

    def counted() -> Iterator[pa.RecordBatch]:
        for lang, counter in words.items():
            if counter:
                keys, size = grams(list(counter))
                weight = np.repeat(np.repeat(np.fromiter(counter.values(), np.int64, len(counter)), size), 3)
                key, place = np.unique(keys.ravel(), return_inverse=True)
                count = np.bincount(place, weights=weight).astype(np.int64)
                cols = [pa.array([lang] * len(key), pa.string()), pa.array(key.astype(np.int64)), pa.array(count)]
                yield pa.RecordBatch.from_arrays(cols, ["lang", "gram", "k"])
        words.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(words_of(text))
        if sum(map(len, words.values())) > 400_000:
            yield from counted()
    yield from counted()


def learn(rows: DataFrame, min_share: float = MIN_SHARE, min_lift: float = MIN_LIFT, max_slots: int = MAX_SLOTS) -> Model:
    """Model of rows with lang and text. The driver gets the languages and the slots of the filter."""
    lightened(rows.sparkSession)
    rows = rows.where("lang is not null and text is not null")
    ranked = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    languages = [r["lang"] for r in ranked]
    counts = rows.select("lang", "text").mapInArrow(_count, "lang string, gram bigint, k bigint").groupBy("lang", "gram").agg(F.sum("k").alias("k"))
    counts = counts.persist()
    total = counts.groupBy("lang").agg(F.sum("k").alias("total"))
    share = counts.join(F.broadcast(total) if len(languages) < 10_000 else total, "lang").select("lang", "gram", (F.col("k") / F.col("total")).alias("share"))
    top = share.groupBy("gram").agg(F.max("share").alias("top"), F.collect_list(F.struct("lang", "share")).alias("in"))
    number = F.create_map(*[x for i, n in enumerate(languages) for x in (F.lit(n), F.lit(i))]) if languages else None
    if number is None:
        return Model([], 10, np.zeros((1 << 10, 1), np.uint64))
    kept = top.select("gram", F.filter("in", lambda s: (s["share"] >= min_share) & (s["share"] >= min_lift * F.col("top"))).alias("in")).where(F.size("in") > 0)
    kept = kept.select("gram", F.explode("in.lang").alias("lang")).select("gram", number[F.col("lang")].alias("no")).persist()
    bits = min(max_slots.bit_length() - 1, max(10, int(kept.select("gram").distinct().count() * 8).bit_length()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("gram").to_numpy().astype(np.uint64)
            for s in slots(keys, bits):
                yield pa.RecordBatch.from_arrays([pa.array(s), batch.column("no")], ["slot", "no"])

    placed = kept.mapInArrow(place, "slot bigint, no int")
    placed = placed.groupBy("slot", F.floor(F.col("no") / 63).cast("int").alias("part")).agg(F.bit_or(F.expr("shiftleft(1L, no % 63)")).alias("mask"))
    masks = np.zeros((1 << bits, (len(languages) + 62) // 63), np.uint64)
    found = placed.toArrow()
    masks[found.column("slot").to_numpy(), found.column("part").to_numpy()] = found.column("mask").to_numpy().astype(np.uint64)
    counts.unpersist()
    kept.unpersist()
    return Model(languages, bits, masks)


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred and score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[F.col(k).alias(k) for k in keep], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__t"))
    head = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(shared.value)
        for batch in batches:
            texts = batch.column("__t").to_pylist()
            got = [x for a, b in slices(texts, CHARS) for x in predictor.predict(texts[a:b])]
            cols = {k: batch.column(k) for k in keep}
            cols |= {"lang_pred": pa.array([g[0] for g in got], pa.string()), "score": pa.array([g[1] for g in got], pa.float64())}
            yield pa.RecordBatch.from_pydict(cols)
        del predictor
        tidied()

    return rows.mapInArrow(run, f"{head}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    """The fold that nothing is learnt from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out()).select(F.col("lang").cast("string").alias("lang"), "text"))
    return predict(docs.withColumn("held_out", held_out()), model, keep=("doc_id", "held_out"))
