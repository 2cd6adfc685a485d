"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over word sequences: n-grams of up to three words, across a whole
text with two start marks before it, are counted over all trusted rows. Where
words end, characters begin: the shortest context is interpolated with a model
over the characters of words, in which every word, with ``ORDER`` - 1 start marks
and an end mark, is one sentence. Continuation counts, counts of counts,
discounts, context weights and the interpolated probabilities of characters come
from joins and aggregates keyed by n-gram. N-grams of words are cut into shards by
the middle word of a trigram: then a trigram, its context and its shorter form lie
in one shard, and only counts of single words go between shards. Texts go to the
shards as packed records, in a few turns, so that disk holds a part of them at a time.

The log probability of a text is a sum over its n-grams: what its characters
give, a gain for each seen n-gram over its shorter form, and a weight for each
seen context. So texts are scored by one join on n-gram shards and one sum by text.
A bitmap of a fixed size keeps most n-grams that the model lacks out of the join.

A trusted row would find all its own n-grams. So for trusted rows those that no
other trusted document has count as unseen; thresholds then hold for new texts.
Words are known by 64-bit hashes.

A finished model of characters is cut into shards by the context's last character, so that an
n-gram, its shorter forms and their contexts lie in one shard. A shard has at
most about ``shard_rows`` rows; a task holds one shard at a time, adds up what it
knows of the words at hand, and goes on to the next. So memory is bounded
however large the model is.

Each row's perplexity is compared with its language's threshold, a quantile of
the perplexities of that language's trusted rows (of all trusted rows where a
language has none).

Defined results: a text without words has a null perplexity and is not kept. A
null language is a group of its own. A row is trusted if any label row of its
doc_id has quality 1. With no trusted rows nothing is judged: every text with
words is kept. Repeated rows each get a row. Extra columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

import gc
import hashlib
import itertools
import math
import pickle
import time
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import dropped, released, saved, table, text_of, tidied
from tessera.llm.pieces import BASE, MIX

ORDER = 5
START, END = "\x02", "\x03"
SHARD_ROWS = 2_000_000
TRUSTED_BOUND = 2_000_000
QUANTILE = 0.99
CHARS = 6_000_000
ROOM = 300_000
MARKS = np.array([0x2545F4914F6CDD1D, 0xB5297A4D3F84D5B5, 0x9E6C63D0876A9A47], np.uint64)  # a blank, the start and the end among hashes of words
FIRST, LAST = MARKS[1:]
SHARD_WORDS = 1_500_000
PASSES = 3
BLOCK = 2_000_000
VOCABULARY = 2_000_000
LONG = 64  # bytes of a long word
FREQUENT = 1 << 21  # words that records give by rank
SLOTS = 1 << 28  # bits of the bitmap of what the model holds


def _counter(order: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """N-grams of a task's words."""
        words: Counter = Counter()

        def counted() -> pa.RecordBatch:
            grams: dict[str, int] = {}
            for w, k in words.items():
                s = START * (order - 1) + w + END
                for i in range(len(w) + 1):
                    g = s[i : i + order]
                    grams[g] = grams.get(g, 0) + k
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], ["gram", "k"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                words.update(text.split())
            if len(words) > 400_000:
                yield counted()
        yield counted()

    return count


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from counts of counts, kept between 0 and the count."""
    if not n1 or not n2:
        return 0.5, 0.75, 1.0
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), c - 0.05) for c, d in enumerate(raw, 1))


def estimate(rows: DataFrame, order: int = ORDER) -> tuple[DataFrame, float]:
    """(n, gram, logp, weight) rows and the log probability of an unseen character.

    ``logp`` is set where the gram was seen as an n-gram, ``weight`` (the log of
    the share left to shorter contexts) where it is a context of n-grams.
    """
    counts = {order: saved(rows.select("text").mapInArrow(_counter(order), "gram string, k bigint").groupBy("gram").agg(F.sum("k").alias("k")))}
    for n in range(order - 1, 0, -1):
        counts[n] = counts[n + 1].groupBy(F.substring("gram", 2, n).alias("gram")).agg(F.count("*").alias("k"))
    letters = counts[1].count() + 1
    below, parts, unseen = None, [], math.log(1 / letters)
    for n in range(1, order + 1):
        c = counts[n]
        of = c.agg(*[F.count_if(F.col("k") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
        d = discounts(*(of[f"n{i}"] or 0 for i in (1, 2, 3, 4)))
        off = F.when(F.col("k") == 1, d[0]).when(F.col("k") == 2, d[1]).otherwise(d[2])
        head = F.substring("gram", 1, n - 1)
        context = c.groupBy(head.alias("context")).agg(F.sum("k").alias("total"), (F.sum(off) / F.sum("k")).alias("left"))
        seen = c.withColumn("context", head).join(context, "context")
        if n == 1:
            first = context.select("left").first()
            if first is None:
                break
            unseen = math.log(first["left"] / letters)
            p = seen.select("gram", ((F.col("k") - off) / F.col("total") + F.col("left") / letters).alias("p"))
        else:
            lower = below.withColumnRenamed("gram", "tail").withColumnRenamed("p", "q")
            seen = seen.withColumn("tail", F.substring("gram", 2, n - 1)).join(lower, "tail")
            p = seen.select("gram", ((F.col("k") - off) / F.col("total") + F.col("left") * F.col("q")).alias("p"))
            parts.append(context.select(F.lit(n).alias("n"), F.col("context").alias("gram"), F.lit(None).cast("double").alias("logp"), F.log("left").alias("weight")))
        below = saved(p)
        parts.append(below.select(F.lit(n).alias("n"), "gram", F.log("p").alias("logp"), F.lit(None).cast("double").alias("weight")))
    out = parts[0] if parts else rows.sparkSession.createDataFrame([], "n int, gram string, logp double, weight double")
    for part in parts[1:]:
        out = out.unionByName(part)
    return saved(out), unseen


class Shard:
    """Sorted n-gram keys with log probabilities and context keys with weights, by order."""

    def __init__(self, found: pa.Table, order: int, no: int, shards: int):
        self.order, self.no, self.shards = order, no, shards
        n, grams = found.column("n").to_numpy(), found.column("gram").to_pylist()
        self.logp, self.weight = {}, {}
        for which, name in ((self.logp, "logp"), (self.weight, "weight")):
            column = found.column(name).to_numpy(zero_copy_only=False).astype(np.float64)
            for k in range(1, order + 1):
                at = np.flatnonzero((n == k) & ~np.isnan(column))
                keys = keyed([grams[i] for i in at])
                order_of = np.argsort(keys)
                which[k] = keys[order_of], column[at][order_of]


def keyed(grams: list[str]) -> np.ndarray:
    """Keys of n-grams of one length."""
    if not grams:
        return np.zeros(0, np.uint64)
    codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(grams), -1)
    h = np.zeros(len(grams), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(codes.shape[1]):
            h = h * BASE + (codes[:, k].astype(np.uint64) + np.uint64(1))
        return h * MIX


def _shard_of(code: np.ndarray, shards: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((code.astype(np.uint64) * MIX) >> np.uint64(33)) % np.uint64(shards)


def _found(pairs: tuple[np.ndarray, np.ndarray], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, values = pairs
    if not len(keys) or not len(wanted):
        return np.zeros(len(wanted), np.bool_), np.zeros(len(wanted))
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return keys[at] == wanted, values[at]


def partial(words: list[str], shard: Shard, unseen: float) -> np.ndarray:
    """Sum of the log probabilities of each word's characters whose context ends in the shard."""
    order = shard.order
    pad = START * (order - 1)
    flat = np.frombuffer("".join(pad + w + END for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.cumsum(size + order - 1) - size
    word = np.repeat(np.arange(len(words)), size)
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    if shard.shards > 1:
        mine = _shard_of(flat[at - 1], shard.shards) == np.uint64(shard.no)
        at, word = at[mine], word[mine]
    total = np.zeros(len(at))
    left = np.arange(len(at))
    one = np.uint64(1)
    with np.errstate(over="ignore"):
        for n in range(order, 0, -1):
            context = np.zeros(len(left), np.uint64)
            for k in range(n - 1, 0, -1):
                context = context * BASE + (flat[at[left] - k] + one)
            gram = context * BASE + (flat[at[left]] + one)
            hit, value = _found(shard.logp[n], gram * MIX)
            total[left[hit]] += value[hit]
            left, context = left[~hit], context[~hit]
            if n > 1:
                hit, value = _found(shard.weight[n], context * MIX)
                total[left[hit]] += value[hit]
    total[left] += unseen
    return np.bincount(word, weights=total, minlength=len(words))


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of all texts as numbers, the distinct words by number, and how many words each text has.

    Arrow splits where ``str.split`` does, but leaves empty words at the ends.
    """
    lists = pc.utf8_split_whitespace(texts)
    words = lists.flatten().dictionary_encode()
    ids, of = words.indices.to_numpy(), pc.list_parent_indices(lists).to_numpy()
    distinct = words.dictionary
    no = pc.index(distinct, "").as_py()
    if no >= 0:
        of, ids = of[ids != no], ids[ids != no]
        ids = ids - (ids > no)
        distinct = pa.concat_arrays([distinct[:no], distinct[no + 1 :]])
    return ids, distinct, np.bincount(of, minlength=len(texts))


def _cuts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``CHARS`` characters."""
    size = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // CHARS
    cuts = np.flatnonzero(np.diff(size)) + 1
    return itertools.pairwise([0, *cuts.tolist(), len(texts)]) if len(texts) else iter(())


class Scorer:
    """Log probability and characters of texts; words are kept in a bounded table."""

    def __init__(self, shards: list, unseen: float, room: int = ROOM):
        self.shards, self.unseen, self.room = shards, unseen, room
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, 2))

    def learn(self, words: list[str]) -> None:
        if not words:
            return
        at, need = len(self.known), len(self.known) + len(words)
        if need > len(self.table):
            bigger = np.zeros((2 * need, 2))
            bigger[:at] = self.table[:at]
            self.table = bigger
        self.table[at:need, 0] = 0
        self.table[at:need, 1] = [len(w) + 1 for w in words]
        for shared in self.shards:
            self.table[at:need, 0] += partial(words, shared.value, self.unseen)
            if len(self.shards) > 1 and hasattr(shared, "_path"):
                del shared._value  # the next shard takes its place
        self.known.update(zip(words, range(at, need), strict=True))

    def score(self, texts: pa.Array) -> list[tuple[int, float | None, int]]:
        """(characters scored, perplexity, words) of each text."""
        if len(self.known) > self.room:
            self.known.clear()
        ids, distinct, n = split_words(texts)
        distinct = distinct.to_pylist()
        self.learn([w for w in distinct if w not in self.known])
        at = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[ids]
        text = np.repeat(np.arange(len(n)), n)
        logp, size = (np.bincount(text, weights=self.table[at, k], minlength=len(n)) for k in (0, 1))
        return [(int(z), math.exp(-x / z), w) if w else (0, None, 0) for x, z, w in zip(logp.tolist(), size.tolist(), n.tolist(), strict=True)]


def perplexities(docs: DataFrame, model: DataFrame, unseen: float, keep: tuple[str, ...], text: str = "text", order: int = ORDER, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``keep`` columns, n_scored, perplexity and n_words of each row."""
    spark = docs.sparkSession
    shards = max(1, -(-model.count() // shard_rows))
    if shards == 1:
        shared = [spark.sparkContext.broadcast(Shard(model.toArrow(), order, 0, 1))]
    else:
        # n-grams go by the character before their last one, contexts by their last one, single characters to all
        last = F.when(F.col("logp").isNotNull(), F.substring("gram", -2, 1)).otherwise(F.substring("gram", -1, 1))

        def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                code = np.array([ord(x) if x else 0 for x in batch.column("last").to_pylist()], np.uint32)
                yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("n", "gram", "logp", "weight")} | {"shard": pa.array(_shard_of(code, shards).astype(np.int64))})

        cut = saved(model.withColumn("last", last).mapInArrow(tagged, "n int, gram string, logp double, weight double, shard bigint"))
        shared = []
        for no in range(shards):
            part = cut.where((F.col("shard") == no) | (F.col("n") == 1)).drop("shard").toArrow()
            shared.append(spark.sparkContext.broadcast(Shard(part, order, no, shards)))
    rows = docs.select(*[F.col(k).alias(k) for k in keep], text_of(text).alias("__t"))
    head = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared, unseen)
        for batch in batches:
            texts = batch.column("__t")
            got = [x for a, b in _cuts(texts) for x in scorer.score(texts.slice(a, b - a))]
            cols = {k: batch.column(k) for k in keep}
            cols |= {"n_scored": pa.array([g[0] for g in got], pa.int64()), "perplexity": pa.array([g[1] for g in got], pa.float64()), "n_words": pa.array([g[2] for g in got], pa.int64())}
            yield pa.RecordBatch.from_pydict(cols)

    return rows.mapInArrow(run, f"{head}, n_scored bigint, perplexity double, n_words bigint")


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _turned(a, 21) ^ _turned(b, 42)


def packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays in few bytes: whole numbers in the narrowest type, or three planes of bytes, all compressed."""
    slim = []
    for x in arrays:
        if x.dtype.kind == "i" and len(x) and x.min() >= 0:
            x = x.astype(np.min_scalar_type(x.max()))
            if x.dtype == np.uint32 and x.max() < 1 << 24:
                x = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T[:3])
        slim.append(x)
    plain = pickle.dumps(slim, 5)
    return len(plain).to_bytes(8, "little") + pa.compress(plain, "zstd", asbytes=True)


def unpacked(body: bytes) -> list[np.ndarray]:
    out = pickle.loads(pa.decompress(body[8:], int.from_bytes(body[:8], "little"), "zstd", asbytes=True))
    return [x[0] | x[1].astype(np.int32) << 8 | x[2].astype(np.int32) << 16 if x.ndim == 2 else x for x in out]


def _of_word(v: np.ndarray, shards: int) -> np.ndarray:
    """The shard of n-grams with this middle word."""
    return _shard_of(v, shards).astype(np.int64)


def _recorder(shards: int, ranked, bits=None, passes: int = 1, turn: int = 0, block: int = BLOCK):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records (word before, word, word after) of the texts, packed by shard of the middle word.

        The mark of the start stands twice before a text and that of the end once after
        it. Frequent words go by rank, others by hash. With ``bits``, which show what the
        model holds, a record of an unknown word is left out, and a neighbour not seen
        beside the word is blank.
        """
        frequent, rank_of, in_order = ranked.value
        hashes, shard_of, codes = MARKS, _of_word(MARKS, shards), np.arange(3)
        held: list[tuple] = []
        size = before = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            u, v, w, text = (np.concatenate([h[k] for h in held]) for k in range(4))
            row, doc = (np.concatenate([h[k] for h in held]) for k in (4, 5))
            order_of = np.argsort(shard_of.astype(np.min_scalar_type(shards))[v], kind="stable")
            u, v, w, text = u[order_of], v[order_of], w[order_of], text[order_of]
            shard = shard_of[v]
            cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True]))) if len(v) else []
            for a, b in itertools.pairwise(cuts):
                here = np.zeros(len(hashes), np.bool_)
                for x in (u, v, w):
                    here[x[a:b]] = True
                here &= codes < 0
                to = np.where(codes < 0, np.cumsum(here) + (len(frequent) + 2), codes)
                t = text[a:b]
                at = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
                ids = t[at]
                body = packed([hashes[here], to[u[a:b]], to[v[a:b]], to[w[a:b]], np.diff(np.append(at, b - a)), row[ids].view(np.uint64), *([] if bits else [doc[ids].view(np.uint64)])])
                yield pa.RecordBatch.from_arrays([pa.array([shard[a]], pa.int64()), pa.array([bits is None]), pa.array([body], pa.binary())], ["s", "mine", "body"])

        for batch in batches:
            texts = batch.column("text")
            row, doc = batch.column("row").to_numpy(), batch.column("doc").to_numpy()
            for a, b in _cuts(texts):
                ids, distinct, n = split_words(texts.slice(a, b - a))
                fresh, first = hashed(distinct), len(hashes)
                at = np.searchsorted(in_order, fresh)
                at[at == len(in_order)] = 0
                hashes, shard_of = np.concatenate([hashes, fresh]), np.concatenate([shard_of, _of_word(fresh, shards)])
                codes = np.concatenate([codes, np.where(in_order[at] == fresh, rank_of[at] + 3, -1)])
                flat = np.ones(n.sum() + 3 * len(n), np.int32)
                flat[np.cumsum(n + 3) - 1] = 2
                text = np.repeat(np.arange(len(n)), n)
                flat[np.arange(len(text)) + 3 * text + 2] = ids + first
                text = np.repeat(np.arange(len(n)), n + 1)
                at = np.arange(len(text)) + 2 * text + 1
                if passes > 1:
                    in_turn = shard_of[flat[at]] % passes == turn
                    at, text = at[in_turn], text[in_turn]
                if bits:
                    there = (flat[at] < 3) | bits.value.holds(hashes * MIX, shard_of)[flat[at]]
                    at, text = at[there], text[there]
                u, v, w = flat[at - 1], flat[at], flat[at + 1]
                if bits:
                    start = (u == 1) & (v == 1)
                    u = np.where(start | bits.value.holds(_pair(hashes[u], hashes[v]), shard_of[u]), u, 0)
                    w = np.where((w == 2) | bits.value.holds(_pair(hashes[v], hashes[w]), shard_of[v]), w, 0)
                held.append((u, v, w, (text + before).astype(np.int32), row[a:b], doc[a:b]))
                before += b - a
                size += len(at)
                if size > block or len(hashes) > VOCABULARY:
                    yield from flushed()
                    held.clear()
                    hashes, shard_of, codes = hashes[:3], shard_of[:3], codes[:3]
                    size = before = 0
        if held:
            yield from flushed()
        tidied()

    return run


class Bits:
    """A bitmap of what the model holds; every shard has its own part of it."""

    def __init__(self, parts: dict[int, bytes], shards: int, room: int):
        self.room = room
        self.bits = np.zeros((shards, room // 8), np.uint8)
        for shard, part in parts.items():
            self.bits[shard] = np.frombuffer(part, np.uint8)
        self.bits = self.bits.ravel()

    def holds(self, keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
        slot = (keys % np.uint64(self.room)).astype(np.int64)
        return self.bits[shard * (self.room // 8) + (slot >> 3)] >> (slot & 7).astype(np.uint8) & 1 > 0


def _room(shards: int, slots: int = SLOTS) -> int:
    return max(8, slots // shards // 8 * 8)


def hashed(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words: a byte of all words at a time, long words one by one."""
    words = words.cast(pa.string())
    out = np.full(len(words), FIRST, np.uint64)
    if not len(words):
        return out
    start = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    size = np.diff(start)
    order_of = np.argsort(size, kind="stable")
    size, start = size[order_of], start[:-1][order_of]
    h = out.copy()
    end = np.searchsorted(size, LONG, "right")
    with np.errstate(over="ignore"):
        for i in range(LONG):
            at = np.searchsorted(size, i, "right")
            if at >= end:
                break
            x = (h[at:end] ^ (data[start[at:end] + i].astype(np.uint64) + np.uint64(1))) * MIX
            h[at:end] = x ^ x >> np.uint64(29)
        h = (h ^ size.astype(np.uint64)) * BASE
        h ^= h >> np.uint64(32)
        h *= MIX
    for i in range(end, len(size)):
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : start[i] + size[i]].tobytes(), digest_size=8).digest(), "little")
    out[order_of] = h ^ h >> np.uint64(31)
    return out


class Grouped:
    """Rows by key: sorted keys, a row of each, its group's number, and least and greatest document by group."""

    def __init__(self, key: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        order_of = np.argsort(key)
        sorted_key = key[order_of]
        at = np.flatnonzero(np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))) if len(key) else np.zeros(0, np.int64)
        self.keys, self.first = sorted_key[at], order_of[at]
        self.size = np.diff(np.append(at, len(key)))
        self.of = np.empty(len(key), np.int64)
        self.of[order_of] = np.repeat(np.arange(len(at)), self.size)
        self.lo, self.hi = (np.minimum.reduceat(lo[order_of], at), np.maximum.reduceat(hi[order_of], at)) if len(key) else (lo, hi)

    def total(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, weights=values, minlength=len(self.keys))


class Grams:
    """Trigrams of a shard's trusted records, and the bigrams that end them (a word in the middle has all its n-grams in one shard)."""

    def __init__(self, bodies: list[bytes], frequent: np.ndarray):
        key, head, tail, last, middle, docs, self.rows, self.row, self.inside = [], [], [], [], [], [], [], [], []
        at = 0
        for body in bodies:
            rare, u, v, w, per_row, row, doc = unpacked(body)
            of = np.concatenate([MARKS, frequent, rare])
            u, v, w = of[u], of[v], of[w]
            middle.append(v)
            self.rows.append(row)
            self.row.append(np.repeat(np.arange(at, at + len(row)), per_row))
            at += len(row)
            inside = w != LAST
            self.inside.append(inside)
            u, v, w = u[inside], v[inside], w[inside]
            key.append(u ^ _pair(v, w))
            head.append(_pair(u, v))
            tail.append(_pair(v, w))
            last.append(w)
            docs.append(np.repeat(doc, per_row)[inside])
        joined = lambda x: np.concatenate([np.zeros(0, np.uint64), *x])
        doc, self.v = joined(docs), joined(middle)
        self.inside = np.concatenate([np.zeros(0, np.bool_), *self.inside])
        self.rows, self.row = joined(self.rows), np.concatenate([np.zeros(0, np.int64), *self.row])
        self.three = Grouped(joined(key), doc, doc)
        del key, doc, docs
        pick = self.three.first
        self.head = joined(head)[pick]
        self.two = Grouped(joined(tail)[pick], self.three.lo, self.three.hi)
        pick = pick[self.two.first]
        self.last, self.middle = joined(last)[pick], self.v[self.inside][pick]


def _gatherer(shards: int, ranked):
    def run(found: pa.Table) -> pa.Table:
        """A shard's part of the counts of words (packed by the words' own shards), how many of its n-grams have each small count, and its part of the bitmap."""
        grams = Grams(found.column("body").to_pylist(), ranked.value[0])
        few = [np.bincount(np.minimum(g.size, 5), minlength=6)[1:5].tolist() for g in (grams.three, grams.two)]
        one = Grouped(grams.last, grams.two.lo, grams.two.hi)
        words = np.setdiff1d(grams.v, [FIRST])
        bits = np.zeros(_room(shards), np.bool_)
        for keys in (words * MIX, grams.two.keys):
            bits[keys % np.uint64(len(bits))] = True
        own = _of_word(one.keys, shards)
        order_of = np.argsort(own, kind="stable")
        to, cuts = np.unique(own[order_of], return_index=True)
        alone = one.lo == one.hi
        lo, hi = np.where(alone, one.lo, np.uint64(0)), np.where(alone, np.uint64(0), ~np.uint64(0))
        bodies = [packed([x[at] for x in (one.keys, one.size, lo, hi)]) for at in np.split(order_of, cuts[1:])] if len(to) else []
        shard = found.column("s")[0].as_py()
        tidied()
        out = {"s": [shard], "n3": [few[0]], "n2": [few[1]], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()), "own": [to.tolist()], "bodies": pa.array([bodies], pa.list_(pa.binary()))}
        return pa.table(out)

    return run


def _counted_words(parts: pa.Table, spelt: pa.Table) -> pa.Table:
    """Counts of a shard's own words over all shards, with the words' spelling and the shards that need them."""
    found = [unpacked(x) for x in parts.column("body").to_pylist()]
    if not found:
        return pa.table({"own": pa.array([], pa.int64()), "n1": pa.array([], pa.list_(pa.int64())), "body": pa.array([], pa.binary())})
    w, k, lo, hi = (np.concatenate([f[i] for f in found]) for i in range(4))
    hi = np.where(hi > 0, hi, lo)  # a word of several documents has 0 and the greatest number
    of_shard = np.repeat(parts.column("s").to_numpy(), [len(f[0]) for f in found])
    words = Grouped(w, lo, hi)
    k = words.total(k).astype(np.int64)
    keys = spelt.column("w").to_numpy().view(np.uint64)
    order_of = np.argsort(keys)
    logp = spelt.column("spelt").to_numpy()[order_of][np.searchsorted(keys[order_of], words.keys)]
    few = np.bincount(np.minimum(k, 5), minlength=6)[1:6].tolist() + [int(k.sum())]
    body = packed([words.keys, k, words.lo < words.hi, logp, words.of, of_shard])
    tidied()
    return pa.table({"own": [parts.column("own")[0].as_py()], "n1": [few], "body": pa.array([body], pa.binary())})


def _sender(off: tuple, mass: float, left: float, passes: int, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Probabilities and gains of words, packed by the shards that need them; a gain goes to the word's own shard."""
        for batch in batches:
            for own, body in zip(batch.column("own").to_pylist(), batch.column("body").to_pylist(), strict=True):
                w, k, many, spelt, of, shard = unpacked(body)
                over, q = (k - _lowered(k, off)) / mass, np.exp(spelt)
                with np.errstate(divide="ignore", over="ignore"):
                    # a long word may be too rare for a double; the log of its odds is not
                    gain = np.where(q > 1e-290, np.log1p(over / q), np.log(over) - spelt)
                p = (over + q) * math.exp(left)
                for s in np.union1d(shard, [own]):
                    if s % passes == turn:
                        at = of[shard == s] if s != own else np.arange(len(w))
                        body = packed([w[at], p[at]] + ([gain, many] if s == own else []))
                        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([body], pa.binary())], ["s", "body"])

    return run


def _lowered(k: np.ndarray, off: tuple[float, float, float]) -> np.ndarray:
    return np.array((0.0, *off))[np.minimum(k, 3)]


def _gainer(off3: tuple, off2: tuple, ranked):
    def run(records: pa.Table, words: pa.Table) -> pa.Table:
        """What the n-grams with their middle word in this shard, and these words, add to the log probability of each row."""
        mine = records.column("mine").to_pylist()
        bodies = records.column("body").to_pylist()
        grams = Grams([x for x, m in zip(bodies, mine, strict=True) if m], ranked.value[0])
        no = [np.zeros(0, np.uint64), np.zeros(0)]
        sent = [unpacked(x) for x in words.column("body").to_pylist()]
        p1 = _ordered(*(np.concatenate([no[i], *[x[i] for x in sent]]) for i in (0, 1)))
        home = next((x for x in sent if len(x) > 2), [*no, no[1], np.zeros(0, np.bool_)])
        two, three = grams.two, grams.three
        low2, low3 = _lowered(two.size, off2), _lowered(three.size, off3)
        one, ahead = Grouped(grams.middle, two.lo, two.hi), Grouped(grams.head, three.lo, three.hi)
        mass1, mass2 = one.total(low2), ahead.total(low3)
        weight1, weight2 = np.log(mass1 / one.total(two.size)), np.log(mass2 / ahead.total(three.size))
        q = _found(p1, grams.last)[1]
        over = (two.size - low2) / mass1[one.of]
        gain2 = np.log1p(over / q)
        p2 = np.exp(weight1)[one.of] * (over + q)
        gain3 = np.log1p((three.size - low3) / mass2[ahead.of] / p2[two.of])
        shared = [np.where(g.lo < g.hi, x, 0.0) for g, x in ((one, weight1), (ahead, weight2), (two, gain2), (three, gain3))]
        alone = shared[0][one.of][two.of] + shared[1][ahead.of] + shared[2][two.of] + shared[3]
        sums = _sought(_ordered(home[0], np.where(home[3], home[2], 0.0)), grams.v)[1]
        sums[grams.inside] += alone[three.of]
        rows, gained = [grams.rows], [np.bincount(grams.row, weights=sums, minlength=len(grams.rows))]
        gain1 = _ordered(home[0], home[2])
        for m, body in zip(mine, bodies, strict=True):
            if m:
                continue
            rare, u, v, w, per_row, row = unpacked(body)
            of = np.concatenate([MARKS, ranked.value[0], rare])
            here = np.zeros(len(of), np.bool_)
            here[v] = True
            ids = np.flatnonzero(here)
            by_word = np.zeros((2, len(of)))
            by_word[0, ids], by_word[1, ids] = _sought(gain1, of[ids])[1], _sought((one.keys, weight1), of[ids])[1]
            sums = by_word[0][v] + np.where(w != 2, by_word[1][v], 0.0)
            at = np.flatnonzero((u > 0) & (w != 2))
            sums[at] += _sought((ahead.keys, weight2), _pair(of[u[at]], of[v[at]]))[1]
            at = np.flatnonzero((w > 0) & (w != 2))
            tail = _pair(of[v[at]], of[w[at]])
            sums[at] += _sought((two.keys, gain2), tail)[1]
            longer = u[at] > 0
            at = at[longer]
            sums[at] += _sought((three.keys, gain3), of[u[at]] ^ tail[longer])[1]
            rows.append(row)
            gained.append(np.bincount(np.repeat(np.arange(len(row)), per_row), weights=sums, minlength=len(row)))
        rows = np.concatenate(rows)
        of_row = Grouped(rows, rows, rows)
        out = pa.table({"row": of_row.keys.view(np.int64), "gained": of_row.total(np.concatenate(gained))})
        tidied()
        return out

    return run


def _ordered(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order_of = np.argsort(keys)
    return keys[order_of], values[order_of]


def _sought(pairs: tuple[np.ndarray, np.ndarray], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_found`` for many keys: in order of the keys, which goes through memory once; 0 where there is none."""
    order_of = np.argsort(wanted)
    hit, value = np.empty(len(wanted), np.bool_), np.empty(len(wanted))
    hit[order_of], value[order_of] = _found(pairs, wanted[order_of])
    return hit, np.where(hit, value, 0.0)


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of a task's words, the words, and how often they are there."""
    words: Counter = Counter()

    def counted() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(hashed(pa.array(list(words), pa.string())).view(np.int64)), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["w", "word", "n"])
        words.clear()
        return out

    for batch in batches:
        texts = batch.column("text")
        for a, b in _cuts(texts):
            ids, distinct, _ = split_words(texts.slice(a, b - a))
            for x, k in zip(distinct.to_pylist(), np.bincount(ids, minlength=len(distinct)).tolist(), strict=True):
                words[x] += k
            if len(words) > ROOM:
                yield counted()
    yield counted()


def _freed(spark: SparkSession) -> None:
    """Let go of finished steps, the last one too: the scheduler holds that until another job has run, and py4j's thread lets go of what Python dropped a little later."""
    gc.collect()
    time.sleep(2)
    spark.range(1).count()
    released(spark)


def word_gains(marked: DataFrame, characters: DataFrame, unseen: float, order: int, shard_rows: int, shard_words: int = SHARD_WORDS, passes: int = PASSES) -> tuple[DataFrame | None, float]:
    """(row, gained) of the rows of ``marked`` (row, doc, mine, text), and the log of the share left to characters.

    ``gained`` is what the model of words, which learns from the rows that are
    ``mine``, adds to the log probability of a row by its characters: a gain for
    each seen n-gram over its shorter form, and the log of the share that each seen
    context leaves. For rows that are ``mine`` only n-grams of several documents count.
    """
    spark = marked.sparkSession
    learning = marked.where("mine")
    vocabulary = learning.select("text").mapInArrow(_vocabulary, "w bigint, word string, n bigint").groupBy("w").agg(F.min("word").alias("word"), F.sum("n").alias("n"))
    spelt = saved(perplexities(vocabulary, characters, unseen, ("w", "n"), "word", order, shard_rows).select("w", "n", (-F.col("n_scored") * F.log("perplexity")).alias("spelt")))
    del vocabulary
    _freed(spark)
    n_words = spelt.agg(F.sum("n")).first()[0]
    if not n_words:
        return None, 0.0
    shards = -(-n_words // shard_words)
    top = spelt.orderBy(F.desc("n"), "w").limit(FREQUENT).select("w").toArrow()
    top = top.column("w").to_numpy().view(np.uint64)
    rank_of = np.argsort(top).astype(np.int32)
    ranked = spark.sparkContext.broadcast((top, rank_of, top[rank_of]))
    packs = "s bigint, mine boolean, body binary"
    known = saved(learning.select("row", "doc", "text").mapInArrow(_recorder(shards, ranked), packs))
    counted = "s bigint, n3 array<bigint>, n2 array<bigint>, bits binary, own array<bigint>, bodies array<binary>"
    gathered, steps, counts = None, [], []
    for turn in range(passes):
        part = saved(known.where(F.col("s") % passes == turn).groupBy("s").applyInArrow(_gatherer(shards, ranked), counted))
        steps.append(part)
        gathered = part if gathered is None else gathered.unionByName(part)
        del part
        _freed(spark)
    of = gathered.agg(*[F.sum(F.col(x)[i]).alias(f"{x}_{i}") for x in ("n3", "n2") for i in range(4)]).first()
    off3, off2 = (discounts(*(of[f"{x}_{i}"] for i in range(4))) for x in ("n3", "n2"))
    bits = spark.sparkContext.broadcast(Bits({r["s"]: r["bits"] for r in gathered.select("s", "bits").toLocalIterator()}, shards, _room(shards)))
    parts = gathered.select("s", F.explode(F.arrays_zip("own", "bodies")).alias("x")).select("s", F.col("x.own").alias("own"), F.col("x.bodies").alias("body"))
    own = spelt.mapInArrow(_dealer(shards), "own bigint, w bigint, spelt double")
    words = None
    for turn in range(passes):
        ours = F.col("own") % passes == turn
        part = parts.where(ours).groupBy("own").cogroup(own.where(ours).groupBy("own")).applyInArrow(_counted_words, "own bigint, n1 array<bigint>, body binary")
        part = saved(part)
        counts.append(part)
        words = part if words is None else words.unionByName(part)
        del part
        _freed(spark)
    n1, n2, n3, n4, more, total = words.agg(*[F.sum(F.col("n1")[i]) for i in range(6)]).first()
    off1 = discounts(n1, n2, n3, n4)
    mass = n1 * off1[0] + n2 * off1[1] + (n3 + n4 + more) * off1[2]
    left = math.log(mass / total)
    for done in (spelt, *steps):
        dropped(done)
    del gathered, parts, own
    _freed(spark)
    sums = None
    for turn in range(passes):
        asked = marked.where("not mine").select("row", "doc", "text").mapInArrow(_recorder(shards, ranked, bits, passes, turn), packs)
        records = known.where(F.col("s") % passes == turn).unionByName(asked)
        sent = words.select("own", "body").mapInArrow(_sender(off1, mass, left, passes, turn), "s bigint, body binary")
        gains = records.groupBy("s").cogroup(sent.groupBy("s")).applyInArrow(_gainer(off3, off2, ranked), "row bigint, gained double")
        part = saved(gains.groupBy("row").agg(F.sum("gained").alias("gained")))
        sums = part if sums is None else sums.unionByName(part)
        del asked, records, sent, gains, part
        _freed(spark)  # the records of a turn are the most that is held at once
    for done in (known, *counts):
        dropped(done)
    return sums.groupBy("row").agg(F.sum("gained").alias("gained")), left


def _dealer(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _of_word(batch.column("w").to_numpy().view(np.uint64), shards)
            yield pa.RecordBatch.from_arrays([pa.array(own), batch.column("w"), batch.column("spelt")], ["own", "w", "spelt"])

    return run


def word_perplexities(held: DataFrame, trusted: DataFrame, characters: DataFrame, unseen: float, order: int, shard_rows: int, shard_words: int = SHARD_WORDS, passes: int = PASSES) -> DataFrame:
    """doc_id, lang, n_scored (words) and perplexity of each row under the model of words."""
    row = F.xxhash64("doc_id", "text")  # copies of a row have one score
    marked = held.where("text is not null").join(trusted.withColumn("mine", F.lit(True)), "doc_id", "left")
    marked = marked.select(row.alias("row"), F.xxhash64("doc_id").alias("doc"), F.coalesce("mine", F.lit(False)).alias("mine"), "text")
    sums, left = word_gains(marked, characters, unseen, order, shard_rows, shard_words, passes)
    base = saved(perplexities(held.withColumn("row", row), characters, unseen, ("doc_id", "lang", "row"), order=order, shard_rows=shard_rows))
    extra = base.groupBy("row").agg(F.count("*").alias("copies"))
    extra = extra.join(sums, "row") if sums is not None else extra.withColumn("gained", F.lit(0.0))
    spelt = -F.col("n_scored") * F.log("perplexity") + F.col("n_words") * left
    logp = spelt + F.coalesce(F.col("gained") / F.col("copies"), F.lit(0.0))
    return base.join(extra, "row", "left").select("doc_id", "lang", F.col("n_words").alias("n_scored"), F.exp(-logp / F.col("n_words")).alias("perplexity"))


def quality_classifier(
    docs: DataFrame,
    labels: DataFrame,
    quantile: float = QUANTILE,
    order: int = ORDER,
    trusted_bound: int = TRUSTED_BOUND,
    shard_rows: int = SHARD_ROWS,
    words: bool = False,
    shard_words: int = SHARD_WORDS,
    passes: int = PASSES,
) -> DataFrame:
    """doc_id, lang, n_scored, perplexity, threshold and kept of each row of ``docs`` (doc_id, lang, text); labels have doc_id and quality.

    With ``words`` the model is the one over word sequences and counts words;
    without, the one over characters alone that it falls back on.
    """
    trusted = saved(labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct())
    few = trusted.count() <= trusted_bound
    held = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    learning = held.where("text is not null").join(F.broadcast(trusted) if few else trusted, "doc_id", "left_semi")
    model, unseen = estimate(learning, order)
    if words:
        scored = saved(word_perplexities(held, F.broadcast(trusted) if few else trusted, model, unseen, order, shard_rows, shard_words, passes))
    else:
        scored = saved(perplexities(held, model, unseen, ("doc_id", "lang"), order=order, shard_rows=shard_rows))
    good = scored.where("perplexity is not null").join(F.broadcast(trusted) if few else trusted, "doc_id", "left_semi")
    by_lang = good.groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("t"))
    overall = good.agg(F.percentile_approx("perplexity", quantile, 10_000).alias("o"))
    out = scored.join(by_lang.withColumnRenamed("lang", "__lang"), F.col("lang").eqNullSafe(F.col("__lang")), "left").crossJoin(F.broadcast(overall))
    limit = F.coalesce("t", "o")
    return out.select(
        "doc_id",
        "lang",
        "n_scored",
        "perplexity",
        limit.alias("threshold"),
        (F.col("perplexity").isNotNull() & (limit.isNull() | (F.col("perplexity") <= limit))).alias("kept"),
    )


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), words=True)
