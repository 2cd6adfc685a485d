"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words are numbered and their generalised suffix automaton is built
once. Each text is then streamed through it, word by word, tracking the longest
matching length. A window is ``window`` consecutive words of an item, or a whole
item that is shorter; a position whose match is as long as a window ends one.

A run filter skips stretches that cannot hold a match: a match of m words needs
m - 1 consecutive pairs of neighbouring words that are neighbours in some item.

The items travel as broadcasts in blocks of at most ``block_words`` words, so
what one task holds has a fixed bound. With several blocks the texts are read
once per block and only the hits, without the texts, are merged.

Defined results: words of null or empty texts are none; an item without words
has no window; with no items nothing is hit. Repeated rows each get their own
result. Item ids are compared as strings; a null item id is the empty string.
Items with equal texts all count. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import lightened, saved, table, tidied

WINDOW = 10
BLOCK_WORDS = 200_000

#: Bytes of words stay (digits, small letters, all above 7F), capitals are lowered, all others part words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text in order, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Automaton:
    """Generalised suffix automaton over numbered words, with what the windows need."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        for _, words in items:
            for w in words:
                self.vocab.setdefault(w, len(self.vocab))
        self.base = max(1, len(self.vocab))
        self.next: dict[int, int] = {}
        self.link, self.length = [-1], [0]
        self._arcs: list[dict[int, int]] = [{}]
        coded = [(item, [self.vocab[w] for w in words]) for item, words in items if words]
        for _, ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        for state, arcs in enumerate(self._arcs):
            for c, to in arcs.items():
                self.next[state * self.base + c] = to
        del self._arcs
        self._mark(coded)
        pairs = {a * self.base + b for _, ids in coded for a, b in zip(ids, ids[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self.least = min((min(len(ids), window) for _, ids in coded), default=0)

    def _extend(self, last: int, c: int) -> int:
        arcs, link, length = self._arcs, self.link, self.length
        if c in arcs[last]:
            q = arcs[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        cur = len(length)
        length.append(length[last] + 1)
        link.append(0)
        arcs.append({})
        p = last
        while p != -1 and c not in arcs[p]:
            arcs[p][c] = cur
            p = link[p]
        if p != -1:
            q = arcs[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c: int, q: int) -> int:
        arcs, link, length = self._arcs, self.link, self.length
        copy = len(length)
        length.append(length[p] + 1)
        link.append(link[q])
        arcs.append(dict(arcs[q]))
        link[q] = copy
        while p != -1 and arcs[p].get(c) == q:
            arcs[p][c] = copy
            p = link[p]
        return copy

    def _mark(self, coded: list[tuple[str, list[int]]]) -> None:
        """For each state: the state of its suffix of ``window`` words, and the nearest state up the links that is a whole short item."""
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        self.top = [-1] * len(self.length)
        for v in order:
            if self.length[v] >= self.window:
                self.top[v] = v if self.length[self.link[v]] < self.window else self.top[self.link[v]]
        self.items: dict[int, list[str]] = {}
        self.short: dict[int, tuple[int, list[str]]] = {}
        for item, ids in coded:
            state = 0
            seen = set()
            for k, c in enumerate(ids, 1):
                state = self.next[state * self.base + c]
                if k >= self.window and self.top[state] not in seen:
                    seen.add(self.top[state])
                    self.items.setdefault(self.top[state], []).append(item)
            if len(ids) < self.window:
                self.short.setdefault(state, (len(ids), []))[1].append(item)
        self.up = [-1] * len(self.length)
        for v in order[1:]:
            self.up[v] = self.link[v] if self.link[v] in self.short else self.up[self.link[v]]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit stretches of word positions (start, end exclusive), merged and in order, and the items that occur."""
        if not self.least or not words:
            return [], set()
        ids = np.fromiter(map(self.vocab.get, words, _NONE), np.int64, len(words))
        spans: list[list[int]] = []
        found: set[str] = set()
        for lo, hi in self._runs(ids):
            self._stream(ids[lo:hi].tolist(), lo, spans, found)
        return [(a, b) for a, b in spans], found

    def _runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of words in which a match of the least length can lie."""
        if self.least == 1:
            good, need = ids >= 0, 1
        else:
            if len(ids) < self.least:
                return []
            key = ids[:-1] * self.base + ids[1:]
            at = np.searchsorted(self.pairs, key)
            at[at == len(self.pairs)] = 0
            good = (ids[:-1] >= 0) & (ids[1:] >= 0) & (self.pairs[at] == key)
            need = self.least - 1
        edge = np.flatnonzero(np.diff(np.concatenate(([0], good.astype(np.int8), [0]))))
        starts, ends = edge[::2], edge[1::2]
        keep = ends - starts >= need
        return list(zip(starts[keep].tolist(), (ends[keep] + (self.least > 1)).tolist(), strict=True))

    def _stream(self, ids: list[int], at: int, spans: list[list[int]], found: set[str]) -> None:
        nxt, link, length, base, window = self.next, self.link, self.length, self.base, self.window
        state = matched = 0
        for pos, c in enumerate(ids, at + 1):
            to = nxt.get(state * base + c)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = nxt.get(state * base + c)
            if to is None:
                matched = 0
                continue
            state = to
            matched += 1
            reach = 0
            if matched >= window:
                reach = window
                found.update(self.items[self.top[state]])
            v = state if state in self.short else self.up[state]
            while v != -1:
                size, items = self.short[v]
                if size <= matched:
                    found.update(items)
                    reach = max(reach, size)
                v = self.up[v]
            if reach:
                start = pos - reach
                while spans and spans[-1][0] >= start:
                    spans.pop()
                if spans and spans[-1][1] >= start:
                    spans[-1][1] = pos
                else:
                    spans.append([start, pos])


class _Nones:
    """Endless -1: the number of a word that no item has."""

    def __iter__(self):
        return self

    def __next__(self):
        return -1


_NONE = _Nones()


def blocks_of(items: DataFrame, item_id: str, text: str, block_words: int, window: int) -> list[Automaton]:
    """Automata of the items, each of a bounded number of words. Items stream to the driver one partition at a time."""
    out, part, size = [], [], 0
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(text).cast("string").alias("t"))
    for row in rows.toLocalIterator():
        words = words_of(row["t"])
        if part and size + len(words) > block_words:
            out.append(Automaton(part, window))
            part, size = [], 0
        part.append((row["i"], words))
        size += len(words)
    return [*out, Automaton(part, window)]


HITS = "n_words bigint, hits array<struct<start:int,end:int>>, items array<string>"
_HIT = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _scanner(shared, name: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            n_words, hits, items = [], [], []
            for text in cols.pop("__t").to_pylist():
                words = words_of(text)
                spans, found = automaton.hits(words)
                n_words.append(len(words))
                hits.append([{"start": a, "end": b} for a, b in spans])
                items.append(sorted(found))
            cols |= {"n_words": pa.array(n_words, pa.int64()), "hits": pa.array(hits, _HIT), "items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_pydict(cols)
        tidied()

    scan.__name__ = name
    return scan


def benchmark_hits(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``keep`` columns, n_words, hits (stretches of word positions) and items of each row. Nothing is shuffled when the items fit one block."""
    spark = docs.sparkSession
    lightened(spark)
    blocks = blocks_of(items, item_id, item_text, block_words, window)
    rows = docs.select(*[F.col(k).alias(k) for k in keep], F.col(text).cast("string").alias("__t"))
    head = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    if len(blocks) == 1:
        shared = spark.sparkContext.broadcast(blocks[0])
        return rows.mapInArrow(_scanner(shared, "stream_items"), f"{head}, {HITS}")
    rows = saved(rows).withColumn("__row", F.monotonically_increasing_id())
    parts = []
    for block in blocks:
        shared = spark.sparkContext.broadcast(block)
        part = rows.select("__row", "__t").mapInArrow(_scanner(shared, "stream_items"), f"__row bigint, {HITS}")
        parts.append(saved(part))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part.where(F.size("items") > 0))
    merged = merged.select("__row", "n_words", "hits", "items")
    # stretches that touch those before them make one, without building arrays step by step
    each = merged.select("__row", F.explode("hits").alias("h")).select("__row", "h.start", "h.end")
    before = Window.partitionBy("__row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("fresh", (F.col("start") > F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int"))
    each = each.withColumn("no", F.sum("fresh").over(Window.partitionBy("__row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    each = each.groupBy("__row", "no").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    each = each.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("hits"))
    found = merged.groupBy("__row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    merged = found.join(each, "__row", "left").withColumn("hits", F.coalesce("hits", none))
    return rows.drop("__t").join(merged, "__row").select(*keep, "n_words", "hits", "items")


def n_hit():
    """Hit words: the lengths of the merged stretches."""
    return F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def cleaned(text: str, hits: list[tuple[int, int]]) -> str:
    """The text without its hit stretches; what stands between two kept words stays as it was, one space closes a gap."""
    data = text.encode("utf-8", "surrogatepass")
    folded = np.frombuffer(data.translate(_FOLD), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], folded.astype(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2]
    out, at = [], 0
    for a, b in hits:
        out.append(data[at : starts[a]])
        at = int(ends[b - 1])
    out.append(data[at:])
    return b" ".join(x for x in (y.strip() for y in out) if x).decode("utf-8", "surrogatepass")


def decontaminated(docs: DataFrame, items: DataFrame, max_words: int = 0, max_coverage: float = 0.5, **options) -> DataFrame:
    """``docs`` without the spans longer than ``max_words``, and without the rows of which more than ``max_coverage`` is hit.

    Keeps the columns of ``docs``; n_chars, if there, is counted anew for changed texts.
    """
    names = docs.columns
    text = options.get("text", "text")
    held = [c for c in names if c != text]
    renamed = docs.select(F.col(text).alias("__text"), F.struct(*[F.col(f"`{c}`") for c in held]).alias("__held") if held else F.lit(0).alias("__held"))
    found = benchmark_hits(renamed.select("__held", F.col("__text").alias("__body"), F.col("__text").alias("text")), items, keep=("__held", "__body"), **{k: v for k, v in options.items() if k != "text"})
    found = found.where(n_hit() <= max_coverage * F.greatest("n_words", F.lit(1)))
    found = found.withColumn("__long", F.filter("hits", lambda x: x["end"] - x["start"] > max_words))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, hits = batch.column("__body").to_pylist(), batch.column("__long").to_pylist()
            texts = [cleaned(t, [(h["start"], h["end"]) for h in x]) if x else t for t, x in zip(texts, hits, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("__held"), pa.array(texts, pa.string()), pa.array([bool(x) for x in hits])], ["__held", "__body", "__cut"])
        tidied()

    kind = found.schema["__held"].dataType.simpleString()
    out = found.select("__held", "__body", "__long").mapInArrow(cut, f"__held {kind}, __body string, __cut boolean")

    def column(c: str):
        if c == text:
            return F.col("__body").alias(c)
        if c == "n_chars":
            return F.when(F.col("__cut"), F.length("__body").cast(docs.schema[c].dataType)).otherwise(F.col(f"__held.`{c}`")).alias(c)
        return F.col(f"__held.`{c}`").alias(c)

    return out.select(*[column(c) for c in names])


FOLDED_SQL = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS_SQL = r"regexp_extract_all(" + FOLDED_SQL + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
HIT_SQL = f"""
doc3 AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS_SQL.format("text")} AS w FROM __docs),
item3 AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {WORDS_SQL.format("text")} AS w FROM benchmark),
win3 AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT item, w, least(len(w), {WINDOW}) AS m, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM item3 WHERE len(w) > 0)),
size3 AS (SELECT DISTINCT m FROM win3),
gram3 AS (SELECT rid, i, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc3, size3)),
occ3 AS (SELECT rid, i, m, item FROM gram3 JOIN win3 USING (m, g)),
hit3 AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT DISTINCT rid, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT rid, i, m FROM occ3)) GROUP BY rid),
its3 AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT rid, item FROM occ3) GROUP BY rid)
"""
ORACLE_SQL = f"""WITH {HIT_SQL.replace("__docs", "documents")}
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit3.n, 0) AS n_hit, coalesce(its3.n, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, hit3.n IS NOT NULL AS contaminated
FROM doc3 LEFT JOIN hit3 USING (rid) LEFT JOIN its3 USING (rid)"""
