"""N-gram Jaccard self-join with a count-vector R-tree.

A text is the set of its distinct 5-word shingles. Two texts are linked when
their sets' Jaccard similarity is at least 3/4. Equal sets form one class, and
only classes are compared; the result is the component of each document.

1. One scan gives each row's class (a fingerprint of the whole set) and the size
   of its set.
2. In any common order of shingles (frequent ones last) the first l shingles
   that a pair with similarity t shares lie among the first n - ceil(t n) + l of
   each set. These deal the classes out: shingle ranges are shards, and the
   classes that meet at a shingle and fit in size form a run. A class that meets
   others at fewer than l shingles has no partner and leaves. The order never
   changes which pairs are found, so the list of frequent shingles may be cut at
   a fixed length.
3. Runs with the same least class are put together as a group, and the whole sets
   of the classes left are fetched once. A task holds the sets of one group: their
   shingles hashed into ``GROUPS`` groups are points, the counts, in an R-tree,
   and the sum of coordinate minima of a point and a box bounds every overlap in
   the box. Surviving pairs are verified on the spot, best bounds first, and only
   pairs that are not in one component yet; a task gives out only links that join
   two components, so never more than it has members.
4. A group with more than ``CHUNK`` shingles is cut into parts by a hash. First
   each part is searched, then representatives of the components that the parts
   found, as long as these become much fewer, and at last all pairs of parts that
   hold members of different components. So the result is exact, and what a task
   holds is bounded, whatever the size of a group.

No link between different components is lost, and no group is expanded into all
pairs: members of one component are not compared again.

Defined results: null, empty and blank texts have no shingles, link with nothing
and are their own component; a text of fewer than five words is one shingle of
the whole sequence. Rows with equal texts, or with one doc_id twice, get a row
each. A component's id is its least doc_id that is not null. Extra columns are
ignored. An empty table gives an empty result. Fingerprints have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tessera.llm.common import lightened, released, saved, table, tasks, text_of, tidied
from tessera.llm.components import components
from tessera.llm.pieces import stretches

SHINGLE = 5
GROUPS = 128
CHARS = 4_000_000
#: A shingle seen in this many texts comes last in the order; at most HOT_LIST of them are listed.
HOT, HOT_LIST = 32, 200_000
SHARD_ROWS = 400_000
#: Shingles of one group that a task holds at most (twice as many where two parts meet).
CHUNK = 1_500_000
#: Partners of a member that are verified first; then four times as many, and so on.
CLOSE = 16
#: Representatives are compared again as long as a round leaves less than this share of them apart.
FEWER = 0.9
#: Lists of classes or groups up to this length are broadcast.
SHORT = 500_000
#: Bits for each wanted class of the bitmap that keeps other sets from being shuffled, and its greatest size (128 MB).
SIEVE, SIEVE_MOST = 16, 1 << 30

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    with np.errstate(over="ignore"):
        m = min(size, n)
        out = h[: n - m + 1].copy()
        for k in range(1, m):
            out = out * _P + h[k : n - m + 1 + k]
        out = (out ^ (out >> np.uint64(31))) * _Q + np.uint64(m)
        out = (out ^ (out >> np.uint64(29))) * _P
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def needed_meetings(n):
    """Shared shingles that a pair is sure to have among the dealt ones of a set of n."""
    return 1 + n // 8


def _sets(texts: list[str]) -> Iterator[tuple[np.ndarray, int]]:
    """(set, class) of each text; class 0 is the empty set."""
    for t in texts:
        s = shingles(t)
        yield s, (xxh3_64_intdigest(s.tobytes()) | 1) - (1 << 63) if len(s) else 0


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.astype(np.int64))


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text, and for each stretch a row of its repeated shingles."""
    for batch in batches:
        for a, b, texts in stretches(batch.column("__t"), CHARS):
            ids, sizes, own = [], [], {}
            for s, c in _sets(texts):
                ids.append(c)
                sizes.append(len(s))
                own.setdefault(c, s)
            token, count = np.unique(np.concatenate(list(own.values())), return_counts=True)
            often = count >= 3
            rows = b - a
            hot = pa.array([None] * rows + [[]], pa.list_(pa.int64()))
            hot = pa.concat_arrays([hot.slice(0, rows), pa.array([token[often].astype(np.int64)], pa.list_(pa.int64()))])
            times = pa.concat_arrays([pa.nulls(rows, pa.list_(pa.int64())), pa.array([count[often]], pa.list_(pa.int64()))])
            held = pa.concat_arrays([batch.column("__keep").slice(a, rows), pa.nulls(1, batch.column("__keep").type)])
            yield pa.RecordBatch.from_arrays([held, pa.array([*ids, None], pa.int64()), pa.array([*sizes, None], pa.int64()), hot, times], ["__keep", "c", "n", "hot", "times"])
    tidied()


def _dealer(shared, bits: int):
    """First shingles of each class in a stretch, packed by shard: 32 bits of the shingle, class and size."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for batch in batches:
            for _, _, texts in stretches(batch.column("__t"), CHARS):
                own = {}
                for s, c in _sets(texts):
                    if c:
                        own.setdefault(c, s)
                if not own:
                    continue
                size = np.fromiter(map(len, own.values()), np.int64, len(own))
                ids = np.fromiter(own, np.int64, len(own))
                flat, doc = np.concatenate(list(own.values())), np.repeat(np.arange(len(own)), size)
                start = np.cumsum(size) - size
                late = np.zeros(len(flat), np.bool_)
                if len(frequent):
                    at = np.searchsorted(frequent, flat)
                    at[at == len(frequent)] = 0
                    late = frequent[at] == flat
                before = np.cumsum(late) - late
                before -= before[start][doc]
                rank = np.where(late, (size - np.add.reduceat(late.astype(np.int64), start))[doc] + before, np.arange(len(flat)) - start[doc] - before)
                first = rank < (size - (3 * size + 3) // 4 + needed_meetings(size))[doc]
                flat, doc = flat[first], doc[first]
                order = np.argsort(flat)
                flat, doc = flat[order], doc[order]
                shard = (flat >> np.uint64(64 - bits)).astype(np.int64)
                token = ((flat << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
                edge = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True])))
                blobs = [token[i:j].tobytes() + ids[doc[i:j]].tobytes() + size[doc[i:j]].astype(np.int32).tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard[edge[:-1]]), pa.array(blobs, pa.binary())], ["shard", "packed"])
        tidied()

    return deal


def _mixed(c: np.ndarray) -> np.ndarray:
    h = c.astype(np.uint64) * _P
    return (h ^ (h >> np.uint64(32))) * _Q


def _runs(data: pa.Table) -> pa.Table:
    """Runs of a shard: classes that meet at a shingle, split where sizes don't fit. Runs with the same members have the same number."""
    token, c, n = [], [], []
    for blob in data.column("packed").to_pylist():
        k = len(blob) // 16
        token.append(np.frombuffer(blob, np.uint32, k))
        c.append(np.frombuffer(blob, np.int64, k, 4 * k))
        n.append(np.frombuffer(blob, np.int32, k, 12 * k))
    token, c, n = np.concatenate(token), np.concatenate(c), np.concatenate(n).astype(np.int64)
    # drop what meets nothing before the full sort
    order = np.argsort(token, kind="stable")
    same = token[order][1:] == token[order][:-1]
    order = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
    token, c, n = token[order], c[order], n[order]
    order = np.lexsort((c, n, token))
    token, c, n = token[order], c[order], n[order]
    if len(c):
        fresh = np.concatenate(([True], (token[1:] != token[:-1]) | (c[1:] != c[:-1])))
        token, c, n = token[fresh], c[fresh], n[fresh]
        first = np.concatenate(([True], (token[1:] != token[:-1]) | (4 * n[:-1] < 3 * n[1:])))
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, len(c)))
        with np.errstate(over="ignore"):
            number = (np.add.reduceat(_mixed(c), start) + size.astype(np.uint64)) * _P
        number = (number ^ (number >> np.uint64(29))).astype(np.int64)
        number = np.where(size > 1, number, 0)
        _, at, times = np.unique(number, return_index=True, return_counts=True)
        keep, weight = np.zeros(len(start), np.bool_), np.zeros(len(start), np.int64)
        keep[at], weight[at] = True, times
        keep &= size > 1
        member = np.repeat(keep, size)
        run, w = np.repeat(number, size)[member], np.repeat(weight, size)[member]
        c, n = c[member], n[member]
    else:
        run = w = c
    return pa.table({"run": _signed(run), "c": _signed(c), "n": _signed(n), "w": _signed(w)})


class RTree:
    """Packed R-tree over count vectors; a box is the coordinates' maxima and the least size of its points."""

    LEAF = 16

    def __init__(self, points: np.ndarray, size: np.ndarray):
        self.order = np.lexsort((*points.T[:4], size // 8))
        self.levels = [(points[self.order], size[self.order])]
        while len(self.levels[-1][0]) > self.LEAF:
            top, low = self.levels[-1]
            at = np.arange(0, len(top), self.LEAF)
            self.levels.append((np.maximum.reduceat(top, at, axis=0), np.minimum.reduceat(low, at)))

    def search(self, point: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Points whose overlap with a point of some size may reach similarity 3/4, and their bounds."""
        nodes = np.arange(len(self.levels[-1][0]))
        for level in range(len(self.levels) - 1, -1, -1):
            top, low = self.levels[level]
            bound = np.minimum(top[nodes], point).sum(axis=1)
            good = 7 * bound >= 3 * (size + low[nodes])
            nodes, bound = nodes[good], bound[good]
            if level:
                nodes = (nodes[:, None] * self.LEAF + np.arange(self.LEAF)).ravel()
                nodes = nodes[nodes < len(self.levels[level - 1][0])]
        return self.order[nodes], bound


def joining(ids: np.ndarray, comp: np.ndarray, side: np.ndarray, flat: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the components of some classes; ``flat`` has their sets one after another.

    Classes on one side are not compared, but for those of side -1.
    """
    names, of = np.unique(comp, return_inverse=True)
    apart, links = len(names), []
    if apart < 2:
        return links
    start = np.cumsum(size) - size
    member = np.repeat(np.arange(len(ids)), size)
    points = np.bincount(member * GROUPS + (flat >> np.uint64(57)).astype(np.int64), minlength=len(ids) * GROUPS).reshape(-1, GROUPS).astype(np.int32)
    tree = RTree(points, size)
    for i in range(len(ids) - 1):
        if apart == 1:
            break
        if (of[i + 1 :] == of[i]).all():
            continue
        found, bound = tree.search(points[i], size[i])
        fit = (found > i) & (of[found] != of[i]) & (4 * size[found] >= 3 * size[i]) & (4 * size[i] >= 3 * size[found]) & ((side[found] != side[i]) | (side[i] < 0))
        found, bound = found[fit], bound[fit]
        found = found[np.lexsort((found, -bound / (size[found] + size[i])))]
        own, step = flat[start[i] : start[i] + size[i]], CLOSE
        while len(found):
            now, found, step = found[:step], found[step:], step * 4
            begin = np.cumsum(size[now]) - size[now]
            theirs = flat[np.repeat(start[now] - begin, size[now]) + np.arange(size[now].sum())]
            at = np.searchsorted(own, theirs)
            at[at == len(own)] = 0
            both = np.add.reduceat((own[at] == theirs).astype(np.int64), begin)
            for j in now[100 * both >= 75 * (size[now] + size[i] - both)]:
                if of[j] != of[i]:
                    links.append((int(ids[i]), int(ids[j])))
                    of[of == of[j]] = of[i]
                    apart -= 1
            found = found[of[found] != of[i]]
    return links


def _search(data: pa.Table) -> pa.Table:
    """Links found in each unit of a bucket."""
    order = np.lexsort([data.column(k).to_numpy() for k in ("c", "side", "unit")])
    data = data.take(pa.array(order)).combine_chunks()
    unit, side, c, comp = (data.column(k).to_numpy() for k in ("unit", "side", "c", "comp"))
    sets = data.column("shingles").combine_chunks()
    edge = np.frombuffer(sets.buffers()[1], np.int32)[sets.offset : sets.offset + len(sets) + 1] // 8
    flat = np.frombuffer(sets.buffers()[2], np.uint64, int(edge[-1]))
    cut = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1], [True])))
    links: set[tuple[int, int]] = set()
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        links.update(joining(c[lo:hi], comp[lo:hi], side[lo:hi], flat[edge[lo] : edge[hi]], np.diff(edge[lo : hi + 1]).astype(np.int64)))
    a, b = (np.array([p[k] for p in sorted(links)], np.int64) for k in (0, 1))
    out = pa.table({"a": a, "b": b})
    del data, sets, flat
    tidied()
    return out


def _fetcher(shared):
    """Whole sets of the classes in a bitmap, once per task."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve, seen = shared.value, set()
        mask = 8 * len(sieve) - 1
        for batch in batches:
            for _, _, texts in stretches(batch.column("__t"), CHARS):
                ids, sets = [], []
                for s, c in _sets(texts):
                    slot = (c >> 8) & mask
                    if c and c not in seen and sieve[slot >> 3] >> (slot & 7) & 1:
                        seen.add(c)
                        ids.append(c)
                        sets.append(s.tobytes())
                if len(seen) > 1_000_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["c", "shingles"])
        tidied()

    return fetch


def _short(rows: DataFrame) -> DataFrame:
    """A saved list, broadcast if it is short."""
    return F.broadcast(rows) if rows.count() <= SHORT else rows


def _sieve(classes: DataFrame) -> np.ndarray:
    """Bitmap of the classes. Its size follows their number up to a bound, beyond which more unwanted sets pass it."""
    bits = 1 << 15
    wanted = SIEVE * classes.count()
    while bits < min(wanted, SIEVE_MOST):
        bits *= 2
    slot = F.shiftright("c", 8).bitwiseAND(F.lit(bits - 1))
    found = classes.select(F.shiftright(slot, 15).alias("no"), F.expr(f"shiftright(c, 8) & {(1 << 15) - 1}").alias("bit"))
    rows = found.groupBy("no").agg(F.expr("bitmap_construct_agg(bit)").alias("bits")).toArrow()
    out = np.zeros((bits >> 15, 1 << 12), np.uint8)
    for no, own in zip(rows.column("no").to_pylist(), rows.column("bits").to_pylist(), strict=True):
        out[no] = np.frombuffer(own, np.uint8)
    return out.ravel()


def _fetched(text_rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(c, shingles) of some classes, saved. The bitmap thins the scan, a join does the rest."""
    shared = text_rows.sparkSession.sparkContext.broadcast(_sieve(classes))
    fetched = text_rows.mapInArrow(_fetcher(shared), "c bigint, shingles binary")
    return saved(fetched.join(classes, "c", "left_semi").dropDuplicates(["c"]))


def _within(members: DataFrame) -> DataFrame:
    """Members (lead, c, n, comp) with the part of their group that they are searched in."""
    spark = members.sparkSession
    large = saved(members.groupBy("lead").agg(F.ceil(F.sum("n") / CHUNK).cast("long").alias("parts")).where("parts > 1"))
    part = F.pmod(F.xxhash64("c"), F.coalesce("parts", F.lit(1).cast("long")))
    return members.join(_short(large), "lead", "left").select(F.xxhash64("lead", part).alias("unit"), F.lit(-1).alias("side"), "c", "n", "comp")


def _across(members: DataFrame) -> DataFrame:
    """Members of groups with several components, once for each other part of the group.

    The largest component of a group is one side; its parts meet those of the
    others, and the others' parts meet one another.
    """
    each = members.groupBy("lead", "comp").agg(F.sum("n").alias("s"))
    top = each.groupBy("lead").agg(F.max_by("comp", "s").alias("major"), F.max("s").alias("x"), F.sum("s").alias("y"), F.count("*").alias("k")).where("k > 1")
    top = saved(top.select("lead", "major", F.ceil(F.col("x") / CHUNK).cast("long").alias("m1"), F.ceil((F.col("y") - F.col("x")) / CHUNK).cast("long").alias("m2")))
    held = members.join(_short(top), "lead").withColumn("minor", F.col("comp") != F.col("major"))
    held = held.withColumn("own", F.pmod(F.xxhash64("c"), F.when(F.col("minor"), F.col("m2")).otherwise(F.col("m1"))))
    own = F.col("own")

    def meeting(kind: int, i, j, side):
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))

    among = F.transform(F.sequence(F.lit(0).cast("long"), F.col("m2") - 1), lambda j: meeting(0, F.least(own, j), F.greatest(own, j), F.when(own == j, -1).when(own < j, 0).otherwise(1)))
    small = F.transform(F.sequence(F.lit(0).cast("long"), F.col("m1") - 1), lambda j: meeting(1, own, j, F.lit(0)))
    large = F.transform(F.sequence(F.lit(0).cast("long"), F.col("m2") - 1), lambda i: meeting(1, i, own, F.lit(1)))
    held = held.withColumn("x", F.explode(F.when(F.col("minor"), F.concat(among, small)).otherwise(large)))
    return held.select(F.xxhash64("lead", "x.kind", "x.i", "x.j").alias("unit"), "x.side", "c", "n", "comp")


def _found(units: DataFrame, sets: DataFrame) -> DataFrame:
    """Saved links of all units. The number of buckets follows the shingles that the units hold."""
    units = saved(units)
    most = units.agg(F.sum("n")).first()[0] or 0
    buckets = max(tasks(units.sparkSession), -(-most // CHUNK))
    held = units.drop("n").join(sets, "c").withColumn("bucket", F.pmod(F.xxhash64("unit"), F.lit(buckets)))
    return saved(held.groupBy("bucket").applyInArrow(_search, "a bigint, b bigint").distinct())


def _linked(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, label) of the classes that have a link, from groups (lead, c, n)."""

    def named(rows: DataFrame, labels: DataFrame) -> DataFrame:
        return rows.join(labels.withColumnRenamed("node", "c"), "c", "left").select("lead", "c", "n", F.coalesce("label", "c").alias("comp"))

    links = _found(_within(groups.withColumn("comp", F.col("c"))), sets)
    labels = components(links)
    large = saved(groups.join(groups.groupBy("lead").agg(F.sum("n").alias("s")).where(F.col("s") > CHUNK).select("lead"), "lead", "left_semi"))
    if large.isEmpty():
        return labels
    before = None
    while True:
        members = saved(named(large, labels))
        few = members.groupBy("lead", "comp").agg(F.min_by("c", F.xxhash64("c")).alias("c"), F.min_by("n", F.xxhash64("c")).alias("n"))
        few = saved(few.join(few.groupBy("lead").agg(F.count("*").alias("k")).where("k > 1").select("lead"), "lead", "left_semi").select("lead", "c", "n", "comp"))
        apart = few.count()
        if not apart or before is not None and apart > FEWER * before:
            break
        before = apart
        links = saved(links.unionByName(_found(_within(few), sets)))
        labels = components(links)
    if apart:
        links = links.unionByName(_found(_across(members), sets))
        labels = components(links)
    return labels


def ngram_jaccard_join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles and component_id of each row."""
    spark = docs.sparkSession
    lightened(spark)
    rows = docs.select(F.col(doc_id).alias("__keep"), text_of(text).alias("__t"))
    kind = rows.schema["__keep"].dataType.simpleString()
    scan = saved(rows.mapInArrow(_classes, f"__keep {kind}, c bigint, n bigint, hot array<bigint>, times array<bigint>"))
    light = scan.where(F.col("hot").isNull()).select("__keep", "c", "n")

    each = scan.where(F.col("hot").isNotNull()).select(F.explode(F.arrays_zip("hot", "times")).alias("x"))
    each = each.groupBy(F.col("x.hot").alias("t")).agg(F.sum("x.times").alias("k")).where(F.col("k") >= HOT)
    hot = np.sort(each.orderBy(F.desc("k"), "t").limit(HOT_LIST).toArrow().column("t").to_numpy().astype(np.uint64))
    total = scan.agg(F.sum((F.col("n") / 4).cast("long") + 1)).first()[0] or 0
    bits = max(6, int(total // SHARD_ROWS).bit_length())
    text_rows = rows.select("__t")
    dealt = text_rows.mapInArrow(_dealer(spark.sparkContext.broadcast(hot), bits), "shard bigint, packed binary")
    runs = dealt.groupBy("shard").applyInArrow(_runs, "run bigint, c bigint, n bigint, w bigint")
    runs = saved(runs.groupBy("run", "c", "n").agg(F.sum("w").alias("w")))
    del dealt
    released(spark)  # what was dealt out is the most that is ever shuffled
    for _ in range(2):
        # a partner has at least 3/4 of the size and so at least its own number of meetings
        least = 1 + F.floor(F.ceil(F.col("n") * 3 / 4) / 8)
        able = runs.groupBy("c", "n").agg(F.sum("w").alias("met")).where(F.col("met") >= least).select("c")
        runs = runs.join(able, "c", "left_semi")
        runs = saved(runs.join(runs.groupBy("run").agg(F.count("*").alias("k")).where("k > 1").select("run"), "run", "left_semi"))

    least = runs.groupBy("run").agg(F.min("c").alias("lead"))
    groups = saved(runs.join(least, "run").select("lead", "c", "n").distinct())
    sets = _fetched(text_rows, saved(groups.select("c").distinct()))
    labels = _linked(groups, sets)

    first = light.where("n > 0").groupBy("c").agg(F.min("__keep").alias("least")).join(labels.withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    over = first.groupBy("label").agg(F.min("least").alias("__least"))
    linked = light.where("n > 0").join(first.join(over, "label").select("c", "__least"), "c").select("__keep", "n", "__least")
    alone = light.where("n = 0").select("__keep", "n", F.col("__keep").alias("__least"))
    return linked.unionByName(alone).select(F.col("__keep").alias(doc_id), F.col("n").alias("n_shingles"), F.col("__least").alias("component_id"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


_WS = r"[^\x20\x09-\x0D]+"


def components_sql(docs: str) -> str:
    """Common tables up to comp10 (rid, doc_id, n_shingles, component_id) of a relation of doc_id and text."""
    return rf"""
d10 AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WS}') AS w FROM {docs}),
s10 AS MATERIALIZED (SELECT DISTINCT rid, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM d10)),
n10 AS MATERIALIZED (SELECT rid, count(*) AS n FROM s10 GROUP BY rid),
p10 AS MATERIALIZED (SELECT x.rid AS a, y.rid AS b FROM s10 x JOIN s10 y ON x.g = y.g AND x.rid < y.rid GROUP BY x.rid, y.rid
 HAVING 100 * count(*) >= 75 * ((SELECT n FROM n10 WHERE rid = x.rid) + (SELECT n FROM n10 WHERE rid = y.rid) - count(*))),
e10 AS MATERIALIZED (SELECT a, b FROM p10 UNION ALL SELECT b, a FROM p10),
r10(rid, other) AS (SELECT rid, rid FROM d10 UNION SELECT r10.rid, e10.b FROM r10 JOIN e10 ON r10.other = e10.a),
comp10 AS (SELECT d10.rid, d10.doc_id, coalesce(n10.n, 0) AS n_shingles, m.component_id FROM d10 LEFT JOIN n10 USING (rid)
 JOIN (SELECT r10.rid, min(o.doc_id) AS component_id FROM r10 JOIN d10 o ON o.rid = r10.other GROUP BY r10.rid) m USING (rid))"""


ORACLE_SQL = f"WITH RECURSIVE {components_sql('documents')} SELECT doc_id, n_shingles, component_id FROM comp10"
