"""Namespaces on a file system: a log of Parquet batches and create-exclusive manifests.

A commit writes its batch first and then creates the manifest of the next
generation; the file system lets one writer create it, so a lost race is seen
and retried. Every generation stays readable until it is collected.

Paths go through Hadoop's file systems. Exclusive creation holds on those of
``EXCLUSIVE``. On others (object stores whose connector looks first and writes
then) two writers could both believe that they were first, so namespaces are
refused there unless the session sets ``spark.tessera.exclusiveCreate`` to true,
for a connector known to create conditionally; ``Files.probe`` tests what can be
seen from one writer.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import Conflict, NotFound, PointInTimeNotRetained, ValidationError
from tessera.operators import ann
from tessera.operators.distance import finite
from tessera.operators.filters import Compiler
from tessera.operators.governance import Lock, check_locks
from tessera.sources import index
from tessera.sources import log as replay
from tessera.spec import NamespaceSpec

ATTEMPTS = 4
MAX_BATCH = 50_000
FRAGMENTS, AGE_S, BYTES = 100, 300, 64 << 20
HISTORY = 128
#: Files younger than this are never collected: a writer may be about to publish them.
GRACE_S = 3600.0
EXCLUSIVE = {"file", "hdfs", "viewfs", "abfs", "abfss"}


class Files:
    """The few file operations that commits need."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark.sparkContext._jvm
        self._path, self._conf = jvm.org.apache.hadoop.fs.Path, spark.conf
        self.root = root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def create(self, name: str, text: str) -> bool:
        """Create a file with a text; False if it is there already."""
        try:
            out = self._fs.create(self._path(f"{self.root}/{name}"), False)
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def read(self, name: str) -> str | None:
        path = self._path(f"{self.root}/{name}")
        if not self._fs.exists(path):
            return None
        size = self._fs.getFileStatus(path).getLen()
        stream = self._fs.open(path)
        try:
            return bytes(stream.readNBytes(size)).decode()
        finally:
            stream.close()

    def exclusive(self) -> bool:
        """True if creation is known to be exclusive here."""
        return self._fs.getUri().getScheme() in EXCLUSIVE or self._conf.get("spark.tessera.exclusiveCreate", "false").lower() == "true"

    def probe(self) -> dict[str, bool]:
        """What the store was seen to do: refuse a second creation, give back what was written, list and remove it."""
        name = f"probe-{uuid.uuid4().hex}"
        made, again = self.create(name, "one"), self.create(name, "two")
        seen = {"creates": made, "refuses_second": not again, "reads_back": self.read(name) == "one", "lists": name in self.names("")}
        self.remove(name)
        return seen | {"removes": self.read(name) is None, "exclusive": self.exclusive()}

    def age(self, name: str) -> float:
        """Seconds since a file or folder was last changed."""
        return time.time() - self.modified(name) / 1000

    def modified(self, name: str) -> int:
        """When a file or folder was last changed, in milliseconds."""
        return self._fs.getFileStatus(self._path(f"{self.root}/{name}")).getModificationTime()

    def rename(self, old: str, new: str) -> bool:
        """Give a folder its final name; False if that is taken."""
        target = self._path(f"{self.root}/{new}")
        return not self._fs.exists(target) and self._fs.rename(self._path(f"{self.root}/{old}"), target)

    def size(self, name: str) -> int:
        """Bytes of a file or of all files in a folder."""
        path = self._path(f"{self.root}/{name}")
        return self._fs.getContentSummary(path).getLength() if self._fs.exists(path) else 0

    def names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)


class Namespace:
    """One versioned table of vectors."""

    def __init__(self, spark: SparkSession, root: str, spec: NamespaceSpec, attributes: T.StructType):
        self.spark, self.root, self.spec, self.attributes = spark, root.rstrip("/"), spec, attributes
        self.files = Files(spark, f"{self.root}/{spec.name}")

    # definition

    @staticmethod
    def create(spark: SparkSession, root: str, spec: NamespaceSpec, attributes: T.StructType) -> Namespace:
        """A new namespace, or the existing one if its whole configuration is equal."""
        self = Namespace(spark, root, spec, attributes)
        if not self.files.exclusive():
            raise ValidationError("this store may not create files exclusively; see spark.tessera.exclusiveCreate")
        body = json.dumps({"spec": spec.to_dict(), "attributes": attributes.jsonValue()}, sort_keys=True)
        if not self.files.create("spec.json", body) and self.files.read("spec.json") != body:
            raise Conflict(f"{spec.name} exists with another configuration")
        self.files.create(_name(0), json.dumps({"version": 0, "updated_at": _now(), "batches": [], "segment": None, "parent": None}))
        return self

    @staticmethod
    def open(spark: SparkSession, root: str, name: str) -> Namespace:
        files = Files(spark, f"{root.rstrip('/')}/{name}")
        body = files.read("spec.json")
        if body is None or files.read("deleted") is not None:
            raise NotFound(name)
        raw = json.loads(body)
        return Namespace(spark, root, NamespaceSpec.from_dict(raw["spec"]), T.StructType.fromJson(raw["attributes"]))

    def delete(self) -> None:
        """Mark as deleting, then remove. Refused while forks read its files."""
        if alive := [n for n in self._forks() if self._child(n)]:
            raise Conflict(f"{self.spec.name} has forks: {alive}")
        self.files.create("deleted", _now())
        for folder in ("log", "segments", "manifests", "snapshots", "forks"):
            self.files.remove(folder)
        self.files.remove("spec.json")
        self.files.remove("deleted")

    @property
    def row_schema(self) -> T.StructType:
        return T.StructType([T.StructField("id", T.StringType()), T.StructField("values", T.ArrayType(T.FloatType())), *self.attributes.fields])

    @property
    def log_schema(self) -> T.StructType:
        return T.StructType([T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), *self.row_schema.fields])

    # manifests

    def versions(self) -> list[int]:
        return [int(n[:20]) for n in self.files.names("manifests") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """The newest manifest, or that of a generation."""
        if version is None:
            have = self.versions()
            if not have:
                raise NotFound(self.spec.name)
            version = have[-1]
        body = self.files.read(_name(version))
        if body is None:
            raise PointInTimeNotRetained(f"generation {version}")
        return json.loads(body)

    def resolve(self, as_of: int | str | datetime | None = None) -> dict:
        """Manifest of a generation number, a time, ``snapshot:<name>``, or now."""
        if as_of is None or isinstance(as_of, int):
            return self.manifest(as_of)
        if isinstance(as_of, str) and as_of.startswith("snapshot:"):
            body = self.files.read(f"snapshots/{as_of[9:]}.json")
            if body is None:
                raise NotFound(as_of)
            return self.manifest(json.loads(body)["version"])
        when = as_of if isinstance(as_of, datetime) else datetime.fromisoformat(as_of.replace("Z", "+00:00"))
        found = None
        for v in self.versions():
            m = self.manifest(v)
            if datetime.fromisoformat(m["updated_at"]) <= when:
                found = m
        if found is None:
            raise PointInTimeNotRetained(str(as_of))
        return found

    def _publish(self, change: Callable[[dict], dict | None]) -> dict:
        """Create the next manifest from the newest one; retried when another writer was first. Without a change nothing is published."""
        for _ in range(ATTEMPTS):
            old = self.manifest()
            new = change(dict(old))
            if new is None:
                return old
            new = new | {"version": old["version"] + 1, "updated_at": _now()}
            if self.files.create(_name(new["version"]), json.dumps(new)):
                return new
        raise Conflict(f"{self.spec.name}: too many writers")

    # writing

    def _append(self, rows: DataFrame) -> dict:
        batch = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/{self.spec.name}/log/{batch}")
        return self._publish(lambda m: m | {"batches": [*m["batches"], {"batch": batch, "seq": m["version"] + 1, "at": _now()}]})

    def prepared(self, rows: DataFrame, most: int | None = MAX_BATCH) -> DataFrame:
        """Checked upserts (id, values, attributes), with the types of the namespace. One aggregate sees ids and vectors before anything is written."""
        from tessera.spec import _ID

        seen = rows.agg(
            F.count("*").alias("n"),
            F.count_if(F.size("values") != self.spec.dimensions).alias("size"),
            F.count_if(~F.coalesce(finite(F.col("values")), F.lit(False))).alias("finite"),
            F.count_if(~F.coalesce(F.col("id").rlike(f"^{_ID.pattern}$") & (F.length("id") <= 1024), F.lit(False))).alias("id"),
        ).first()
        if (most and not seen["n"]) or (most and seen["n"] > most) or seen["size"] or seen["finite"] or seen["id"]:
            raise ValidationError(f"refused batch: {seen.asDict()}")
        return self.typed(rows)

    def typed(self, rows: DataFrame) -> DataFrame:
        """Rows with the namespace's columns; attributes that they lack are NULL."""
        return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.row_schema])

    def upsert(self, rows: DataFrame) -> dict:
        """Append rows (id, values, attributes)."""
        return self._append(self.prepared(rows).withColumn("op", F.lit("upsert")))

    def upsert_all(self, rows: DataFrame, most: int = MAX_BATCH) -> dict:
        """Append rows of any number, in batches of ``most`` at most; all rows of an id are in one batch."""
        split = rows.withColumn("__part", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-8 * rows.count() // most)))))
        batches, room = [[]], most
        for part, n in sorted((r["__part"], r["count"]) for r in split.groupBy("__part").count().collect()):
            if n > room:
                batches, room = [*batches, []], most
            batches[-1].append(part)
            room -= n
        done = [self.upsert(split.where(F.col("__part").isin(parts)).drop("__part")) for parts in batches if parts]
        return done[-1] if done else self.manifest()

    def guarded(self, select: Callable[[DataFrame], DataFrame], op: str = "delete") -> dict:
        """A write that depends on what is there: ``select`` takes the strong snapshot and gives the rows to write.

        It is published only on the generation that it was selected from; when
        another writer was first, the rows are selected again, at most
        ``ATTEMPTS`` times.
        """
        for _ in range(ATTEMPTS):
            seen = self.manifest()
            rows = select(self.snapshot(seen["version"]))
            rows = self._tombstones(rows.select("id")) if op == "delete" else self.prepared(rows).withColumn("op", F.lit("upsert"))
            batch = uuid.uuid4().hex
            rows.write.parquet(f"{self.root}/{self.spec.name}/log/{batch}")
            version = seen["version"] + 1
            new = seen | {"batches": [*seen["batches"], {"batch": batch, "seq": version, "at": _now()}], "version": version, "updated_at": _now()}
            if self.files.create(_name(version), json.dumps(new)):
                return new
            self.files.remove(f"log/{batch}")
        raise Conflict(f"{self.spec.name}: too many writers")

    def delete_ids(self, ids: list[str], locks: tuple[Lock, ...] = ()) -> dict:
        check_locks(locks, self.spec.name)
        return self._append(self._tombstones(self.spark.createDataFrame([(i,) for i in ids], "id string")))

    def delete_where(self, tree: dict, locks: tuple[Lock, ...] = ()) -> dict:
        """Tombstones for all rows of the strong snapshot that match."""
        check_locks(locks, self.spec.name)
        return self.guarded(lambda rows: rows.where(Compiler(rows.schema).where(tree)))

    def _tombstones(self, ids: DataFrame) -> DataFrame:
        rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.row_schema if f.name != "id"]
        return ids.select("id", *rest, F.lit("delete").alias("op"))

    # reading

    def log(self, manifest: dict) -> DataFrame:
        """Log rows of a manifest with their batch numbers. A forked child's batches come after its parent's."""
        out = self.spark.createDataFrame([], self.log_schema)
        for b in manifest["batches"]:
            rows = self.spark.read.schema(T.StructType([*self.row_schema.fields, T.StructField("op", T.StringType())])).parquet(f"{self.root}/{b.get('owner', self.spec.name)}/log/{b['batch']}")
            out = out.unionByName(rows.withColumn("seq", F.lit(b["seq"]).cast("long")))
        return out

    def folder(self, manifest: dict) -> str:
        """Folder of a manifest's segment."""
        s = manifest["segment"]
        return f"{self.root}/{s['owner']}/segments/{s['segment']}"

    def segment(self, manifest: dict) -> DataFrame:
        if not manifest["segment"]:
            return self.spark.createDataFrame([], self.row_schema)
        return index.read_rows(self.spark, self.folder(manifest), self.row_schema).drop("cluster_id")

    def snapshot(self, as_of=None, consistency: str = "strong") -> DataFrame:
        """Live rows at a point in time, in the strong or the eventual view."""
        m = self.resolve(as_of)
        view = replay.strong if consistency == "strong" else replay.eventual
        return view(self.segment(m), self.log(m))

    # maintenance

    def compaction_due(self, now: float | None = None) -> bool:
        """True by number of batches, by age of the oldest, or by their bytes."""
        m = self.manifest()
        if not m["batches"]:
            return False
        age = (now or time.time()) - datetime.fromisoformat(m["batches"][0]["at"]).timestamp()
        if len(m["batches"]) >= FRAGMENTS or age >= AGE_S:
            return True
        return sum(self.files.size(f"log/{b['batch']}") for b in m["batches"] if b.get("owner", self.spec.name) == self.spec.name) >= BYTES

    def compact(self) -> dict:
        """Write the strong snapshot as the new segment, with its index, and cut the log at the batches read. Rows that are not finite are dropped.

        Centroids stay while the log holds at most ``index.RETRAIN`` times the
        rows of the segment and the segment is the namespace's own.
        """
        m = self.manifest()
        if not m["batches"]:
            return m
        name, old, added = uuid.uuid4().hex, None, 0.0
        if m["segment"] and m["segment"]["owner"] == self.spec.name and m["segment"]["index"]["clusters"]:
            old = index.read_centroids(self.spark, self.folder(m))
            added = self.log(m).where(F.col("op") == "upsert").count() / max(1, m["segment"]["index"]["rows"])
        about = index.write(self.snapshot(m["version"]).where(finite(F.col("values"))), self.spec, f"{self.root}/{self.spec.name}/segments/{name}", old, added)
        done = {b["batch"] for b in m["batches"]}
        return self._publish(lambda new: new | {"segment": {"owner": self.spec.name, "segment": name, "index": about}, "batches": [b for b in new["batches"] if b["batch"] not in done]})

    def load(self, rows: DataFrame) -> dict:
        """Fill an empty namespace with rows of any number: they become its first segment, without passing the log."""
        if (m := self.manifest())["batches"] or m["segment"]:
            raise Conflict(f"{self.spec.name} is not empty")
        name = uuid.uuid4().hex
        about = index.write(self.prepared(rows, None), self.spec, f"{self.root}/{self.spec.name}/segments/{name}")

        def change(new: dict) -> dict:
            if new["segment"]:
                raise Conflict(f"{self.spec.name} is not empty")
            return new | {"segment": {"owner": self.spec.name, "segment": name, "index": about}}

        return self._publish(change)

    def nearest(self, vector: list[float], k: int, as_of=None, consistency: str = "strong", nprobe: int | None = None, node: dict | None = None, exclude: list[str] = ()) -> DataFrame:
        """(id, score) of the k nearest live rows: probed clusters of the segment without the rows that the log hides, and all of the log."""
        m = self.resolve(as_of)
        where = Compiler(self.row_schema, self.spec.text_fields).where(node)
        where = where & ~F.col("id").isin(list(exclude)) if exclude else where
        log, parts = self.log(m), []
        if m["segment"]:
            hidden = None
            if m["batches"]:
                hidden = log.select("id").distinct() if consistency == "strong" else replay.eventual_tombstones(log)
            parts.append(index.probe(self.spark, self.folder(m), self.row_schema, m["segment"]["index"], vector, self.spec.metric, k, nprobe, node, where, hidden))
        if m["batches"] and consistency == "strong":
            parts.append(ann.exact(replay.live(log), vector, self.spec.metric, k, where))
        if not parts:
            return self.spark.createDataFrame([], "id string, score double")
        return ann.ordered(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), k)

    def has_text(self, manifest: dict, fields: set[str]) -> bool:
        """True if stored postings answer for these fields: a log would change the statistics."""
        return not manifest["batches"] and bool(manifest["segment"]) and fields <= set(manifest["segment"]["index"]["text"])

    def put_snapshot(self, name: str, as_of=None) -> int:
        version = self.resolve(as_of)["version"]
        if not self.files.create(f"snapshots/{name}.json", json.dumps({"version": version})):
            raise Conflict(f"snapshot {name} exists")
        return version

    def list_snapshots(self) -> dict[str, int]:
        return {n[:-5]: json.loads(self.files.read(f"snapshots/{n}"))["version"] for n in self.files.names("snapshots") if n.endswith(".json")}

    def delete_snapshot(self, name: str) -> None:
        self.files.remove(f"snapshots/{name}.json")

    def clone(self, name: str, as_of=None) -> Namespace:
        """Independent copy of a point in time."""
        other = Namespace.create(self.spark, self.root, NamespaceSpec.from_dict(self.spec.to_dict() | {"name": name}), self.attributes)
        segment = uuid.uuid4().hex
        about = index.write(self.snapshot(as_of), other.spec, f"{self.root}/{name}/segments/{segment}")
        other._publish(lambda m: m | {"segment": {"owner": name, "segment": segment, "index": about}})
        return other

    def fork(self, name: str, as_of=None) -> Namespace:
        """Child that shares the parent's files up to a generation and has a log of its own.

        Each owner of files that the child reads keeps a record of it, written
        before the child is published, so that no owner collects them.
        """
        m = self.resolve(as_of)
        batches = [b | {"owner": b.get("owner", self.spec.name), "seq": i - len(m["batches"])} for i, b in enumerate(m["batches"])]
        needed = {b["batch"] for b in batches} | ({m["segment"]["segment"]} if m["segment"] else set())
        for owner in {self.spec.name, *(b["owner"] for b in batches), *([m["segment"]["owner"]] if m["segment"] else [])}:
            Files(self.spark, f"{self.root}/{owner}").create(f"forks/{name}.json", json.dumps({"files": sorted(needed)}))
        other = Namespace.create(self.spark, self.root, NamespaceSpec.from_dict(self.spec.to_dict() | {"name": name}), self.attributes)
        other._publish(lambda new: new | {"segment": m["segment"], "batches": batches, "parent": {"name": self.spec.name, "version": m["version"]}})
        return other

    def _forks(self) -> list[str]:
        return [n[:-5] for n in self.files.names("forks") if n.endswith(".json")]

    def _child(self, name: str) -> Namespace | None:
        try:
            return Namespace.open(self.spark, self.root, name)
        except NotFound:
            return None

    def status(self) -> dict:
        m = self.manifest()
        return {"version": m["version"], "uncompacted": len(m["batches"]), "ready": not m["batches"], "segment": m["segment"]}

    def collect(self, children: tuple[Namespace, ...] = (), keep: int = HISTORY, grace: float = GRACE_S) -> list[str]:
        """Remove manifests beyond the history, and batches and segments that no kept manifest of it, its forks or other ``children`` names.

        Files younger than ``grace`` seconds stay: a writer may have written
        them and not published yet. So do the files of a fork being made.
        """
        pinned = set(self.list_snapshots().values())
        have = self.versions()
        for v in have[:-keep]:
            if v not in pinned:
                self.files.remove(_name(v))
        used, readers = set(), [self, *children]
        for name in self._forks():
            record = f"forks/{name}.json"
            child = self._child(name)
            if child:
                readers.append(child)
            if self.files.age(record) < grace or child and child.manifest()["version"] == 0:
                used |= set(json.loads(self.files.read(record))["files"])
            elif not child:
                self.files.remove(record)
        for ns in readers:
            for v in ns.versions():
                m = ns.manifest(v)
                used |= {b["batch"] for b in m["batches"]} | ({m["segment"]["segment"]} if m["segment"] else set())
        gone = [f"{folder}/{n}" for folder in ("log", "segments") for n in self.files.names(folder) if n not in used and self.files.age(f"{folder}/{n}") >= grace]
        for name in gone:
            self.files.remove(name)
        return gone


def list_namespaces(spark: SparkSession, root: str) -> list[str]:
    files = Files(spark, root)
    return [n for n in files.names("") if files.read(f"{n}/spec.json") is not None]


def _name(version: int) -> str:
    return f"manifests/{version:020d}.json"


def _now() -> str:
    return datetime.now(UTC).isoformat()
