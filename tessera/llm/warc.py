"""WARC archives: a writer with revisit records and a reader that salvages damaged archives.

Writing: every page becomes one record in a gzip member of its own. Among
records with equal payloads of at least ``least`` bytes the one with the largest
page id carries the payload, the others are revisits that refer to it. Archives
are byte strings of a bounded size, kept as rows (archive, data) in the shared
checkpoint folder, so that lost executors cost nothing that was written.

Reading: each member or record is checked (gzip checksum, version line, header
lines, Content-Length, closing blank lines, block digest). After a failed check
the reader searches for the next gzip member or version line that passes all
checks, goes on there, and logs the bytes between as a quarantined gap with the
reason. What a damaged gzip member unpacks to before it fails is read too; the
gap is the rest. Plain and gzipped archives, one record a member or many, and
both kinds in one archive, are read alike.

Defined results: null html is an empty payload. A null page id sorts below all
others; it is written as an empty id and read back as null. Repeated rows with
the largest page id are all responses. Extra columns are ignored. An empty
table gives no archives and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import saved, table

LEAST = 1000
ARCHIVE_BYTES = 4_000_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
_ID = re.compile(r"<urn:page:(.*)>")


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, page: str, url: str | None, payload: bytes, refers_to: str | None = None) -> bytes:
    """One WARC record; a revisit names its payload's digest and size but does not carry it."""
    if kind == "warcinfo":
        block, content = payload, "application/warc-fields"
    else:
        block, content = HTTP + (payload if kind == "response" else b""), "application/http;msgtype=response"
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    if kind != "warcinfo":
        head.append("WARC-Payload-Digest: " + _sha1(payload))
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"X-Payload-Length: {len(payload)}"]
        if refers_to is not None:
            head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    head += ["WARC-Block-Digest: " + _sha1(block), f"Content-Type: {content}", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member without a time stamp."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str]
    block: bytes


@dataclass
class Gap:
    """Quarantined bytes; offsets inside a gzip member count from its first unpacked byte."""

    offset: int
    length: int
    reason: str
    inside: int | None = None


def _record_at(data: bytes, at: int) -> tuple[Record | None, int, str]:
    """The record at a place, the place after it, and why there is none."""
    found = _VERSION.match(data, at)
    if not found:
        return None, at, "no version line"
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return None, at, "header has no end"
    headers = {}
    for line in data[found.end() : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            return None, at, "bad header line"
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = headers.get("content-length", "")
    if not size.isdecimal():
        return None, at, "bad content length"
    start, stop = end + 4, end + 4 + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n":
        return None, at, "record doesn't end where its length says"
    block = data[start:stop]
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest != _sha1(block):
        return None, at, "block digest differs"
    return Record(at, stop + 4 - at, headers, block), stop + 4, ""


def _plain(data: bytes) -> Iterator[Record | Gap]:
    at, size = 0, len(data)
    while at < size:
        got, after, why = _record_at(data, at)
        if got:
            yield got
            at = after
            continue
        look = at
        while True:
            found = _VERSION.search(data, look + 1)
            to = found.start() if found else size
            if not found or _record_at(data, to)[0]:
                break
            look = to
        yield Gap(at, to - at, why)
        at = to


def _member_at(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What a gzip member at a place unpacks to, the place where it ends or fails, and why it fails."""
    z, out, pos, step = zlib.decompressobj(31), [], at, 65536
    while not z.eof:
        piece = data[pos : pos + step]
        if not piece:
            return b"".join(out), pos, "member is cut off"
        before = z.copy()
        try:
            out.append(z.decompress(piece))
            pos += len(piece)
        except zlib.error as e:
            if len(piece) == 1:
                return b"".join(out), pos, f"bad member: {e}"[:80]
            z, step = before, max(1, step // 16)  # an error gives none of its piece: come nearer
    return b"".join(out), pos - len(z.unused_data), ""


def _good(data: bytes, at: int) -> bool:
    """True if a gzip member at a place gives a record."""
    return any(isinstance(got, Record) for got in _plain(_member_at(data, at)[0]))


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """Records and gaps of an archive, in order."""
    at, size = 0, len(data)
    while at < size:
        got, after, why = _record_at(data, at)
        if got:
            yield got
            at = after
            continue
        kept: list[Record | Gap] = []
        if data.startswith(b"\x1f\x8b", at):
            unpacked, after, why = _member_at(data, at)
            if not why and _VERSION.search(unpacked):
                for got in _plain(unpacked):
                    if isinstance(got, Gap):
                        whole = got.length == len(unpacked)
                        yield Gap(at, after - at, got.reason, None if whole else got.offset)
                    else:
                        yield Record(at, after - at, got.headers, got.block)
                at = after
                continue
            kept, why = list(_plain(unpacked)), why or "member holds no record"
        some = {(str(got.headers), got.block) for got in kept if isinstance(got, Record)}
        look = at
        while True:
            found = _START.search(data, look + 1)
            to = found.start() if found else size
            if not found:
                break
            if data[to] == 0x1F:
                if _good(data, to):
                    break
            # a member may hold records as they are; those that it gave are not new
            elif (got := _record_at(data, to)[0]) and (to >= after or (str(got.headers), got.block) not in some):
                break
            look = to
        if not some:
            yield Gap(at, to - at, why)
        else:
            end = min(after, to)
            rest = kept.pop().offset if isinstance(kept[-1], Gap) else None
            for got in kept:
                yield Gap(at, end - at, got.reason, got.offset) if isinstance(got, Gap) else Record(at, end - at, got.headers, got.block)
            yield Gap(end, to - end, why, rest)
        at = to


def planned(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> DataFrame:
    """page_id, url, payload, record_type and refers_to of each page. Digests of small payloads take no part in the join."""
    payload = F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("__large", F.octet_length("payload") >= least).withColumn("__digest", F.sha2("payload", 256))
    top = (
        rows.where("__large")
        .select("__digest", "page_id")
        .groupBy("__digest")
        .agg(F.max("page_id").alias("top"), F.count("*").alias("k"))
        .where("k > 1")
        .select("__digest", "top")
    )
    # a key that no other row has keeps small payloads from meeting in one task
    key = F.when(F.col("__large"), F.col("__digest")).otherwise(F.concat(F.lit("#"), F.xxhash64("page_id", "url").cast("string")))
    joined = rows.withColumn("__key", key).join(top.withColumnRenamed("__digest", "__key"), "__key", "left")
    revisit = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return joined.select(
        "page_id",
        "url",
        "payload",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("top")).alias("refers_to"),
    )


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[bytes] = []
    size = 0

    def archive() -> pa.RecordBatch:
        data = b"".join(parts)
        name = f"pages-{hashlib.sha1(data).hexdigest()[:16]}.warc.gz"
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary())], ["archive", "data"])

    for batch in batches:
        for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "record_type", "refers_to")), strict=True):
            page, url, payload, kind, refers = (x.as_py() for x in row)
            if not parts:
                parts.append(member(record("warcinfo", "info", None, b"software: tessera\r\nformat: WARC File Format 1.1\r\n")))
            parts.append(member(record(kind, "" if page is None else str(page), url, payload, None if refers is None else str(refers))))
            size += len(parts[-1])
            if size >= ARCHIVE_BYTES:
                yield archive()
                parts.clear()
                size = 0
    if parts:
        yield archive()


def write_archives(pages: DataFrame, **columns) -> DataFrame:
    """(archive, data) rows, kept in the shared checkpoint folder."""
    return saved(planned(pages, **columns).mapInArrow(_write, "archive string, data binary"))


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """(archive, data) rows of .warc and .warc.gz files at a path that Spark can read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), F.col("content").alias("data"))


READ = (
    "archive string, offset bigint, length bigint, reason string, inside bigint, page_id string, url string, record_type string, "
    "refers_to string, payload_bytes bigint, payload_digest string"
)


def _page(headers: dict[str, str], name: str) -> str | None:
    found = _ID.fullmatch(headers.get(name, ""))
    return (found[1] or None) if found else headers.get(name)


def read_archives(archives: DataFrame, payload: bool = False) -> DataFrame:
    """A row for each record (warcinfo left out) and for each quarantined gap; gaps have a reason. With ``payload`` the response's bytes too."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("archive").to_pylist(), batch.column("data"), strict=True):
                rows = []
                for got in salvage(data.as_py() or b""):
                    row = {"archive": name, "offset": got.offset, "length": got.length}
                    if isinstance(got, Gap):
                        rows.append(row | {"reason": got.reason, "inside": got.inside})
                        continue
                    kind = got.headers.get("warc-type")
                    if kind == "warcinfo":
                        continue
                    row |= {"page_id": _page(got.headers, "warc-record-id"), "url": got.headers.get("warc-target-uri"), "record_type": kind}
                    if kind == "revisit":
                        digest = got.headers.get("warc-payload-digest", "").removeprefix("sha1:")
                        row["refers_to"] = _page(got.headers, "warc-refers-to")
                        row["payload_bytes"] = int(got.headers["x-payload-length"]) if "x-payload-length" in got.headers else None
                        row["payload_digest"] = base64.b32decode(digest).hex() if digest else None
                    else:
                        _, _, body = got.block.partition(b"\r\n\r\n")
                        row["payload_bytes"] = len(body)
                        row["payload_digest"] = hashlib.sha1(body).hexdigest()
                        if payload:
                            row["payload"] = body
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = {"string": pa.string(), "bigint": pa.int64()}
    fields = [(n, kinds[k]) for n, k in (x.split() for x in READ.split(", "))] + [("payload", pa.binary())] * payload
    schema = pa.schema(fields)
    return archives.mapInArrow(read, READ + ", payload binary" * payload)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_archives(write_archives(table(spark, sf_dir, "pages"))).where("reason is null")
    return read.select(
        F.col("page_id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


ORACLE_SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
 CASE WHEN n >= {LEAST} AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN n >= {LEAST} AND page_id < top THEN top END AS refers_to FROM t"""
