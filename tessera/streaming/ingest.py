"""Streaming ingest: a stream of log rows is appended to a namespace batch by batch, each batch once."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.sources import log as replay
from tessera.sources.store import Namespace


def ingest(stream: DataFrame, namespace: Namespace, checkpoint: str, compact: bool = True) -> StreamingQuery:
    """Start a query that commits each micro-batch (id, op, values, attributes).

    The manifest that commits a micro-batch names the query and its number, so a
    batch that Spark delivers again is recognised and skipped. The query's id is
    kept in its checkpoint: another query, or the same one with a new checkpoint,
    has numbers of its own. Upserts are checked like any other; a bad one fails
    the query. When the log is long, old or large enough it is compacted after
    the commit.
    """

    def commit(rows: DataFrame, number: int) -> None:
        query = rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or hashlib.sha256(checkpoint.encode()).hexdigest()[:32]
        if namespace.manifest().get("streams", {}).get(query, -1) >= number or rows.isEmpty():
            return
        rows = replay.latest(rows.withColumn("seq", F.lit(0).cast("long")) if "seq" not in rows.columns else rows)
        deleted = F.col("op") == "delete"
        full = namespace.prepared(rows.where(~deleted), None).withColumn("op", F.lit("upsert")).unionByName(namespace._tombstones(rows.where(deleted).select("id")))
        batch = f"stream-{query}-{number:012d}-{uuid.uuid4().hex[:8]}"
        full.write.parquet(f"{namespace.root}/{namespace.spec.name}/log/{batch}")

        def change(m: dict) -> dict | None:
            streams = m.get("streams", {})
            if streams.get(query, -1) >= number:  # another run of the query was first
                return None
            entry = {"batch": batch, "seq": m["version"] + 1, "at": m["updated_at"]}
            return m | {"batches": [*m["batches"], entry], "streams": streams | {query: number}}

        namespace._publish(change)
        if compact and namespace.compaction_due():
            namespace.compact()

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def describe(namespace: Namespace) -> str:
    """State of the ingest as JSON."""
    m = namespace.manifest()
    return json.dumps({"version": m["version"], "streams": m.get("streams", {}), "batches": len(m["batches"])})
