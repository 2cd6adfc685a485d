"""Replay of a write log: latest write wins, views, point lookups, time travel.

A log has the columns id, seq (the batch), op (upsert or delete), optionally ord
(order inside a batch), and the payload. A later batch replaces an earlier one;
inside a batch deletes come before upserts, or after them for late-interaction
replay. Payload columns of deletes are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import NotFound, PointInTimeNotRetained
from tessera.operators.ann import ordered


def _place(log: DataFrame, deletes_first: bool) -> Column:
    rank = F.when(F.col("op") == "delete", 0 if deletes_first else 1).otherwise(1 if deletes_first else 0)
    return F.struct(F.col("seq"), rank.alias("rank"), F.col("ord") if "ord" in log.columns else F.lit(0).alias("ord"))


def latest(log: DataFrame, deletes_first: bool = True) -> DataFrame:
    """The last operation of every id. An aggregate with map-side combine, not a window, so hot ids are reduced before the shuffle."""
    row = F.struct(*[F.col(f"`{c}`") for c in log.columns])
    return log.groupBy(F.col("id").alias("__id")).agg(F.max_by(row, _place(log, deletes_first)).alias("r")).select("r.*")


def live(log: DataFrame, deletes_first: bool = True) -> DataFrame:
    """Live rows of a log."""
    return latest(log, deletes_first).where("op <> 'delete'")


def tombstones(log: DataFrame) -> DataFrame:
    """Ids whose last operation is a delete."""
    return latest(log).where("op = 'delete'").select("id")


def eventual_tombstones(log: DataFrame) -> DataFrame:
    """The same over the batches that hold deletes alone: an upsert in another batch doesn't clear a tombstone."""
    deleting = log.where("op = 'delete'").select("seq").distinct()
    return tombstones(log.join(deleting, "seq", "left_semi"))


def strong(segment: DataFrame, log: DataFrame) -> DataFrame:
    """Segment rows that the log has not touched, and the log's live rows. Rows are resolved before any filter."""
    columns = segment.columns
    last = latest(log)
    untouched = segment.join(last.select("id"), "id", "left_anti").select(*columns)
    return untouched.unionByName(last.where("op <> 'delete'").select(*columns))


def eventual(segment: DataFrame, log: DataFrame) -> DataFrame:
    """Segment rows without tombstones; rows of the log are not seen."""
    return segment.join(eventual_tombstones(log), "id", "left_anti").select(*segment.columns)


def merged(segment_hits: DataFrame, log_hits: DataFrame, log: DataFrame, k: int, descending: bool = False) -> DataFrame:
    """Best k of scored segment rows that the log has not touched, and scored log rows."""
    touched = log.select("id").distinct()
    return ordered(segment_hits.join(touched, "id", "left_anti").unionByName(log_hits), k, descending)


def deletes_by_filter(snapshot: DataFrame, predicate: Column, seq: int) -> DataFrame:
    """Tombstones of the rows that match."""
    return snapshot.where(predicate).select("id", F.lit(seq).cast("long").alias("seq"), F.lit("delete").alias("op"))


def fetch(snapshot: DataFrame, ids: list, fields: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows in request order, missing ids) of a list of distinct ids, at most as long as a request."""
    if len(set(ids)) != len(ids):
        raise NotFound("an id is asked twice")
    spark = snapshot.sparkSession
    wanted = spark.createDataFrame(list(enumerate(ids)), "pos int, id string").withColumn("id", F.col("id").cast(snapshot.schema["id"].dataType))
    columns = ["id", *(fields if fields is not None else [c for c in snapshot.columns if c != "id"])]
    rows = snapshot.select(*columns).join(F.broadcast(wanted), "id").orderBy("pos")
    missing = wanted.join(snapshot.where(F.col("id").isin(ids)).select("id"), "id", "left_anti").orderBy("pos").select("id")
    return rows, missing


def as_of_version(log: DataFrame, version) -> DataFrame:
    """The log up to a generation."""
    return log.where(F.col("seq") <= version)


def version_at(manifests: DataFrame, when) -> int:
    """Last generation, in version order, that was published at or before a time."""
    found = manifests.where(F.col("updated_at") <= F.lit(when).cast("timestamp")).agg(F.max("version").alias("v")).first()["v"]
    if found is None:
        raise PointInTimeNotRetained(str(when))
    return found


def underfill(requested: int, returned: int, stale: bool, rows: int, filtered: bool, partial: bool) -> str | None:
    """Why an answer has fewer rows than asked for: what was not looked at, or that there is no more."""
    if returned >= requested:
        return None
    if stale:
        return "the eventual view leaves newer rows out"
    if not rows:
        return "the namespace is empty"
    if filtered and partial:
        return "the filter passes too few rows of the probed clusters"
    return "there are no more matches"


def ranked_window(rows: DataFrame, by: str, score: str = "score", lower: bool = True) -> DataFrame:
    """Rank of each row inside its group."""
    order = F.col(score).asc() if lower else F.col(score).desc()
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(order, F.col("id").cast("string").asc())))
