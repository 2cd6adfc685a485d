"""Corpus pipeline over ``documents``: five stages of the training-data operators.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns the columns of ``docs``; the last one returns the encoded texts.
``run`` keeps every stage's rows in the shared checkpoint folder, so a lost
executor costs no more than the stage at hand. Stages that run Python workers
first have executors give back the heap of the stage before.

Defined results, in every stage: rows without a doc_id are told apart by their
text; null and empty texts fail the quality rules and so never reach the later
stages, which would keep them; rows that are equal in doc_id and text become one
in the second stage; an empty table passes through as one.

Rows are told apart by doc_id and text. Lists of rows to drop or to change are
broadcast up to ``LIST_BOUND`` rows and joined by key beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, ngram_join, quality_rules, secrets, sentencepiece_viterbi
from tessera.llm.common import released, saved, table

LIST_BOUND = 1_000_000

#: SQL can't express the last stage; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def _key() -> Column:
    """Tells rows apart; rows without a doc_id come last."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("\x00"))
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(text).alias("text"))


def _listed(rows: DataFrame) -> DataFrame:
    """A list that a join may broadcast if it is short."""
    rows = saved(rows)
    return F.broadcast(rows) if rows.count() <= LIST_BOUND else rows


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the quality rules."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col("text").alias("__text"))
    return quality_rules.quality_rules(packed, "__text", ("__doc",)).where("kept").select("__doc.*")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the least doc_id; of rows with equal doc_id and text one."""
    released(spark)
    keyed = docs.withColumn("__key", _key())
    groups = saved(ngram_join.ngram_jaccard_join(keyed, "text", "__key"))
    later = _listed(groups.where(~F.col("__key").eqNullSafe(F.col("component_id"))).select("__key").distinct())
    twice = _listed(groups.where(F.col("__key").eqNullSafe(F.col("component_id"))).groupBy("__key").count().where("count > 1").select("__key"))
    kept = keyed.join(later, keyed["__key"].eqNullSafe(later["__key"]), "left_anti")
    again = twice.withColumnRenamed("__key", "__again")
    once = kept.join(again, kept["__key"].eqNullSafe(again["__again"]), "left_anti")
    one = kept.join(again, kept["__key"].eqNullSafe(again["__again"]), "left_semi").dropDuplicates(["__key"])
    return once.unionByName(one).select(*docs.columns)


def remove_benchmark_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; rows that are mostly benchmark go."""
    released(spark)
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with live-looking secrets replaced by a mark."""
    keyed = docs.withColumn("__key", _key())
    found = secrets.secret_scan(keyed, "text", ("__key",), "source" if "source" in docs.columns else None, "lang" if "lang" in docs.columns else None)
    live = _listed(found.where("n_live > 0").groupBy("__key").agg(F.first("found").alias("__found")).withColumnRenamed("__key", "__of"))
    joined = keyed.join(live, keyed["__key"].eqNullSafe(live["__of"]), "left")
    text = F.when(F.col("__found").isNull(), F.col("text")).otherwise(secrets.redacted(F.col("text").cast("string"), F.col("__found")))

    def column(c: str) -> Column:
        if c == "text":
            return F.col("__new").alias(c)
        if c == "n_chars":
            return F.when(F.col("__found").isNull(), F.col(c)).otherwise(F.length("__new").cast(docs.schema[c].dataType)).alias(c)
        return F.col(f"`{c}`")

    return joined.withColumn("__new", text).select(*[column(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of the texts."""
    released(spark)
    return sentencepiece_viterbi.encode(docs, "text", tuple(c for c in ("doc_id", "lang", "source") if c in docs.columns))


STAGES = [
    ("quality rules", keep_by_rules),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", remove_benchmark_spans),
    ("secret scans", redact_secrets),
    ("SentencePiece encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
