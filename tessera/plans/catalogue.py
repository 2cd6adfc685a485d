"""Registered queries over the test tables and their DuckDB oracles.

Scores are ranked unrounded and shown with six digits. Ids that break ties are
compared as strings, as the engine does.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import algebra, ann, bitmap, governance, late, quant, text
from tessera.operators.filters import Compiler
from tessera.plans import request as requests
from tessera.plans import sizing, stored
from tessera.sources import index
from tessera.sources import log as replay
from tessera.spec import NamespaceSpec, TextField

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
PLAIN = TextField(stemming=False)
FIELDS = {"text": PLAIN, "source": PLAIN}
SEED = 7


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Columns with six digits, and no negative zero."""
    return df.select(*[(F.round(c, 6) + 0.0).alias(c) if c in columns else F.col(c) for c in df.columns])


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("values"), "label")


def vector(spark: SparkSession, sf: str, key: int = SEED) -> list[float]:
    return ann.seed_vector(vectors(spark, sf), key)


def R(x: str) -> str:  # noqa: N802
    return f"round({x}, 6) + 0.0"


def DOT(a: str, b: str) -> str:  # noqa: N802
    return f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def COS(a: str, b: str) -> str:  # noqa: N802
    return f"(1.0 - greatest(-1.0, least(1.0, {DOT(a, b)} / sqrt({DOT(a, a)} * {DOT(b, b)}))))"


def L2(a: str, b: str) -> str:  # noqa: N802
    return f"list_sum(list_transform(list_zip(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


Q = f"q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = {SEED})"


def topk_sql(score: str, k: int = 10, where: str = "true") -> str:
    scored = f"SELECT vec_id AS id, {score} AS raw FROM embeddings, q WHERE {where}"
    return f"WITH {Q} SELECT id, {R('raw')} AS score FROM ({scored}) ORDER BY raw, CAST(id AS VARCHAR) LIMIT {k}"


# nearest neighbours


@register("ann_cosine_topk", topk_sql(COS("embedding", "e")))
def ann_cosine_topk(spark, sf):
    return rounded(ann.exact(vectors(spark, sf), vector(spark, sf), "cosine", 10), "score")


@register("ann_l2_topk", topk_sql(L2("embedding", "e")))
def ann_l2_topk(spark, sf):
    return rounded(ann.exact(vectors(spark, sf), vector(spark, sf), "euclidean", 10), "score")


@register("ann_dot_topk", topk_sql("-" + DOT("embedding", "e")))
def ann_dot_topk(spark, sf):
    return rounded(ann.exact(vectors(spark, sf), vector(spark, sf), "dot_product", 10), "score")


@register("ann_filtered", topk_sql(COS("embedding", "e"), where="label = 3"))
def ann_filtered(spark, sf):
    rows = vectors(spark, sf)
    keep = Compiler(rows.schema).where({"op": "eq", "field": "label", "value": 3})
    return rounded(ann.exact(rows, vector(spark, sf), "cosine", 10, keep), "score")


@register("ann_by_id_exclude_seed", topk_sql(COS("embedding", "e"), where=f"vec_id <> {SEED}"))
def ann_by_id(spark, sf):
    return rounded(ann.by_id(vectors(spark, sf), SEED, "cosine", 10), "score")


@register("ann_policy_scoped", topk_sql(COS("embedding", "e"), where="label IN (1, 2) AND label <> 1"))
def ann_policy_scoped(spark, sf):
    decision = governance.decide([governance.Grant(frozenset(["query"]), filter={"op": "in", "field": "label", "values": [1, 2]})], "query", "vectors")
    rows = governance.visible(vectors(spark, sf), decision)
    return rounded(ann.exact(rows, vector(spark, sf), "cosine", 10, Compiler(rows.schema).where({"op": "not_eq", "field": "label", "value": 1})), "score")


BATCH = f"""near AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {COS('q.embedding', 'e.embedding')} AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
exact AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, CAST(id AS VARCHAR)) AS rank FROM near)"""


@register("ann_batch_knn", f"WITH {BATCH} SELECT query_id, id, {R('score')} AS score, CAST(rank AS INTEGER) AS rank FROM exact WHERE rank <= 5")
def ann_batch_knn(spark, sf):
    rows = vectors(spark, sf)
    found = ann.batch_knn(rows, rows.where("id % 20 = 0"), "cosine", 5)
    return rounded(found.select(F.col("query_id").cast("long").alias("query_id"), "id", "score", "rank"), "score")


@register("vector_normalize", f"SELECT vec_id AS id, {R('sqrt(' + DOT('embedding', 'embedding') + ')')} AS norm, {R('CAST(embedding[1] AS DOUBLE) / sqrt(' + DOT('embedding', 'embedding') + ')')} AS first FROM embeddings")
def vector_normalize(spark, sf):
    from tessera.operators.distance import norm, normalized

    return rounded(vectors(spark, sf).select("id", norm(F.col("values")).alias("norm"), F.get(normalized(F.col("values")), F.lit(0)).alias("first")), "norm", "first")


# filters

LABELLED = "(SELECT d.doc_id AS id, d.text, d.lang, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def parts(spark, sf):
    return read(spark, sf, "part").withColumn("words", F.split("p_name", " ")).withColumnRenamed("p_partkey", "id")


def labelled(spark, sf):
    d, lab = read(spark, sf, "documents"), read(spark, sf, "labels")
    return d.join(lab, "doc_id", "left").select(F.col("doc_id").alias("id"), "text", "lang", "source", "quality", "toxic")


PART = "(SELECT p_partkey AS id, *, string_split(p_name, ' ') AS words FROM part)"


def filter_query(name: str, rows, relation: str, tree: dict, where: str) -> None:
    def run(spark, sf):
        df = rows(spark, sf)
        return df.where(Compiler(df.schema).where(tree)).select("id")

    register(name, f"SELECT id FROM {relation} x WHERE {where}")(run)


TOKENS_SQL = r"list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'), lambda w: strlen(w) <= 40 AND w NOT IN (" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "))"
WORDS = TOKENS_SQL.format("text")

filter_query("filter_eq", parts, PART, {"op": "eq", "field": "p_brand", "value": "Brand#4"}, "p_brand = 'Brand#4'")
filter_query("filter_eq_int_float", parts, PART, {"op": "eq", "field": "p_size", "value": 11.0}, "p_size = 11")
filter_query("filter_not_eq_missing", labelled, LABELLED, {"op": "not_eq", "field": "quality", "value": 1}, "quality IS NULL OR quality <> 1")
filter_query("filter_range", parts, PART, {"op": "range", "field": "p_size", "gte": 10, "lt": 20}, "p_size >= 10 AND p_size < 20")
filter_query("filter_range_float", parts, PART, {"op": "range", "field": "p_retailprice", "gt": 950.0, "lte": 1000}, "p_retailprice > 950 AND p_retailprice <= 1000")
filter_query("filter_in", parts, PART, {"op": "in", "field": "p_brand", "values": ["Brand#4", "Brand#17", 3]}, "p_brand IN ('Brand#4', 'Brand#17')")
filter_query("filter_not_in", labelled, LABELLED, {"op": "not_in", "field": "toxic", "values": [1]}, "toxic IS NULL OR toxic NOT IN (1)")
filter_query(
    "filter_and_or_not",
    labelled,
    LABELLED,
    {"op": "or", "filters": [{"op": "and", "filters": [{"op": "eq", "field": "lang", "value": "fr"}, {"op": "not", "filter": {"op": "eq", "field": "quality", "value": 1}}]}, {"op": "eq", "field": "source", "value": "src3"}]},
    "(lang = 'fr' AND NOT coalesce(quality = 1, false)) OR source = 'src3'",
)
filter_query("filter_empty_and_or", parts, PART, {"op": "or", "filters": [{"op": "and", "filters": []}, {"op": "or", "filters": []}]}, "true")
filter_query("filter_contains_substring", parts, PART, {"op": "contains", "field": "p_name", "value": "ring"}, "contains(p_name, 'ring')")
filter_query("filter_list_contains", parts, PART, {"op": "contains", "field": "words", "value": "red"}, "list_contains(words, 'red')")
filter_query("filter_list_eq_scalar", parts, PART, {"op": "eq", "field": "words", "value": "bolt"}, "list_contains(words, 'bolt')")
filter_query("filter_list_not_in", parts, PART, {"op": "not_in", "field": "words", "values": ["red", "bolt"]}, "NOT list_has_any(words, ['red', 'bolt'])")
filter_query("filter_unknown_field", parts, PART, {"op": "not", "filter": {"op": "eq", "field": "nothing", "value": 1}}, "true")
filter_query("filter_all_tokens", labelled, LABELLED, {"op": "contains_all_tokens", "field": "text", "query": "Avec the dans pour"}, f"list_has_all({WORDS}, ['avec', 'dans', 'pour'])")
filter_query(
    "filter_token_sequence",
    labelled,
    f"(SELECT id, {WORDS} AS t FROM {LABELLED} y)",
    {"op": "contains_token_sequence", "field": "text", "query": "de la"},
    "contains(' ' || array_to_string(t, ' ') || ' ', ' de la ')",
)


@register("filter_write_scope_3vl", f"SELECT id FROM {LABELLED} x WHERE coalesce(NOT (toxic = 1) AND (quality = 1 OR lang = 'en'), false)")
def filter_write_scope(spark, sf):
    rows = labelled(spark, sf)
    scope = {
        "op": "and",
        "filters": [
            {"op": "not", "filter": {"op": "eq", "field": "toxic", "value": 1}},
            {"op": "or", "filters": [{"op": "eq", "field": "quality", "value": 1}, {"op": "eq", "field": "lang", "value": "en"}]},
        ],
    }
    return rows.where(Compiler(rows.schema).write_scope(scope)).select("id")


@register(
    "filter_cardinality_summary",
    """SELECT field, key, count(*) AS total_rows, count(DISTINCT c) AS clusters FROM (
 SELECT 'lang' AS field, 's:' || lang AS key, doc_id % 8 AS c FROM documents UNION ALL SELECT 'source', 's:' || source, doc_id % 8 FROM documents) WHERE key IS NOT NULL GROUP BY field, key""",
)
def filter_cardinality(spark, sf):
    return bitmap.cardinality_summary(read(spark, sf, "documents").withColumn("cluster_id", F.col("doc_id") % 8), ["lang", "source"])


@register("bitmap_union_count", "SELECT doc_id % 8 AS cluster_id, count(*) AS rows FROM documents WHERE lang = 'fr' OR source = 'src3' GROUP BY 1")
def bitmap_union_count(spark, sf):
    rows = read(spark, sf, "documents").withColumn("cluster_id", F.col("doc_id") % 8).withColumn("pos", F.col("doc_id"))
    maps = bitmap.build(rows, ["lang", "source"]).where("(field = 'lang' AND key = 's:fr') OR (field = 'source' AND key = 's:src3')")
    return bitmap.union_count(maps, ["cluster_id"])


# log and snapshots

LOG = "log AS (SELECT user_id AS id, event_id // 10 AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, event_id AS ord, event_type, value, ts FROM events)"


def last_sql(source: str = "log", rank: str = "CASE WHEN op = 'delete' THEN 0 ELSE 1 END") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC, {rank} DESC, ord DESC) AS rn FROM {source}) WHERE rn = 1)"


HALF = 400


def event_log(spark, sf):
    op = F.when(F.col("event_type") == "error", "delete").otherwise("upsert")
    return read(spark, sf, "events").select(F.col("user_id").alias("id"), F.floor(F.col("event_id") / 10).alias("seq"), op.alias("op"), F.col("event_id").alias("ord"), "event_type", "value", "ts")


def split_log(spark, sf):
    log = event_log(spark, sf)
    segment = replay.live(log.where(F.col("seq") < HALF)).select("id", "event_type", "value")
    return segment, log.where(F.col("seq") >= HALF)


SPLIT = f"""{LOG}, head AS (SELECT * FROM log WHERE seq < {HALF}), tail AS (SELECT * FROM log WHERE seq >= {HALF}),
segment AS (SELECT id, event_type, value FROM {last_sql('head')} WHERE op <> 'delete'), last AS (SELECT * FROM {last_sql('tail')})"""


@register("log_latest_wins", f"WITH {LOG} SELECT id, seq, ord, event_type, value FROM {last_sql()} WHERE op <> 'delete'")
def log_latest(spark, sf):
    return replay.live(event_log(spark, sf)).select("id", "seq", "ord", "event_type", "value")


@register("log_deletes_last", f"WITH {LOG} SELECT id, seq, ord, value FROM {last_sql(rank='''CASE WHEN op = 'delete' THEN 1 ELSE 0 END''')} WHERE op <> 'delete'")
def log_deletes_last(spark, sf):
    return replay.live(event_log(spark, sf), deletes_first=False).select("id", "seq", "ord", "value")


@register("log_tombstones", f"WITH {LOG} SELECT id FROM {last_sql()} WHERE op = 'delete'")
def log_tombstones(spark, sf):
    return replay.tombstones(event_log(spark, sf))


STRONG = f"WITH {SPLIT}, strong AS (SELECT * FROM segment WHERE id NOT IN (SELECT id FROM last) UNION ALL SELECT id, event_type, value FROM last WHERE op <> 'delete')"


@register("log_strong_view", f"{STRONG} SELECT * FROM strong")
def log_strong(spark, sf):
    return replay.strong(*split_log(spark, sf))


@register("log_strong_merge_topk", f"{STRONG} SELECT id, value AS score FROM strong WHERE event_type <> 'view' ORDER BY value DESC, CAST(id AS VARCHAR) LIMIT 10")
def log_strong_topk(spark, sf):
    rows = replay.strong(*split_log(spark, sf)).where("event_type <> 'view'")
    return ann.ordered(rows.select("id", F.col("value").alias("score")), 10, descending=True)


EVENTUAL_LAST = last_sql("(SELECT * FROM tail WHERE seq IN (SELECT seq FROM tail WHERE op = 'delete'))")


@register("log_eventual_view", f"WITH {SPLIT} SELECT * FROM segment WHERE id NOT IN (SELECT id FROM {EVENTUAL_LAST} WHERE op = 'delete')")
def log_eventual(spark, sf):
    return replay.eventual(*split_log(spark, sf))


@register("log_as_of_generation", f"WITH {LOG} SELECT id, seq, value FROM {last_sql('(SELECT * FROM log WHERE seq <= 300)')} WHERE op <> 'delete'")
def log_as_of_generation(spark, sf):
    return replay.live(replay.as_of_version(event_log(spark, sf), 300)).select("id", "seq", "value")


@register(
    "log_as_of_timestamp",
    f"""WITH {LOG}, m AS (SELECT seq AS version, max(ts) AS updated_at FROM log GROUP BY seq), v AS (SELECT max(version) AS v FROM m WHERE updated_at <= TIMESTAMP '2024-01-10 00:00:00')
 SELECT id, seq, value FROM {last_sql('(SELECT log.* FROM log, v WHERE seq <= v.v)')} WHERE op <> 'delete'""",
)
def log_as_of_timestamp(spark, sf):
    log = event_log(spark, sf)
    manifests = log.groupBy(F.col("seq").alias("version")).agg(F.max("ts").alias("updated_at"))
    return replay.live(replay.as_of_version(log, replay.version_at(manifests, "2024-01-10 00:00:00"))).select("id", "seq", "value")


@register("log_delete_by_filter", f"WITH {LOG} SELECT id, CAST(99999 AS BIGINT) AS seq, 'delete' AS op FROM {last_sql()} WHERE op <> 'delete' AND value >= 20")
def log_delete_by_filter(spark, sf):
    rows = replay.live(event_log(spark, sf))
    return replay.deletes_by_filter(rows, Compiler(rows.schema).where({"op": "range", "field": "value", "gte": 20}), 99999)


IDS = [42, 7, 999999, 3, 888888]
IDS_SQL = f"(SELECT unnest({IDS}) AS id, unnest(range({len(IDS)})) AS pos)"


@register("fetch_by_ids", f"SELECT vec_id AS id, label, CAST(pos AS INTEGER) AS pos FROM embeddings JOIN {IDS_SQL} w ON vec_id = w.id")
def fetch_by_ids(spark, sf):
    return replay.fetch(vectors(spark, sf), IDS, ["label"])[0]


@register("fetch_missing", f"SELECT CAST(id AS BIGINT) AS id FROM {IDS_SQL} WHERE id NOT IN (SELECT vec_id FROM embeddings)")
def fetch_missing(spark, sf):
    return replay.fetch(vectors(spark, sf), IDS, ["label"])[1]


@register("membership_upsert_counts", f"WITH {LOG} SELECT op, count(*) AS n, count(DISTINCT seq) AS batches FROM log GROUP BY op")
def upsert_counts(spark, sf):
    return event_log(spark, sf).groupBy("op").agg(F.count("*").alias("n"), F.countDistinct("seq").alias("batches"))


# full text

TOK = f"tok AS (SELECT doc_id AS id, lang, source, {WORDS} AS t FROM documents)"


@register("tokenize_terms", f"WITH {TOK} SELECT id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM tok")
def tokenize_terms(spark, sf):
    t = F.col("t")
    return read(spark, sf, "documents").select(F.col("doc_id").alias("id"), text.tokens(F.col("text"), PLAIN).alias("t")).select("id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ").cast("binary")).alias("digest"))


@register("inverted_postings", f"WITH {TOK}, p AS (SELECT term, id, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM tok) GROUP BY term, id) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, max(tf) AS max_tf FROM p GROUP BY term")
def inverted_postings(spark, sf):
    p = spark.read.parquet(f"{stored.text_index(spark, sf, FIELDS)}/postings").where("field = 'text'")
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))


@register("bm25_idf", f"WITH {TOK}, n AS (SELECT count(*) AS n FROM tok WHERE len(t) > 0) SELECT term, count(DISTINCT id) AS df, {R('ln((n - count(DISTINCT id) + 0.5) / (count(DISTINCT id) + 0.5) + 1)')} AS idf FROM (SELECT id, unnest(t) AS term FROM tok), n GROUP BY term, n")
def bm25_idf(spark, sf):
    path = stored.text_index(spark, sf, FIELDS)
    df = spark.read.parquet(f"{path}/terms").where("field = 'text'")
    stats = spark.read.parquet(f"{path}/lengths").where("field = 'text'").select("n")
    return rounded(df.join(F.broadcast(stats)).select("term", "df", text.idf(F.col("n"), F.col("df")).alias("idf")), "idf")


def ranked(spark, sf, rank_by: list) -> DataFrame:
    return rounded(ann.ordered(index.ranked(spark, stored.text_index(spark, sf, FIELDS), rank_by, FIELDS), 20, True), "score")


def bm25_sql(field: str, query: list[str], prefix: str | None = None, relation: str = "documents", key: str = "doc_id") -> str:
    """Relation (id, score) of one BM25 leaf."""
    words = TOKENS_SQL.format(field)
    times = " + ".join([f"CASE WHEN term = '{w}' THEN 1 ELSE 0 END" for w in query] + ([f"CASE WHEN starts_with(term, '{prefix}') THEN 1 ELSE 0 END"] if prefix else []))
    return f"""(WITH t AS (SELECT {key} AS id, {words} AS t FROM {relation}), s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM t WHERE len(t) > 0),
 h AS (SELECT id, term, dl, count(*) AS tf FROM (SELECT id, unnest(t) AS term, len(t) AS dl FROM t) WHERE ({times}) > 0 GROUP BY id, term, dl),
 d AS (SELECT term, count(*) AS df FROM h GROUP BY term)
 SELECT id, sum(({times}) * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM h JOIN d USING (term), s GROUP BY id)"""


def best_sql(relation: str, k: int = 20, score: str = "score") -> str:
    return f"SELECT id, {R('raw')} AS score FROM (SELECT id, {score} AS raw FROM {relation} z) ORDER BY raw DESC, CAST(id AS VARCHAR) LIMIT {k}"


@register("bm25_single_field", best_sql(bm25_sql("text", ["from", "avec", "from"])))
def bm25_single(spark, sf):
    return rounded(ann.ordered(index.bm25(spark, stored.text_index(spark, sf, FIELDS), "text", "from the avec from", PLAIN), 20, True), "score")


TWO = f"(SELECT coalesce(a.id, b.id) AS id, coalesce(a.score, 0) AS a, coalesce(b.score, 0) AS b FROM {bm25_sql('text', ['avec'])} a FULL JOIN {bm25_sql('source', ['src3'])} b ON a.id = b.id)"


@register("bm25_sum", best_sql(TWO, score="a + b"))
def bm25_sum(spark, sf):
    return ranked(spark, sf, ["Sum", [["text", "BM25", "avec"], ["source", "BM25", "src3"]]])


@register("bm25_max", best_sql(TWO, score="greatest(0, a, b)"))
def bm25_max(spark, sf):
    return ranked(spark, sf, ["Max", [["text", "BM25", "avec"], ["source", "BM25", "src3"]]])


@register("bm25_product", best_sql(TWO, score="2.5 * (a + 0.5 * b)"))
def bm25_product(spark, sf):
    return ranked(spark, sf, ["Product", 2.5, ["Sum", [["text", "BM25", "avec"], ["Product", 0.5, ["source", "BM25", "src3"]]]]])


@register("bm25_prefix", best_sql(bm25_sql("text", ["from"], "enver")))
def bm25_prefix(spark, sf):
    return rounded(ann.ordered(index.bm25(spark, stored.text_index(spark, sf, FIELDS), "text", "from enver", PLAIN, last_as_prefix=True), 20, True), "score")


def merged_prefix_sql(field: str, word: str, prefix: str) -> str:
    """Relation (id, score) of a word and a prefix whose terms count as one."""
    return f"""(WITH t AS (SELECT doc_id AS id, {TOKENS_SQL.format(field)} AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM t WHERE len(t) > 0),
 h AS (SELECT id, term, dl, count(*) AS tf FROM (SELECT id, unnest(t) AS term, len(t) AS dl FROM t) WHERE term = '{word}' OR starts_with(term, '{prefix}') GROUP BY id, term, dl),
 d AS (SELECT term, count(*) AS df FROM h GROUP BY term),
 m AS (SELECT id, dl, sum(tf) AS tf, (SELECT max(df) FROM d WHERE starts_with(term, '{prefix}')) AS df FROM h WHERE starts_with(term, '{prefix}') GROUP BY id, dl
  UNION ALL SELECT id, dl, tf, df FROM h JOIN d USING (term) WHERE term = '{word}')
 SELECT id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM m, s GROUP BY id)"""


@register("bm25_prefix_log", best_sql(merged_prefix_sql("text", "from", "enver")))
def bm25_prefix_log(spark, sf):
    found = text.bm25(read(spark, sf, "documents"), "doc_id", "text", "from enver", PLAIN, last_as_prefix=True, merge_prefix=True)
    return rounded(ann.ordered(found, 20, True), "score")


FRENCH = "(SELECT * FROM documents WHERE lang = 'fr')"


@register("bm25_policy_scoped", best_sql(f"(SELECT b.* FROM {bm25_sql('text', ['avec', 'dans'], relation=FRENCH)} b JOIN documents d ON b.id = d.doc_id WHERE d.source IS NULL OR d.source <> 'src3')"))
def bm25_policy(spark, sf):
    policy = governance.decide([governance.Grant(frozenset(["query"]), filter={"op": "eq", "field": "lang", "value": "fr"})], "query", "texts")
    request = {"rank_by": ["text", "BM25", "avec dans"], "filter": {"op": "not_eq", "field": "source", "value": "src3"}, "top_k": 20, "include_attributes": False}
    return rounded(requests.execute(request, read(spark, sf, "documents").withColumnRenamed("doc_id", "id"), SPEC, policy).results, "score")


# retrieval algebra over vectors joined with texts

SPEC = NamespaceSpec("hybrid", 64, "cosine", {"text": PLAIN, "source": PLAIN})
HYBRID = "hyb AS MATERIALIZED (SELECT e.vec_id AS id, e.embedding, e.label, d.text, d.lang, d.source, l.quality FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id)"


def hybrid(spark, sf):
    d, lab = read(spark, sf, "documents"), read(spark, sf, "labels")
    rows = vectors(spark, sf).join(d.withColumnRenamed("doc_id", "id"), "id").join(lab.withColumnRenamed("doc_id", "id"), "id", "left")
    return rows.select("id", "values", "label", "text", "lang", "source", "quality")


def ask(spark, sf, **request) -> requests.Result:
    """Answer over the stored namespace, every cluster probed; ids as the tables have them."""
    namespace = stored.hybrid(spark, sf, SPEC, lambda: hybrid(spark, sf))
    got = requests.answer({"nprobe": 4096} | request, namespace)
    for name in ("results", "groups", "contributions"):
        if (frame := getattr(got, name)) is not None:
            setattr(got, name, frame.withColumn("id", F.col("id").cast("long")))
    return got


def sources(spark, sf) -> list[dict]:
    return [{"type": "ann", "vector": vector(spark, sf)}, {"type": "bm25", "rank_by": ["text", "BM25", "from avec"]}]


def source_sql(k: int) -> str:
    return f"""{Q}, {HYBRID},
 s0 AS (SELECT *, row_number() OVER (ORDER BY score, CAST(id AS VARCHAR)) AS rank FROM (SELECT id, {COS('embedding', 'e')} AS score FROM hyb, q) ORDER BY rank LIMIT {k}),
 s1 AS (SELECT *, row_number() OVER (ORDER BY score DESC, CAST(id AS VARCHAR)) AS rank FROM {bm25_sql('text', ['from', 'avec'], relation='hyb', key='id')} b ORDER BY rank LIMIT {k})"""


RRF = f"WITH {source_sql(100)}, c AS (SELECT id, 0 AS source, score AS raw, 1.0 / (60 + rank) AS contribution FROM s0 UNION ALL SELECT id, 1, score, 1.0 / (60 + rank) FROM s1), f AS (SELECT id, sum(contribution) AS score FROM c GROUP BY id)"


@register("fusion_rrf", f"{RRF} {best_sql('f', 10)}")
def fusion_rrf(spark, sf):
    return rounded(ask(spark, sf, sources=sources(spark, sf), top_k=10, include_attributes=False).results, "score")


@register("explain_contributions", f"{RRF}, r AS (SELECT id, score FROM f ORDER BY score DESC, CAST(id AS VARCHAR) LIMIT 10) SELECT c.id, CAST(source AS INTEGER) AS source, {R('raw')} AS raw, {R('contribution')} AS contribution, {R('r.score')} AS fused_score FROM c JOIN r ON c.id = r.id")
def explain(spark, sf):
    got = ask(spark, sf, sources=sources(spark, sf), top_k=10, include_attributes=False, explain="full")
    return rounded(algebra.explained(got.contributions, got.results).drop("normalized"), "raw", "contribution", "fused_score")


WEIGHTED = f"""WITH {source_sql(100)}, m0 AS (SELECT min(score) AS lo, max(score) AS hi FROM s0), m1 AS (SELECT min(score) AS lo, max(score) AS hi FROM s1),
 f AS (SELECT id, sum(c) AS score FROM (SELECT id, 0.7 * (hi - score) / (hi - lo) AS c FROM s0, m0 UNION ALL SELECT id, 0.3 * (score - lo) / (hi - lo) FROM s1, m1) GROUP BY id)"""


@register("fusion_weighted", f"{WEIGHTED} {best_sql('f', 10)}")
def fusion_weighted(spark, sf):
    return rounded(ask(spark, sf, sources=sources(spark, sf), top_k=10, fusion={"type": "weighted", "weights": [0.7, 0.3]}, include_attributes=False).results, "score")


@register("rerank_vector", f"{RRF}, r AS (SELECT id FROM f ORDER BY score DESC, CAST(id AS VARCHAR) LIMIT 100) SELECT id, {R('s')} AS score FROM (SELECT hyb.id, {COS('hyb.embedding', 'o.embedding')} AS s FROM hyb JOIN r ON hyb.id = r.id, (SELECT embedding FROM embeddings WHERE vec_id = 3) o) ORDER BY s, CAST(id AS VARCHAR) LIMIT 10")
def rerank_vector(spark, sf):
    return rounded(ask(spark, sf, sources=sources(spark, sf), top_k=10, rerank={"type": "vector", "vector": vector(spark, sf, 3)}, include_attributes=False).results, "score")


ANN100 = f"WITH {Q}, {HYBRID}, a AS (SELECT id, {COS('embedding', 'e')} AS score FROM hyb, q ORDER BY score, CAST(id AS VARCHAR) LIMIT 100)"


@register("rerank_bm25", f"{ANN100}, held AS (SELECT hyb.* FROM hyb JOIN a ON hyb.id = a.id) {best_sql('(SELECT a.id, coalesce(b.score, 0) AS score FROM a LEFT JOIN ' + bm25_sql('text', ['avec', 'from'], relation='held', key='id') + ' b ON a.id = b.id)', 10)}")
def rerank_bm25(spark, sf):
    got = ask(spark, sf, vector=vector(spark, sf), top_k=10, rerank={"type": "bm25", "rank_by": ["text", "BM25", "avec from"]}, include_attributes=False)
    return rounded(got.results, "score")


@register("facets", f"{ANN100}, h AS (SELECT hyb.* FROM hyb JOIN a ON hyb.id = a.id) SELECT field, value, count(*) AS count FROM (SELECT 'lang' AS field, lang AS value FROM h UNION ALL SELECT 'quality', CAST(quality AS VARCHAR) FROM h) WHERE value IS NOT NULL GROUP BY field, value")
def facets(spark, sf):
    return ask(spark, sf, vector=vector(spark, sf), top_k=5, facets=["lang", "quality", "lang"]).facets


@register(
    "grouping_top_groups",
    f"""{ANN100}, r AS (SELECT a.*, row_number() OVER (ORDER BY score, CAST(a.id AS VARCHAR)) AS rank, CASE WHEN quality IS NULL THEN 'missing:' || a.id ELSE 'field:' || quality END AS group_key FROM a JOIN hyb ON a.id = hyb.id),
 g AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY rank) AS rank_in_group, min(rank) OVER (PARTITION BY group_key) AS first FROM r), d AS (SELECT *, dense_rank() OVER (ORDER BY first) AS group_rank FROM g)
 SELECT CAST(group_rank AS INTEGER) AS group_rank, group_key, id, {R('score')} AS score, CAST(rank_in_group AS INTEGER) AS rank_in_group FROM d WHERE group_rank <= 4 AND rank_in_group <= 3""",
)
def grouping(spark, sf):
    return rounded(ask(spark, sf, vector=vector(spark, sf), top_k=4, grouping={"field": "quality", "max_per_group": 3}).groups, "score")


@register("cursor_page2", f"{ANN100} SELECT id, {R('score')} AS score FROM (SELECT * FROM a ORDER BY score, CAST(id AS VARCHAR) LIMIT 10 OFFSET 10)")
def cursor_page2(spark, sf):
    base = {"vector": vector(spark, sf), "top_k": 10, "include_attributes": False}
    first = ask(spark, sf, cursor=None, **base)
    return rounded(ask(spark, sf, cursor=first.next_cursor, **base).results, "score")


@register("field_mask_projection", f"WITH {Q}, {HYBRID} SELECT id, {R('s')} AS score, lang, label FROM (SELECT id, {COS('embedding', 'e')} AS s, lang, label FROM hyb, q WHERE lang = 'en') ORDER BY s, CAST(id AS VARCHAR) LIMIT 10")
def field_mask(spark, sf):
    grant = governance.Grant(frozenset(["query"]), filter={"op": "eq", "field": "lang", "value": "en"}, mask=frozenset(["text", "source", "quality"]))
    got = requests.execute({"vector": vector(spark, sf), "top_k": 10}, hybrid(spark, sf), SPEC, governance.decide([grant], "query", "hybrid"))
    return rounded(got.results, "score")


# quantized codes and clusters

CALIBRATION = "cal AS (SELECT CAST(i AS BIGINT) AS dim, min(x) AS lo, max(x) AS hi FROM (SELECT CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY i)"


@register("sq8_calibration", f"WITH {CALIBRATION} SELECT dim, lo, hi FROM cal")
def sq8_calibration(spark, sf):
    return quant.calibrate(vectors(spark, sf))


DECODED = f"""{CALIBRATION}, each AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(len(embedding))) AS dim FROM embeddings),
 dec AS (SELECT vec_id, list(lo + CASE WHEN hi > lo THEN floor(greatest(0.0, least(255.0, (x - lo) * 255.0 / (hi - lo)))) ELSE 0 END * (hi - lo) / 255.0 ORDER BY dim) AS v FROM each JOIN cal USING (dim) GROUP BY vec_id)"""


@register("sq8_asymmetric_topk", f"WITH {Q}, {DECODED} SELECT id, {R('s')} AS score FROM (SELECT vec_id AS id, {L2('v', 'e')} AS s FROM dec, q) ORDER BY s, CAST(id AS VARCHAR) LIMIT 10")
def sq8_topk(spark, sf):
    rows = vectors(spark, sf)
    return rounded(quant.sq8_topk(rows, vector(spark, sf), "euclidean", 10, *quant.bounds(quant.calibrate(rows))), "score")


@register("sq8_two_stage_rerank", f"WITH {Q}, {DECODED}, coarse AS (SELECT vec_id AS id FROM dec, q ORDER BY {L2('v', 'e')}, CAST(vec_id AS VARCHAR) LIMIT 40) SELECT id, {R('s')} AS score FROM (SELECT vec_id AS id, {L2('embedding', 'e')} AS s FROM embeddings, q WHERE vec_id IN (SELECT id FROM coarse)) ORDER BY s, CAST(id AS VARCHAR) LIMIT 10")
def sq8_rerank(spark, sf):
    rows, q = vectors(spark, sf), vector(spark, sf)
    return rounded(quant.reranked(rows, quant.sq8_topk(rows, q, "euclidean", 40, *quant.bounds(quant.calibrate(rows))), q, "euclidean", 10), "score")


def books(spark, sf) -> np.ndarray:
    """A fixed codebook: the sub-vectors of rows 0 to 15."""
    rows = vectors(spark, sf).where("id < 16").orderBy("id").collect()
    return np.array([r["values"] for r in rows], np.float64).reshape(16, 8, 8).transpose(1, 0, 2)


@register(
    "pq_adc_topk",
    f"""WITH {Q}, sub AS (SELECT vec_id, m, embedding[m * 8 + 1:m * 8 + 8] AS v FROM embeddings, range(8) t(m)),
 near AS (SELECT s.vec_id, s.m, arg_min(b.vec_id, {L2('s.v', 'b.v')} * 1000000 + b.vec_id * 1e-12) AS code FROM sub s JOIN sub b ON s.m = b.m AND b.vec_id < 16 GROUP BY s.vec_id, s.m)
 SELECT id, {R('s')} AS score FROM (SELECT near.vec_id AS id, sum({L2('b.v', 'e[near.m * 8 + 1:near.m * 8 + 8]')}) AS s FROM near JOIN sub b ON b.m = near.m AND b.vec_id = near.code, q GROUP BY near.vec_id) ORDER BY s, CAST(id AS VARCHAR) LIMIT 10""",
)
def pq_topk(spark, sf):
    rows, b = vectors(spark, sf), books(spark, sf)
    return rounded(quant.pq_topk(quant.encode_pq(rows, b), b, vector(spark, sf), "euclidean", 10), "score")


ASSIGN = f"asg AS MATERIALIZED (SELECT e.vec_id AS id, arg_min(c.vec_id, {L2('e.embedding', 'c.embedding')}) AS cluster_id FROM embeddings e, embeddings c WHERE c.vec_id < 16 GROUP BY e.vec_id)"


def fixed_centroids(spark, sf) -> np.ndarray:
    return np.array([r["values"] for r in vectors(spark, sf).where("id < 16").orderBy("id").collect()], np.float64)


@register("ivf_assign_fixed_centroids", f"WITH {ASSIGN} SELECT id, cluster_id FROM asg")
def ivf_assign(spark, sf):
    rows = vectors(spark, sf)
    centroids = rows.where("id < 16").select(F.col("id").alias("cluster_id"), F.col("values").alias("centroid"))
    return ann.assign_columns(rows, centroids).select("id", "cluster_id")


@register("ivf_membership", f"WITH {ASSIGN} SELECT cluster_id, count(*) AS n, min(id) AS first FROM asg GROUP BY cluster_id")
def ivf_membership(spark, sf):
    return ann.membership(ann.assign(vectors(spark, sf), fixed_centroids(spark, sf))).groupBy("cluster_id").agg(F.count("*").alias("n"), F.min("id").alias("first"))


PROBE = f"pr AS (SELECT c.vec_id AS cluster_id FROM embeddings c, q WHERE c.vec_id < 16 ORDER BY {COS('c.embedding', 'e')}, c.vec_id LIMIT 4)"


@register("ivf_probe_topk_fixed_centroids", f"WITH {Q}, {ASSIGN}, {PROBE} SELECT id, {R('s')} AS score FROM (SELECT vec_id AS id, {COS('embedding', 'e')} AS s FROM embeddings JOIN asg ON vec_id = asg.id, q WHERE cluster_id IN (SELECT cluster_id FROM pr)) ORDER BY s, CAST(id AS VARCHAR) LIMIT 10")
def ivf_probe(spark, sf):
    c = fixed_centroids(spark, sf)
    return rounded(ann.ivf_search(ann.assign(vectors(spark, sf), c), c, vector(spark, sf), "cosine", 10, 4), "score")


@register(
    "recall_at_k",
    f"""WITH {BATCH}, {ASSIGN}, top AS (SELECT query_id, id FROM exact WHERE rank <= 10),
 probe AS (SELECT q.vec_id AS query_id, c.vec_id AS cluster_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS('c.embedding', 'q.embedding')}, c.vec_id) AS r FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0 AND c.vec_id < 16),
 hit AS (SELECT top.query_id, count(*) AS hits FROM top JOIN asg ON top.id = asg.id JOIN probe ON probe.query_id = top.query_id AND probe.cluster_id = asg.cluster_id AND r <= 4 GROUP BY top.query_id)
 SELECT q.query_id, coalesce(hits, 0) / 10.0::DOUBLE AS recall FROM (SELECT DISTINCT query_id FROM top) q LEFT JOIN hit USING (query_id)""",
)
def recall(spark, sf):
    rows, c = vectors(spark, sf), fixed_centroids(spark, sf)
    queries = rows.where("id % 20 = 0")
    assigned = ann.assign(rows, c)
    exact = ann.batch_knn(rows, queries, "cosine", 10)
    centers = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(c)], "cluster_id bigint, centroid array<double>")
    from tessera.operators.distance import cosine

    pairs = queries.crossJoin(F.broadcast(centers)).select(F.col("id").alias("query_id"), F.col("values").alias("q"), "cluster_id", cosine(F.col("centroid"), F.col("values")).alias("d"))
    near = Window.partitionBy("query_id").orderBy("d", "cluster_id")
    probes = pairs.withColumn("r", F.row_number().over(near)).where("r <= 4").select("query_id", "q", "cluster_id")
    scored = assigned.join(probes, "cluster_id").select("query_id", "id", cosine(F.col("values"), F.col("q")).alias("score"))
    found = replay.ranked_window(scored, "query_id").where("rank <= 10").select(F.col("query_id").cast("string").alias("query_id"), "id")
    return ann.recall(exact, found, 10).select(F.col("query_id").cast("long").alias("query_id"), "recall")


@register("maxsim_topk", f"WITH qs AS (SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id < 3), best AS (SELECT vec_id // 5 AS id, q, max({DOT('embedding', 'e')}) AS m FROM embeddings, qs GROUP BY 1, 2) SELECT id, {R('s')} AS score FROM (SELECT id, sum(m) AS s FROM best GROUP BY id) ORDER BY s DESC, CAST(id AS VARCHAR) LIMIT 10")
def maxsim(spark, sf):
    rows = vectors(spark, sf)
    query = [list(r["values"]) for r in rows.where("id < 3").orderBy("id").collect()]
    return rounded(late.maxsim(rows.select(F.floor(F.col("id") / 5).alias("id"), F.col("values").alias("vec")), query, 10), "score")


@register("semantic_coverage", "SELECT count(*) AS total, count(*) FILTER (e.vec_id IS NOT NULL AND e.label < 8) AS covered, count(*) FILTER (e.label >= 8) AS failed, count(*) FILTER (e.vec_id IS NULL) AS pending FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id")
def coverage(spark, sf):
    live = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit(1).alias("version"))
    done = vectors(spark, sf).select("id", F.lit(1).alias("version"), F.when(F.col("label") < 8, "ready").otherwise("failed").alias("status"))
    return late.coverage(live, done)


# sizing


@register("content_hash", "SELECT doc_id AS id, sha256('{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}') AS content_hash FROM documents")
def content_hash(spark, sf):
    from tessera.sources.upserts import content_hash as digest

    return read(spark, sf, "documents").select(F.col("doc_id").alias("id"), digest("doc_id", "lang", "source").alias("content_hash"))


@register("encoder_coverage", r"SELECT CASE WHEN trim(coalesce(text, '')) = '' THEN 'failed' ELSE 'ready' END AS status, count(*) AS n, CAST(sum(len(regexp_extract_all(text, '\S+'))) AS BIGINT) AS vectors FROM benchmark GROUP BY 1")
def encoder_coverage(spark, sf):
    from tessera.operators.encoders import HashEncoder, enrich
    from tessera.sources.upserts import units

    rows = read(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.lit("text").alias("type"), "text", F.lit(None).cast("binary").alias("image"))
    done = enrich(units(rows), HashEncoder())
    return done.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.size("matrix")).alias("vectors"))


@register(
    "sizing_predict",
    f"""WITH c AS (SELECT CAST(n_nationkey AS BIGINT) AS case_id, n_nationkey + 1 AS clients, 3 AS stages, 16e6 AS bytes_per_query, 38.0 AS gets_per_query, 15.0 AS ttfb_p50, 60.0 AS ttfb_p99, 80.0 AS conn_mbps, 1000.0 AS node_mbps, 1 + n_nationkey % 3 AS nodes, 2.0 AS cpu_ms, 4e-7 AS price_get, 0.4 AS price_hour FROM nation),
 p AS (SELECT *, cpu_ms + stages * ttfb_p50 + bytes_per_query / 1e6 / least(conn_mbps * gets_per_query / stages, node_mbps * nodes) * 1000.0 AS p50, cpu_ms + stages * ttfb_p99 + bytes_per_query / 1e6 / least(conn_mbps * gets_per_query / stages, node_mbps * nodes) * 1000.0 AS p99 FROM c),
 r AS (SELECT *, least(node_mbps * nodes / (bytes_per_query / 1e6), clients / (p50 / 1000.0)) AS qps FROM p)
 SELECT case_id, {R('p50')} AS p50_ms, {R('p99')} AS p99_ms, {R('qps')} AS qps, {R('clients / qps * 1000.0')} AS mean_ms, CASE WHEN node_mbps * nodes / (bytes_per_query / 1e6) <= clients / (p50 / 1000.0) THEN 'bandwidth' ELSE 'closed_loop' END AS bottleneck FROM r""",
)
def sizing_predict(spark, sf):
    consts = {"stages": 3, "bytes_per_query": 16e6, "gets_per_query": 38.0, "ttfb_p50": 15.0, "ttfb_p99": 60.0, "conn_mbps": 80.0, "node_mbps": 1000.0, "cpu_ms": 2.0, "price_get": 4e-7, "price_hour": 0.4}
    n = F.col("n_nationkey")
    cases = read(spark, sf, "nation").select(n.cast("long").alias("case_id"), (n + 1).alias("clients"), (1 + n % 3).alias("nodes"), *[F.lit(v).alias(k) for k, v in consts.items()])
    return rounded(sizing.predict(cases).select("case_id", "p50_ms", "p99_ms", "qps", "mean_ms", "bottleneck"), "p50_ms", "p99_ms", "qps", "mean_ms")


# queries that SQL can't express: rows only


@register("ivf_trained_topk")
def ivf_trained(spark, sf):
    rows = vectors(spark, sf)
    c = ann.train_centroids(rows, 16)
    return rounded(ann.ivf_search(ann.assign(rows, c), c, vector(spark, sf), "cosine", 10, 8), "score")


@register("hierarchical_topk")
def hierarchical(spark, sf):
    tree, held = ann.Tree.build(vectors(spark, sf), 4, 100)
    return rounded(tree.search(held, vector(spark, sf), "cosine", 10, 3), "score")


@register("two_bit_rerank_topk")
def two_bit(spark, sf):
    rows, q = vectors(spark, sf), vector(spark, sf)
    return rounded(quant.reranked(rows, quant.two_bit_topk(rows, q, "cosine", 40), q, "cosine", 10), "score")


@register("fde_late_topk")
def fde_late(spark, sf):
    rows = vectors(spark, sf)
    query = [list(r["values"]) for r in rows.where("id < 3").orderBy("id").collect()]
    docs = rows.groupBy(F.floor(F.col("id") / 5).alias("id")).agg(F.sort_array(F.collect_list(F.struct("id", "values"))).alias("m")).select("id", F.col("m.values").alias("matrix"))
    encoder = late.FixedEncoder(64)
    return rounded(late.late_search(docs, late.encode_documents(docs, encoder), encoder, query, 10, 50), "score")


@register("stemmed_bm25")
def stemmed_bm25(spark, sf):
    path = stored.text_index(spark, sf, {"text": TextField()})
    return rounded(ann.ordered(index.bm25(spark, path, "text", "having there from", TextField()), 20, True), "score")


# stored index


def nearest(spark, sf, changed: bool = False, **request) -> DataFrame:
    got = requests.answer({"vector": vector(spark, sf), "include_attributes": False, "nprobe": 16} | request, stored.vectors(spark, sf, changed)).results
    return rounded(got.withColumn("id", F.col("id").cast("long")), "score")


@register("index_full_probe_topk", topk_sql(COS("embedding", "e")))
def index_full_probe(spark, sf):
    return nearest(spark, sf)


@register("index_filtered_topk", topk_sql(COS("embedding", "e"), where="label IN (3, 4)"))
def index_filtered(spark, sf):
    return nearest(spark, sf, filter={"op": "in", "field": "label", "values": [3, 4]})


CHANGED = f"""WITH {Q}, now AS (SELECT vec_id, CASE WHEN vec_id % 10 = 1 THEN list_transform(embedding, lambda x: -x) ELSE embedding END AS embedding,
 CASE WHEN vec_id % 10 = 1 THEN 99 ELSE label END AS label FROM embeddings WHERE vec_id % 10 <> 0)"""


@register("index_log_overlay_topk", f"{CHANGED} SELECT id, {R('raw')} AS score FROM (SELECT vec_id AS id, {COS('embedding', 'e')} AS raw FROM now, q) ORDER BY raw, CAST(id AS VARCHAR) LIMIT 10")
def index_log_overlay(spark, sf):
    return nearest(spark, sf, changed=True)


@register("index_log_overlay_filtered", f"{CHANGED} SELECT id, {R('raw')} AS score FROM (SELECT vec_id AS id, {COS('embedding', 'e')} AS raw FROM now, q WHERE label = 99) ORDER BY raw, CAST(id AS VARCHAR) LIMIT 10")
def index_log_overlay_filtered(spark, sf):
    return nearest(spark, sf, changed=True, filter={"op": "eq", "field": "label", "value": 99})


@register("index_as_of_topk", topk_sql(COS("embedding", "e")))
def index_as_of(spark, sf):
    return nearest(spark, sf, changed=True, as_of=1)


@register("index_bitmap_count", "SELECT CAST(count(*) FILTER (label IN (1, 2)) AS BIGINT) AS either, CAST(count(*) FILTER (label = 1 AND label = 2) AS BIGINT) AS both FROM embeddings")
def index_bitmap_count(spark, sf):
    namespace = stored.vectors(spark, sf)
    m = namespace.manifest()
    one, two = ({"op": "eq", "field": "label", "value": v} for v in (1, 2))
    counts = [
        index.counted(spark, namespace.folder(m), {"op": op, "filters": [one, two]}, m["segment"]["index"], namespace.row_schema).agg(F.coalesce(F.sum("rows"), F.lit(0).cast("long")).alias(name))
        for op, name in (("or", "either"), ("and", "both"))
    ]
    return counts[0].join(F.broadcast(counts[1]))


from tessera.plans import operations  # noqa: E402, F401  (registers its queries)
