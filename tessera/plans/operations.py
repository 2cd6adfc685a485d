"""Registered queries over what namespaces, policies, requests and plans of cost do, with their DuckDB oracles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import ann, codecs, governance, late, quant
from tessera.operators.distance import centered, dot, literal, norm
from tessera.plans import request as requests
from tessera.plans import sizing, stored
from tessera.plans.catalogue import COS, DOT, HYBRID, RRF, SPEC, SPLIT, Q, R, ask, best_sql, bm25_sql, labelled, read, register, rounded, sources, split_log, topk_sql, vector, vectors
from tessera.sources import log as replay
from tessera.sources.store import Namespace
from tessera.spec import cluster_count, default_nprobe

# a namespace's life

LOADED = "loaded AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, s_nationkey AS nation, s_acctbal AS balance FROM supplier)"
DELETED = f"{LOADED}, held AS (SELECT * FROM loaded WHERE NOT (balance < 0) AND id NOT IN ('1', '2', '3'))"
NOW = f"{DELETED}, now AS (SELECT * FROM held WHERE id <> '4' UNION ALL SELECT * FROM (VALUES ('2', 77, CAST(NULL AS DOUBLE)), ('new', NULL, 1.5), ('4', NULL, 2.5)) v)"


def rows_of(spark, sf: str, name: str, as_of=None) -> DataFrame:
    return Namespace.open(spark, stored.suppliers(spark, sf), name).snapshot(as_of).select("id", "nation", "balance")


@register("ns_named_snapshot", f"WITH {LOADED} SELECT * FROM loaded")
def ns_named_snapshot(spark, sf):
    return rows_of(spark, sf, "suppliers", "snapshot:loaded")


@register("ns_deletes", f"WITH {DELETED} SELECT * FROM held")
def ns_deletes(spark, sf):
    return rows_of(spark, sf, "suppliers", 3)


@register("ns_upsert_forms", f"WITH {NOW} SELECT * FROM now")
def ns_upsert_forms(spark, sf):
    return rows_of(spark, sf, "suppliers")


@register("ns_fork", f"WITH {LOADED} SELECT * FROM loaded WHERE nation IS NULL OR nation <> 7")
def ns_fork(spark, sf):
    return rows_of(spark, sf, "child")


@register("ns_clone_as_of", f"WITH {DELETED} SELECT * FROM held")
def ns_clone(spark, sf):
    return rows_of(spark, sf, "copy")


@register("ns_compacted", f"WITH {NOW} SELECT * FROM now")
def ns_compacted(spark, sf):
    namespace = Namespace.open(spark, stored.suppliers(spark, sf), "packed")
    return namespace.segment(namespace.manifest()).select("id", "nation", "balance")


STRONG_BEST = "SELECT id, value AS score FROM (SELECT id, event_type, value FROM segment WHERE id NOT IN (SELECT id FROM last) UNION ALL SELECT id, event_type, value FROM last WHERE op <> 'delete') WHERE event_type <> 'view' ORDER BY value DESC, CAST(id AS VARCHAR) LIMIT 10"


@register("log_merged_hits", f"WITH {SPLIT} {STRONG_BEST}")
def log_merged_hits(spark, sf):
    segment, log = split_log(spark, sf)
    hits = lambda rows: rows.where("event_type <> 'view'").select("id", F.col("value").alias("score"))
    return replay.merged(hits(segment), hits(replay.live(log)), log, 10, descending=True)


# policies

GRANTS = [
    governance.Grant(frozenset(["query", "write"]), filter={"op": "in", "field": "lang", "values": ["fr", "en"]}, mask=frozenset(["text"]), stamp={"toxic": 9}),
    governance.Grant(frozenset(["query", "write"]), "docu*", {"op": "not_eq", "field": "source", "value": "src3"}, frozenset(["quality"]), forbid_set=frozenset(["quality"])),
    governance.Grant(frozenset(["query"]), "other", {"op": "eq", "field": "lang", "value": "de"}),
]
SEEN = "SELECT d.doc_id AS id, d.text, d.lang, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


@register("grants_combined", f"SELECT id, lang, source, toxic FROM ({SEEN}) WHERE lang IN ('fr', 'en') AND (source IS NULL OR source <> 'src3')")
def grants_combined(spark, sf):
    return governance.visible(labelled(spark, sf), governance.decide(GRANTS, "query", "documents"))


@register("write_stamped", f"SELECT id, lang, source, quality, CAST(9 AS INTEGER) AS toxic FROM ({SEEN})")
def write_stamped(spark, sf):
    rows = labelled(spark, sf).drop("text")
    changed = rows.withColumn("quality", F.lit(5))
    return governance.stamped(changed, governance.decide(GRANTS, "write", "documents"), rows).select("id", "lang", "source", F.col("quality").cast(rows.schema["quality"].dataType).alias("quality"), "toxic")


@register("write_violations", f"SELECT id FROM ({SEEN}) WHERE quality IS NOT NULL OR NOT coalesce(lang IN ('fr', 'en') AND source <> 'src3', false)")
def write_violations(spark, sf):
    return governance.violations(labelled(spark, sf), governance.decide(GRANTS, "write", "documents")).select("id")


# requests


@register("request_rank_by", f"WITH {HYBRID} {best_sql(bm25_sql('text', ['from', 'avec'], relation='hyb', key='id'), 10)}")
def request_rank_by(spark, sf):
    return rounded(ask(spark, sf, rank_by=["text", "BM25", "from avec"], top_k=10, include_attributes=False).results, "score")


@register("fusion_attributes", f"{RRF}, r AS ({best_sql('f', 10)}) SELECT r.id, r.score, label, text, lang, source, quality FROM r JOIN hyb ON r.id = hyb.id")
def fusion_attributes(spark, sf):
    return rounded(ask(spark, sf, sources=sources(spark, sf), top_k=10).results, "score")


@register("request_default_top_k", topk_sql(COS("embedding", "e"), 3))
def request_default_top_k(spark, sf):
    got = requests.answer({"vector": vector(spark, sf), "include_attributes": False, "nprobe": 16}, stored.vectors(spark, sf), defaults={"default_top_k": 3}).results
    return rounded(got.withColumn("id", F.col("id").cast("long")), "score")


BATCH_SQL = f"""WITH {Q}, a AS (SELECT 0 AS no, vec_id AS id, {COS('embedding', 'e')} AS raw FROM embeddings, q ORDER BY raw, CAST(id AS VARCHAR) LIMIT 5),
 b AS (SELECT 2 AS no, vec_id AS id, {COS('embedding', 'e')} AS raw FROM embeddings, q WHERE label = 3 ORDER BY raw, CAST(id AS VARCHAR) LIMIT 4)
 SELECT no, id, {R('raw')} AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b)"""


@register("request_batch", BATCH_SQL)
def request_batch(spark, sf):
    """Three entries, of which the second is refused alone."""
    base = {"vector": vector(spark, sf), "include_attributes": False, "nprobe": 16}
    got = requests.answer_batch([base | {"top_k": 5}, base | {"top_k": 0}, base | {"top_k": 4, "filter": {"op": "eq", "field": "label", "value": 3}}], stored.vectors(spark, sf))
    parts = [r.results.select(F.lit(no).alias("no"), F.col("id").cast("long").alias("id"), "score") for no, r in enumerate(got) if isinstance(r, requests.Result)]
    return rounded(parts[0].unionByName(parts[1]), "score")


@register("index_eventual_topk", topk_sql(COS("embedding", "e"), where="vec_id % 10 <> 0"))
def index_eventual(spark, sf):
    """The eventual view of a log that deletes every tenth row: those are gone, its other changes aren't seen yet."""
    got = requests.answer({"vector": vector(spark, sf), "include_attributes": False, "nprobe": 16, "consistency": "eventual"}, stored.vectors(spark, sf, True)).results
    return rounded(got.withColumn("id", F.col("id").cast("long")), "score")


# late interaction


def matrices(spark, sf) -> DataFrame:
    """Rows of five vectors each, with the least label."""
    of = F.floor(F.col("id") / 5)
    rows = vectors(spark, sf).groupBy(of.alias("id")).agg(F.sort_array(F.collect_list(F.struct("id", "values"))).alias("m"), F.min("label").alias("label"))
    return rows.select("id", F.col("m.values").alias("matrix"), F.element_at("m.values", 1).alias("values"), "label")


def queried(spark, sf) -> list[list[float]]:
    return [list(r["values"]) for r in vectors(spark, sf).where("id < 3").orderBy("id").collect()]


MAXSIM = f"""qs AS (SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id < 3), lab AS (SELECT vec_id // 5 AS id, min(label) AS label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY 1),
 best AS (SELECT vec_id // 5 AS id, q, max({DOT('embedding', 'e')}) AS m FROM embeddings, qs GROUP BY 1, 2), ms AS (SELECT id, sum(m) AS s FROM best GROUP BY id)"""


def late_request(spark, sf, **request) -> DataFrame:
    return rounded(requests.execute({"top_k": 10, "include_attributes": False} | request, matrices(spark, sf), SPEC).results, "score")


@register("late_source_topk", f"WITH {MAXSIM} SELECT id, {R('s')} AS score FROM ms ORDER BY s DESC, CAST(id AS VARCHAR) LIMIT 10")
def late_source(spark, sf):
    return late_request(spark, sf, sources=[{"type": "late_interaction", "field": "matrix", "vectors": queried(spark, sf)}])


@register("late_source_filtered", f"WITH {MAXSIM} SELECT id, {R('s')} AS score FROM ms JOIN lab USING (id) WHERE label > 1 ORDER BY s DESC, CAST(id AS VARCHAR) LIMIT 10")
def late_filtered(spark, sf):
    return late_request(spark, sf, sources=[{"type": "late_interaction", "field": "matrix", "vectors": queried(spark, sf)}], filter={"op": "range", "field": "label", "gt": 1})


@register(
    "late_fusion",
    f"""WITH {Q}, {MAXSIM}, s0 AS (SELECT id, row_number() OVER (ORDER BY d, CAST(id AS VARCHAR)) AS rank FROM (SELECT id, {COS('embedding', 'q.e')} AS d FROM lab, q) ORDER BY rank LIMIT 100),
 s1 AS (SELECT id, row_number() OVER (ORDER BY s DESC, CAST(id AS VARCHAR)) AS rank FROM ms ORDER BY rank LIMIT 100),
 f AS (SELECT id, sum(1.0 / (60 + rank)) AS score FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1) GROUP BY id) {best_sql('f', 10)}""",
)
def late_fusion(spark, sf):
    both = [{"type": "ann", "vector": vector(spark, sf)}, {"type": "late_interaction", "field": "matrix", "vectors": queried(spark, sf)}]
    return late_request(spark, sf, sources=both)


@register(
    "late_overlay_topk",
    f"""WITH {MAXSIM}, seg AS (SELECT ms.id, s FROM ms JOIN lab USING (id) WHERE label <> 1 UNION ALL SELECT id, -2 * s FROM ms JOIN lab USING (id) WHERE label = 1)
 SELECT id, {R('s')} AS score FROM seg ORDER BY s DESC, CAST(id AS VARCHAR) LIMIT 10""",
)
def late_overlay(spark, sf):
    """A log that has changed the rows of one label: their scores there count, not the segment's."""
    rows = matrices(spark, sf)
    scored = late.matrix_scores(rows, queried(spark, sf))
    touched = rows.where("label = 1").select("id")
    log = scored.join(touched, "id", "left_semi").select("id", (F.col("score") * -2).alias("score"))
    return rounded(late.overlay(scored, log, touched, 10), "score")


def HALF(x: str) -> str:  # noqa: N802
    """A number as the nearest half float, of two equally near ones the even one."""
    step = f"pow(2.0, greatest(floor(log2(abs({x}))), -14) - 10)"
    return f"CASE WHEN {x} = 0 THEN 0.0 ELSE round_even({x} / {step}, 0) * {step} END"


def stored_maxsim_sql(values: str) -> str:
    """MaxSim of rows whose stored numbers are ``values``."""
    return f"""WITH qs AS (SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id < 3), {values},
 best AS (SELECT vec_id // 5 AS id, q, max({DOT('v', 'e')}) AS m FROM held, qs GROUP BY 1, 2), ms AS (SELECT id, sum(m) AS s FROM best GROUP BY id)
 SELECT id, {R('s')} AS score FROM ms ORDER BY s DESC, CAST(id AS VARCHAR) LIMIT 10"""


def stored_maxsim(spark, sf, group: int | None) -> DataFrame:
    kept = matrices(spark, sf).select("id", codecs.packed(F.col("matrix"), group).alias("bytes"))
    return rounded(late.maxsim_matrices(kept.select("id", codecs.unpacked(F.col("bytes")).alias("matrix")), queried(spark, sf), 10), "score")


@register("matrix_half_maxsim", stored_maxsim_sql(f"held AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: {HALF('x')}) AS v FROM embeddings)"))
def matrix_half_maxsim(spark, sf):
    return stored_maxsim(spark, sf, None)


@register(
    "matrix_int8_maxsim",
    stored_maxsim_sql(
        f"""parts AS (SELECT vec_id, g, list_transform(CAST(embedding AS DOUBLE[])[g * 32 + 1:g * 32 + 32], lambda x: x) AS p FROM embeddings, range(2) t(g)),
 scaled AS (SELECT vec_id, g, p, list_max(list_transform(p, lambda x: abs(x))) / 127.0 AS s FROM parts),
 coded AS (SELECT vec_id, g, s, list_transform(p, lambda x: CASE WHEN s = 0 THEN 0.0 ELSE round_even(x / s, 0) END) AS c FROM scaled),
 sized AS (SELECT vec_id, sqrt(sum(s * s * list_dot_product(c, c))) AS size FROM coded GROUP BY vec_id),
 folded AS (SELECT vec_id, g, c, CASE WHEN size = 0 THEN 0.0 ELSE s / size END AS f FROM coded JOIN sized USING (vec_id)),
 halves AS (SELECT vec_id, g, c, {HALF('f')} AS h FROM folded),
 held AS (SELECT vec_id, flatten(list(list_transform(c, lambda x: x * h) ORDER BY g)) AS v FROM halves GROUP BY vec_id)"""
    ),
)
def matrix_int8_maxsim(spark, sf):
    return stored_maxsim(spark, sf, 32)


# vectors, codes and trained structures


SIGNS = f"{Q}, u AS (SELECT list_transform(CAST(e AS DOUBLE[]), lambda x: x / sqrt({DOT('e', 'e')})) AS u FROM q)"
ONE_BIT = "list_dot_product(list_transform(embedding, lambda x: CASE WHEN x < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END), {}) * sqrt(" + DOT("embedding", "embedding") + ") / list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x)))"


def one_bit_sql(query: str, more: str = "") -> str:
    return f"WITH {SIGNS}{more} SELECT id, {R('raw')} AS score FROM (SELECT vec_id AS id, 1 - {ONE_BIT.format(query)} AS raw FROM embeddings, u{', w' if more else ''}) ORDER BY raw, CAST(id AS VARCHAR) LIMIT 10"


@register("one_bit_topk", one_bit_sql("u"))
def one_bit_topk(spark, sf):
    """Codes of the vectors as they are: a rotation is drawn at random, which SQL can't repeat."""
    return rounded(quant.two_bit_topk(vectors(spark, sf), vector(spark, sf), "cosine", 10, encode=quant.one_bit, rotate=False), "score")


DRAWS = ", ".join(repr(float(x)) + "::DOUBLE" for x in np.random.default_rng(7).random(64))


@register(
    "one_bit_query4_topk",
    one_bit_sql("w", f", b AS (SELECT u, list_min(u) AS low, (list_max(u) - list_min(u)) / 15 AS step FROM u), w AS (SELECT list_transform(list_zip(u, [{DRAWS}]), lambda z: low + step * greatest(0, least(15, floor((z[1] - low) / step + z[2])))) AS w FROM b)"),
)
def one_bit_query4_topk(spark, sf):
    return rounded(quant.two_bit_topk(vectors(spark, sf), vector(spark, sf), "cosine", 10, encode=quant.one_bit, rotate=False, four_bits=True), "score")



@register("rotation_keeps_products", f"WITH {Q} SELECT vec_id AS id, {R(DOT('embedding', 'e'))} AS product, {R('sqrt(' + DOT('embedding', 'embedding') + ')')} AS norm FROM embeddings, q")
def rotation_keeps_products(spark, sf):
    rotation = quant.Rotation(64)
    turned = rotation.apply(np.array([vector(spark, sf)]))[0]
    rows = quant.rotated(vectors(spark, sf), rotation)
    return rounded(rows.select("id", dot(F.col("values"), literal(list(map(float, turned)))).alias("product"), norm(F.col("values")).alias("norm")), "product", "norm")


MEAN = "mean AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(x) AS m FROM (SELECT CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY i))"


@register("vector_centered", f"WITH {MEAN}, c AS (SELECT vec_id AS id, list_transform(list_zip(CAST(embedding AS DOUBLE[]), m), lambda z: z[1] - z[2]) AS c FROM embeddings, mean) SELECT id, {R('c[1] / sqrt(list_dot_product(c, c))')} AS first, {R('c[64] / sqrt(list_dot_product(c, c))')} AS last FROM c")
def vector_centered(spark, sf):
    rows = vectors(spark, sf)
    mean = rows.select(F.posexplode("values").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m")).orderBy("i").collect()
    c = centered(F.col("values"), [r["m"] for r in mean])
    return rounded(rows.select("id", c.alias("c")).select("id", F.get("c", F.lit(0)).alias("first"), F.get("c", F.lit(63)).alias("last")), "first", "last")


@register("ivf_trained_full_probe", topk_sql(COS("embedding", "e")))
def ivf_trained_full_probe(spark, sf):
    rows = vectors(spark, sf)
    c = ann.balanced(rows, ann.train_centroids(rows, 8))
    return rounded(ann.ivf_search(ann.assign(rows, c), c, vector(spark, sf), "cosine", 10, len(c)), "score")


@register("hierarchical_full_beam", topk_sql(COS("embedding", "e")))
def hierarchical_full_beam(spark, sf):
    tree, held = ann.Tree.build(vectors(spark, sf), 4, 200)
    return rounded(tree.search(held, vector(spark, sf), "cosine", 10, len(tree.centers)), "score")


# sizes and costs


def cases(spark, sf) -> list[int]:
    return sorted(r["n_nationkey"] for r in read(spark, sf, "nation").select("n_nationkey").collect())


@register("cluster_policy", "WITH c AS (SELECT n_nationkey AS case_id, CAST(n_nationkey AS BIGINT) * n_nationkey * n_nationkey * 1000 AS n FROM nation), k AS (SELECT case_id, n, CASE WHEN n = 0 THEN 0 ELSE least(greatest(CAST(ceil(n / 3000.0) AS BIGINT), 256), 4096, n) END AS clusters FROM c) SELECT CAST(case_id AS BIGINT) AS case_id, CAST(clusters AS BIGINT) AS clusters, CAST(least(least(greatest(ceil(clusters * 3 / 16.0), 32), 256), clusters) AS BIGINT) AS nprobe FROM k")
def cluster_policy(spark, sf):
    rows = [(i, cluster_count(i**3 * 1000), default_nprobe(cluster_count(i**3 * 1000))) for i in cases(spark, sf)]
    return spark.createDataFrame(rows, "case_id bigint, clusters bigint, nprobe bigint")


@register("sizing_row_bytes", "WITH c AS (SELECT n_nationkey AS case_id, (n_nationkey + 1) * 64 AS d, CAST(ceil((n_nationkey + 1) * 64 / 256.0) AS INTEGER) * 256 AS p FROM nation) SELECT CAST(case_id AS BIGINT) AS case_id, kind, CAST(bytes AS BIGINT) AS bytes FROM (SELECT case_id, 'none' AS kind, 4 * d AS bytes FROM c UNION ALL SELECT case_id, 'scalar', d FROM c UNION ALL SELECT case_id, 'two_bit', p // 4 + 8 FROM c UNION ALL SELECT case_id, 'one_bit', p // 8 + 8 FROM c UNION ALL SELECT case_id, 'product', 8 FROM c)")
def sizing_row_bytes(spark, sf):
    rows = [(i, kind, sizing.row_bytes(kind, 64 * (i + 1))) for i in cases(spark, sf) for kind in ("none", "scalar", "two_bit", "one_bit", "product")]
    return spark.createDataFrame(rows, "case_id bigint, kind string, bytes bigint")


@register("sizing_expected_groups", "SELECT CAST(n_nationkey AS BIGINT) AS case_id, round(100.0 * (1 - pow(1 - 1 / 100.0, n_nationkey * 7))) AS touched, round(300.0 * (1 - pow(1 - 3.0 / 300.0, n_nationkey * 7))) AS clusters FROM nation")
def sizing_expected_groups(spark, sf):
    n = F.col("n_nationkey")
    return read(spark, sf, "nation").select(n.cast("long").alias("case_id"), sizing.distinct_groups(F.lit(100.0), n * 7).alias("touched"), sizing.grouped_coverage(F.lit(300.0), n * 7).alias("clusters"))


@register("sizing_lognormal", f"SELECT CAST(n_nationkey AS BIGINT) AS case_id, {R('ln(10 + n_nationkey)')} AS mu, {R('ln((40 + 3.0 * n_nationkey) / (10 + n_nationkey)) / 2.3263478740408408')} AS sigma FROM nation")
def sizing_lognormal(spark, sf):
    rows = [(i, *sizing.lognormal(10 + i, 40 + 3 * i)) for i in cases(spark, sf)]
    return rounded(spark.createDataFrame(rows, "case_id bigint, mu double, sigma double"), "mu", "sigma")


@register(
    "sizing_hardware",
    f"""WITH c AS (SELECT CAST(n_nationkey AS BIGINT) AS case_id, 64 AS clients, 1 + n_nationkey AS nodes, 15.0 + n_nationkey * 5 AS ttfb FROM nation),
 p AS (SELECT *, 2.0 + 3 * ttfb + 16.0 / least(80.0 * 38 / 3, 500.0 * nodes) * 1000.0 AS p50, 2.0 + 3 * 4 * ttfb + 16.0 / least(80.0 * 38 / 3, 500.0 * nodes) * 1000.0 AS p99 FROM c),
 r AS (SELECT *, least(500.0 * nodes / 16.0, clients / (p50 / 1000.0)) AS qps FROM p)
 SELECT case_id, CASE WHEN qps < 100 THEN 'throughput' WHEN p99 > 1200 THEN 'latency' END AS rejected, {R('38.0 * 4e-7 + nodes * 0.4 / (qps * 3600.0)')} AS cost_per_query FROM r""",
)
def sizing_hardware(spark, sf):
    n = F.col("n_nationkey")
    consts = {"clients": 64, "stages": 3, "bytes_per_query": 16e6, "gets_per_query": 38.0, "conn_mbps": 80.0, "node_mbps": 500.0, "cpu_ms": 2.0, "price_get": 4e-7, "price_hour": 0.4}
    rows = read(spark, sf, "nation").select(n.cast("long").alias("case_id"), (1 + n).alias("nodes"), (15.0 + n * 5).alias("ttfb_p50"), (4 * (15.0 + n * 5)).alias("ttfb_p99"), *[F.lit(v).alias(k) for k, v in consts.items()])
    return rounded(sizing.ranked_hardware(rows, 100, 1200).select("case_id", "rejected", "cost_per_query"), "cost_per_query")

