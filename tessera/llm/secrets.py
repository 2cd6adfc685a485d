"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Base kinds are found in each whole text. Candidates of further kinds (provider
tokens, web tokens, key blocks, URL passwords) are added when the corpus shows
them as owner-specific. For each candidate value the number of distinct owners
and repositories is counted over the whole corpus: a value seen with more than
``max_owners`` owners is a widely copied example, any other is live-looking.
Owners alone decide; the number of repositories is reported with each span.

Positions come from splitting the text at the matches: the lengths of the
pieces and of the matches add up to code point offsets.

Defined results: null text is empty text and has no spans. A null owner or
repository counts as one owner named ''. Repeated rows (also of one doc_id) each
get their own result row. Extra columns of the input are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import saved, table, text_of

#: Fixed by the contract: patterns and least lengths of the base kinds, letters of the keywords in either case.
KEYWORDS = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = KEYWORDS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{16,}"  # the maximal runs of 16 or more are the matches of [0-9a-f]+ that have 16 characters

#: (kind, pattern, group of the value, least length of the value); the first three are base kinds.
KINDS = (
    ("assign", ASSIGN, 2, 12),
    ("access", ACCESS, 0, 18),
    ("hex", HEX, 0, 16),
    ("provider", r"(?:gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,}|sk_live_[A-Za-z0-9]{16,})", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("urlpass", r"[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/@]+@", 0, 1),
)
#: A run of scheme letters is tried from its first letter alone: a later one can't begin an earlier match. Else a long run is read again and again.
FIRST_OF_RUN = r"(?<![a-z])(?<![a-z][0-9+.-]{1,3})"
#: What a match of a kind holds for certain; texts without it are not searched.
HOLDS = {"access": "AKIA", "jwt": "eyJ", "pem": "-----BEGIN ", "urlpass": "://"}
BASE = 3
MAX_OWNERS = 3

SPAN = "array<struct<start:bigint,kind_no:int,kind:string,end:bigint,value:string>>"


def _spans(t: Column, no: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Matches of one kind as (start, kind_no, kind, end, value); offsets in code points."""
    pattern = FIRST_OF_RUN + pattern if kind == "urlpass" else pattern
    lit = F.lit(pattern)
    whole = F.regexp_extract_all(t, lit, 0)
    value = F.regexp_extract_all(t, lit, group) if group else whole
    gaps = F.transform(F.split(t, pattern, -1), lambda x: F.length(x).cast("long"))
    # a match ends where the gaps and matches up to it end
    ends = F.transform(F.arrays_zip(whole.alias("w"), value.alias("v"), F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))).alias("g")), _measured)
    # an array of one binds the matches to a variable, so that they are searched for once
    found = F.get(F.transform(F.array(ends), lambda e: F.zip_with(e, _running(F.transform(e, lambda m: m["g"] + m["n"])), lambda m, end: _span(m, end, no, kind))), F.lit(0))
    found = F.filter(found, lambda s: F.length(s["value"]) >= least)
    may = t.contains(HOLDS[kind]) & t.rlike(pattern) if kind in HOLDS else t.rlike(pattern)
    return F.when(may, found).otherwise(F.array().cast(SPAN))


def _measured(m: Column) -> Column:
    return F.struct(m["g"].alias("g"), F.length(m["w"]).cast("long").alias("n"), m["v"].alias("v"))


def _span(m: Column, end: Column, no: int, kind: str) -> Column:
    return F.struct((end - m["n"]).alias("start"), F.lit(no).alias("kind_no"), F.lit(kind).alias("kind"), end.alias("end"), m["v"].alias("value"))


def _running(numbers: Column) -> Column:
    """Running sums of an array, by adding it to itself shifted by 1, 2, 4 and so on places."""

    def step(acc: Column, shift: Column) -> Column:
        moved = F.concat(F.array_repeat(F.lit(0).cast("long"), F.least(shift, F.size(acc))), F.slice(acc, 1, F.greatest(F.size(acc) - shift, F.lit(0))))
        return F.when(shift < F.size(acc), F.zip_with(acc, moved, lambda a, b: a + b)).otherwise(acc)

    shifts = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.aggregate(F.filter(shifts, lambda x: x < F.size(numbers)), numbers, step)


def scanned(docs: DataFrame, text: str, keep: tuple[str, ...], owner: str | None, repository: str | None) -> DataFrame:
    """``keep``, owner, repository and all candidate spans of each row."""
    t = F.col("__t")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c else F.lit("")
    step = docs.select(
        *[F.col(k).alias(k) for k in keep],
        name(owner).alias("__owner"),
        F.concat_ws("/", name(owner), name(repository)).alias("__repo"),
        text_of(text).alias("__t"),
    )
    parts = [_spans(t, no, *kind) for no, kind in enumerate(KINDS)]
    return step.select(*keep, "__owner", "__repo", F.concat(*parts).alias("__spans"))


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def secret_scan(
    docs: DataFrame,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    owner: str | None = "source",
    repository: str | None = "lang",
    max_owners: int = MAX_OWNERS,
) -> DataFrame:
    """Spans of each row with their verdicts.

    Adds ``found``: sorted spans (start, kind_no, kind, end, live, n_owners,
    n_repositories), and n_assign, n_access, n_hex, base_sha256, spans, n_live.

    Only rows with candidates are shuffled, without their texts. A value's
    owners are counted after a map-side distinct; the join back on the value's
    hash is one that Spark may split where a value is frequent.
    """
    rows = saved(scanned(docs, text, keep, owner, repository))
    rows = rows.withColumn("__row", F.monotonically_increasing_id())
    each = rows.where(F.size("__spans") > 0).select("__row", "__owner", "__repo", F.explode("__spans").alias("s"))
    each = each.withColumn("__value", F.sha2("s.value", 256))
    owners = (
        each.select("__value", "__owner", "__repo")
        .distinct()
        .groupBy("__value", "__owner")
        .agg(F.count("*").alias("r"))
        .groupBy("__value")
        .agg(F.count("*").alias("n_owners"), F.sum("r").alias("n_repositories"))
    )
    judged = (
        each.join(owners, "__value")
        .withColumn("live", F.col("n_owners") <= max_owners)
        .where((F.col("s.kind_no") < BASE) | F.col("live"))
        .groupBy("__row")
        .agg(F.sort_array(F.collect_list(F.struct("s.start", "s.kind_no", "s.kind", "s.end", "live", "n_owners", "n_repositories"))).alias("found"))
    )
    empty = F.array().cast("array<struct<start:bigint,kind_no:int,kind:string,end:bigint,live:boolean,n_owners:bigint,n_repositories:bigint>>")
    out = rows.drop("__spans", "__owner", "__repo").join(judged, "__row", "left").withColumn("found", F.coalesce("found", empty))
    count = lambda no: F.size(F.filter("found", lambda s: s["kind_no"] == no)).cast("long")
    return out.select(
        *keep,
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(F.filter("found", lambda s: s["kind_no"] < BASE)), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda s: s["live"])).cast("long").alias("n_live"),
        "found",
    )


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch of live spans replaced by a mark; overlapping spans share one."""
    live = F.filter(found, lambda s: s["live"])

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        piece = F.when(inside, F.lit("")).otherwise(F.concat(F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    done = F.aggregate(live, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(live) > 0, done).otherwise(text)


RESULT = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live"]


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents")).select(*RESULT)


def _kind_sql(no: int, kind: str, pattern: str, group: int, least: int) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT rid, {no} AS kind_no, '{kind}' AS kind, unnest(list_transform(range(1, len(w) + 1), lambda i:
 {{'s': list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0), 'w': w[i], 'v': v[i]}})) AS m
 FROM (SELECT rid, regexp_extract_all(t, {p}, 0) AS w, regexp_extract_all(t, {p}, {group}) AS v, string_split_regex(t, {p}) AS g FROM rows2 WHERE regexp_matches(t, {p}))"""


def spans_sql(docs: str) -> str:
    """Common tables up to one row per kept span (rid, s, kind_no, kind, e, live)."""
    kinds = " UNION ALL ".join(_kind_sql(no, *kind) for no, kind in enumerate(KINDS))
    least = " ".join(f"WHEN {no} THEN {kind[3]}" for no, kind in enumerate(KINDS))
    return f"""
rows2 AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS o, coalesce(source, '') || '/' || coalesce(lang, '') AS r, coalesce(text, '') AS t FROM {docs}),
cand2 AS (SELECT rid, kind_no, kind, CAST(m.s AS BIGINT) AS s, CAST(m.s AS BIGINT) + length(m.w) AS e, m.v AS v FROM ({kinds}) WHERE length(m.v) >= CASE kind_no {least} END),
own2 AS (SELECT v, count(DISTINCT o) AS n FROM cand2 JOIN rows2 USING (rid) GROUP BY v),
span2 AS (SELECT rid, s, kind_no, kind, e, n <= {MAX_OWNERS} AS live FROM cand2 JOIN own2 USING (v) WHERE kind_no < {BASE} OR n <= {MAX_OWNERS})"""


ORACLE_SQL = f"""WITH {spans_sql("documents")},
agg2 AS (SELECT rid, count(*) FILTER (kind_no = 0) AS a, count(*) FILTER (kind_no = 1) AS b, count(*) FILTER (kind_no = 2) AS c,
 string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_no) FILTER (kind_no < {BASE}) AS base,
 string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_no) AS alls, count(*) FILTER (live) AS nl FROM span2 GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
 coalesce(alls, '') AS spans, coalesce(nl, 0) AS n_live FROM rows2 LEFT JOIN agg2 USING (rid)"""
