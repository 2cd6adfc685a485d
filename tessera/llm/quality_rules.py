"""Quality rules: a threshold table compiled into Spark projections.

Every metric is a built-in expression over one row, so nothing is shuffled and
no user function runs. Rows keep their order and number.

Defined results: a null or empty text has no words, all counts 0, and fails the
base rule (fewer than 20 words). Repeated input rows give repeated output rows.
Extra input columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, text_of

#: White space of words: space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for was with as be by on are this an from or at have not "
    "der die das und ist von mit den im ein eine zu auf nicht sich des dem für als auch "
    "le la les des de et un une est que qui dans pour sur pas par avec au du en "
    "el los las y que por con una para se del al su lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a text while ``low <= metric <= high``; None is no bound."""

    metric: str
    low: float | None = None
    high: float | None = None

    def holds(self) -> Column:
        out = F.lit(True)
        if self.low is not None:
            out = out & (F.col(self.metric) >= F.lit(self.low))
        if self.high is not None:
            out = out & (F.col(self.metric) <= F.lit(self.high))
        return F.coalesce(out, F.lit(False))


#: The method's verdict. Ratios are per word unless they say otherwise.
RULES = (
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbols_per_word", None, 0.10),
    Rule("marks_per_word", None, 0.50),
    Rule("stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.40),
)


def _window(x: Column, i: Column) -> Column:
    """Hash of the hashes of the window that starts at word i."""
    return F.xxhash64(x, *[F.get(F.col("__h"), i + k) for k in range(1, WINDOW)])


def measured(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and all metrics of each row.

    Words in repeated windows: each 8-word window is hashed over the hashes of
    its words, windows whose hash occurs twice mark their eight words, and the
    marked words are counted as a union of intervals.
    """
    t = F.col("__t")
    step = docs.select(*[F.col(k).alias(k) for k in keep], text_of(text).alias("__t"))
    step = step.select(
        *keep,
        F.array_remove(F.split(t, SPACE, -1), "").alias("__w"),
        F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.regexp_count(t, F.lit("[!?]")).cast("long").alias("__marks"),
        F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"),
    )
    w = F.col("__w")
    step = step.select(
        *keep,
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        "n_symbols",
        "__marks",
        F.size("__lines").cast("long").alias("__n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS))).cast("long").alias("__stops"),
        F.transform(w, lambda x: F.xxhash64(x)).alias("__h"),
    )
    step = step.withColumn("__h", F.transform(F.slice("__h", 1, F.greatest(F.size("__h") - (WINDOW - 1), F.lit(0))), _window))
    h = F.col("__h")
    step = step.withColumn(
        "__s",
        F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))),
    ).drop("__h")
    s = F.col("__s")

    def twice(x: Column, k: Column) -> Column:
        return F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))

    step = step.withColumn("__p", F.sort_array(F.transform(F.filter(s, twice), lambda x: x["i"]))).drop("__s")
    p = F.col("__p")
    reached = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
    words = F.greatest(F.col("n_words"), F.lit(1))
    return step.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        # the row number never decides; it keeps filters above, which would repeat the whole chain of expressions
        F.when(F.monotonically_increasing_id() >= 0, F.coalesce(F.aggregate(reached, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).alias("n_repeat_words"),
        (F.col("word_chars") / words).alias("mean_word_chars"),
        (F.col("n_symbols") / words).alias("symbols_per_word"),
        (F.col("__marks") / words).alias("marks_per_word"),
        (F.col("__stops") / words).alias("stop_word_ratio"),
        (F.col("n_dup_lines") / F.greatest(F.col("__n_lines"), F.lit(1))).alias("dup_line_ratio"),
    )


def quality_rules(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Metrics, ``base_failed`` and ``kept`` of each row."""
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    verdict = F.lit(True)
    for rule in rules:
        verdict = verdict & rule.holds()
    return measured(docs, text, keep).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict)


RESULT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(*RESULT)


def _quoted(words: list[str]) -> str:
    return ", ".join("'" + x + "'" for x in words)


#: Reads a relation ``__docs`` of doc_id and text.
MEASURE_SQL = rf"""
rows6 AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM __docs),
words6 AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM rows6),
wins6 AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM words6)),
twice6 AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM wins6) WHERE c > 1),
reach6 AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM twice6) GROUP BY rid),
met6 AS (SELECT a.rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
   CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
   length(t) - length(translate(t, '!?', '')) AS marks,
   CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
   CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
   len(list_filter(w, lambda x: x IN ({_quoted(STOP_WORDS)}))) AS stops
 FROM words6 a LEFT JOIN reach6 b ON a.rid = b.rid),
base6 AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, greatest(n_words, 1) AS d FROM met6)
"""

KEPT_SQL = """NOT base_failed AND word_chars / d >= 2.0 AND word_chars / d <= 14.0 AND n_symbols / d <= 0.10 AND marks / d <= 0.50
 AND stops / d >= 0.02 AND n_dup_lines / greatest(n_lines, 1) <= 0.40"""

ORACLE_SQL = f"""WITH {MEASURE_SQL.replace("__docs", "documents")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, {KEPT_SQL} AS kept FROM base6"""
