"""Full-text search: analyzer, corpus statistics, BM25 and rank expressions.

Words are runs of letters, digits and underscores, an approximation of the
Unicode word rules that splits ``can't`` and ``3.5``. Stemming is the English
Snowball algorithm in an Arrow function over the distinct words of a batch;
without stemming the analyzer is made of built-in functions alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import FieldNotConfigured, ValidationError
from tessera.functions.stemmer import stem
from tessera.spec import TextField

#: The stop words of the default English analyzer.
STOPWORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()
WORD = r"[\p{L}\p{N}_]+"
_WORD = re.compile(r"\w+")


@F.arrow_udf(T.ArrayType(T.StringType()))
def _stemmed(words: pa.Array) -> pa.Array:
    codes, stems = _stem_codes(words.flatten())
    ends = np.concatenate([[0], np.cumsum(words.value_lengths().fill_null(0).to_numpy())]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), stems.take(pa.array(codes)), mask=words.is_null())


def _stem_codes(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Place of each word's stem among the distinct stems, and those. Only distinct words become Python's."""
    coded = words.dictionary_encode()
    stems = pa.array([stem(w) for w in coded.dictionary.to_pylist()], pa.string()).dictionary_encode()
    return stems.indices.to_numpy()[coded.indices.to_numpy()], stems.dictionary


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column("__t")
        lengths = words.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        if not lengths.sum():
            continue
        codes, stems = _stem_codes(words.flatten())
        held, tf = np.unique(np.repeat(np.arange(len(lengths)), lengths) * len(stems) + codes, return_counts=True)
        row, code = np.divmod(held, len(stems))
        yield pa.RecordBatch.from_arrays([stems.take(pa.array(code)), batch.column("id").take(pa.array(row)), pa.array(tf), pa.array(lengths[row])], ["term", "id", "tf", "dl"])


def tokens(text: Column, config: TextField = TextField(stemming=False)) -> Column:  # noqa: B008
    """Analyzed words of a text column, in order; NULL for NULL."""
    source = text if config.case_sensitive else F.lower(text)
    out = F.filter(F.regexp_extract_all(source, F.lit(WORD), 0), lambda w: F.octet_length(w) <= config.max_token_length)
    if config.remove_stopwords:
        out = F.filter(out, lambda w: ~w.isin(*STOPWORDS))
    return _stemmed(out) if config.stemming else out


def query_tokens(text: str, config: TextField = TextField(stemming=False), last_as_prefix: bool = False) -> list[str]:  # noqa: B008
    """Analyzed words of a query; with ``last_as_prefix`` the last word keeps its form."""
    words = _WORD.findall(text if config.case_sensitive else text.lower())
    out = []
    for i, w in enumerate(words):
        if len(w.encode()) > config.max_token_length or (config.remove_stopwords and w in STOPWORDS):
            continue
        out.append(stem(w) if config.stemming and not (last_as_prefix and i == len(words) - 1) else w)
    return out


def postings(docs: DataFrame, key: str, field: str, config: TextField) -> DataFrame:
    """(term, id, tf, dl): the inverted index of a field. Texts without words are no part of the corpus.

    Stems are counted a row at a time, without a shuffle: an id of several rows has several entries for a term.
    """
    if config.stemming:
        words = docs.where(F.col(field).isNotNull()).select(F.col(key).alias("id"), tokens(F.col(field), replace(config, stemming=False)).alias("__t"))
        return words.mapInArrow(_stem_counts, f"term string, id {docs.schema[key].dataType.simpleString()}, tf bigint, dl bigint")
    words = docs.where(F.col(field).isNotNull()).select(F.col(key).alias("id"), tokens(F.col(field), config).alias("__t"))
    words = words.withColumn("dl", F.size("__t")).where("dl > 0")
    return words.select("id", "dl", F.explode("__t").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("dl").cast("long").alias("dl"))


def statistics(docs: DataFrame, key: str, field: str, config: TextField) -> DataFrame:
    """One row: documents with words, and their mean length."""
    sizes = docs.where(F.col(field).isNotNull()).select(F.size(tokens(F.col(field), config)).alias("dl")).where("dl > 0")
    return sizes.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def term_score(weight: Column, tf: Column, dl: Column, avgdl: Column, config: TextField) -> Column:
    """BM25 of one term; an average length of nothing counts as 1."""
    mean = F.when(avgdl > 0, avgdl).otherwise(F.lit(1.0))
    return weight * tf * (config.k1 + 1) / (tf + config.k1 * (1 - config.b + config.b * dl / mean))


def bm25(
    docs: DataFrame,
    key: str,
    field: str,
    query: str,
    config: TextField = TextField(stemming=False),  # noqa: B008
    last_as_prefix: bool = False,
    length_mode: str = "document",
    merge_prefix: bool = False,
) -> DataFrame:
    """(id, score) of the rows that match, over the statistics of all of ``docs``.

    Only rows with a query term leave the scan: terms are matched inside each
    row, so the shuffle carries the few matching (term, id) pairs. A term asked
    twice counts twice. With ``last_as_prefix`` all terms that begin with the
    last word count, each by its own rarity; with ``merge_prefix``, the rule of an
    unindexed log, they count as one word, as often as all of them together and
    as rare as the most frequent. ``length_mode`` "zero" leaves out document
    lengths.
    """
    wanted = query_tokens(query, config, last_as_prefix)
    spark = docs.sparkSession
    if not wanted:
        return spark.createDataFrame([], "id string, score double").select(F.col("id").cast(docs.schema[key].dataType), "score")
    prefix = wanted[-1] if last_as_prefix else None
    exact = wanted[:-1] if last_as_prefix else wanted
    analyzed = docs.where(F.col(field).isNotNull()).select(F.col(key).alias("id"), tokens(F.col(field), config).alias("__t"))
    analyzed = analyzed.withColumn("dl", F.size("__t").cast("long")).where("dl > 0")
    corpus = analyzed.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))

    def match(w: Column) -> Column:
        test = w.isin(*set(exact)) if exact else F.lit(False)
        return test | w.startswith(prefix) if prefix else test

    hits = analyzed.withColumn("__t", F.filter("__t", match)).where(F.size("__t") > 0)
    hits = hits.select("id", "dl", F.explode("__t").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    rarity = hits.groupBy("term").agg(F.count("*").alias("df"))
    times = F.lit(0)
    for w in dict.fromkeys(exact):
        times = F.when(F.col("term") == w, times + exact.count(w)).otherwise(times)
    if prefix:
        times = times + F.when(F.col("term").startswith(prefix), 1).otherwise(0)
    hits = hits.join(rarity, "term")
    if prefix and merge_prefix:
        begun = hits.where(F.col("term").startswith(prefix))
        most = begun.agg(F.max("df").alias("df"))
        one = begun.groupBy("id").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl")).join(F.broadcast(most))
        hits = hits.where(F.col("term").isin(exact) if exact else F.lit(False)).select("id", "tf", "dl", "df", "term")
        hits = hits.unionByName(one.select("id", "tf", "dl", "df", F.lit(None).cast("string").alias("term")))
        times = F.when(F.col("term").isNull(), 1).otherwise(sum((F.when(F.col("term") == w, exact.count(w)).otherwise(0) for w in dict.fromkeys(exact)), F.lit(0)))
    scored = hits.join(F.broadcast(corpus))
    dl = F.lit(0) if length_mode == "zero" else F.col("dl")
    score = times * term_score(idf(F.col("n"), F.col("df")), F.col("tf"), dl, F.col("avgdl"), config)
    return scored.groupBy("id").agg(F.sum(score).alias("score"))


class RankBy:
    """A rank expression: [field, "BM25", query], ["Sum", [...]], ["Max", [...]] or ["Product", weight, expression]."""

    def __init__(self, node: list):
        self.node = node
        self.leaves: list[tuple[str, str]] = []
        self._check(node)

    def _check(self, node) -> None:
        if not isinstance(node, (list, tuple)) or not node:
            raise ValidationError("a rank expression is a list")
        if node[0] in ("Sum", "Max") and len(node) == 2 and isinstance(node[1], (list, tuple)):
            for child in node[1]:
                self._check(child)
        elif node[0] == "Product" and len(node) == 3 and isinstance(node[1], (int, float)):
            self._check(node[2])
        elif len(node) == 3 and node[1] == "BM25" and isinstance(node[2], str):
            self.leaves.append((node[0], node[2]))
        else:
            raise ValidationError(f"bad rank expression: {node!r}")

    def column(self) -> Column:
        """Score from one column per field; a missing field is 0, and Max is never below 0."""
        return self._column(self.node)

    def _column(self, node) -> Column:
        if node[0] == "Sum":
            out = F.lit(0.0)
            for child in node[1]:
                out = out + self._column(child)
            return out
        if node[0] == "Max":
            return F.greatest(F.lit(0.0), *[self._column(c) for c in node[1]], F.lit(0.0))
        if node[0] == "Product":
            return F.lit(float(node[1])) * self._column(node[2])
        return F.coalesce(F.col(f"`s:{node[0]}`"), F.lit(0.0))


def ranked(docs: DataFrame, key: str, rank_by: list, text_fields: dict[str, TextField], last_as_prefix: bool = False) -> DataFrame:
    """(id, score) by a rank expression; only positive scores. Queries on one field add up."""
    return ranked_by(rank_by, text_fields, lambda field, query: bm25(docs, key, field, query, text_fields[field], last_as_prefix))


def ranked_by(rank_by: list, text_fields: dict[str, TextField], scores_of: Callable[[str, str], DataFrame]) -> DataFrame:
    """The same, with the scores (id, score) of each field and query from a function."""
    tree = RankBy(rank_by)
    parts = []
    for field, query in tree.leaves:
        if field not in text_fields:
            raise FieldNotConfigured(field)
        parts.append(scores_of(field, query).select("id", F.lit(field).alias("field"), "score"))
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    names = dict.fromkeys(field for field, _ in tree.leaves)
    wide = both.groupBy("id").agg(*[F.sum(F.when(F.col("field") == f, F.col("score"))).alias(f"s:{f}") for f in names])
    return wide.select("id", tree.column().alias("score")).where("score > 0")
