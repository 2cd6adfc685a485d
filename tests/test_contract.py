"""Requests over a shelf of six books; expected scores are worked out here from the formulas."""

import math

import pytest
from pyspark.sql import types as T

from tessera.errors import Denied, DimensionMismatch, ValidationError
from tessera.operators.algebra import Cursors
from tessera.operators.governance import Decision
from tessera.plans.request import answer, answer_batch, execute, execute_batch
from tessera.sources.store import Namespace
from tessera.spec import NamespaceSpec, TextField

SPEC = NamespaceSpec("shelf", 3, "euclidean", {"blurb": TextField()})
BOOKS = {
    "b1": ([1.0, 2.0, 0.0], "sea", ["old", "thin"], "whales and harbour storms"),
    "b2": ([1.0, 2.5, 0.0], "sea", ["new"], "harbour lights"),
    "b3": ([0.0, 2.0, 1.5], "hills", ["old"], "sheep above the harbour town"),
    "b4": ([4.0, 0.0, 0.0], "hills", ["new", "thick"], "granite"),
    "b5": ([1.0, 2.0, 3.0], "city", ["thick"], "trams at night"),
    "b6": ([0.0, 0.0, 9.0], "city", ["old"], "harbour harbour cranes"),
}
AT = [1.0, 2.0, 0.0]
ANN = {"type": "ann", "vector": AT}
BM25 = {"type": "bm25", "rank_by": ["blurb", "BM25", "harbour"]}
SCHEMA = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("values", T.ArrayType(T.FloatType())), T.StructField("place", T.StringType()), T.StructField("marks", T.ArrayType(T.StringType())), T.StructField("blurb", T.StringType())]
)


def near(vector):
    """(id, squared distance), nearest first."""
    return sorted(((i, sum((a - b) ** 2 for a, b in zip(v, vector, strict=True))) for i, (v, *_) in BOOKS.items()), key=lambda x: (x[1], x[0]))


def matching(word="harbour"):
    """(id, BM25), best first, with k1 1.2 and b 0.75."""
    words = {i: [w for w in b[3].split() if w not in ("and", "the", "at")] for i, b in BOOKS.items()}
    mean = sum(map(len, words.values())) / len(words)
    df = sum(word in w for w in words.values())
    idf = math.log((len(words) - df + 0.5) / (df + 0.5) + 1)
    score = {i: idf * (tf := w.count(word)) * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean)) for i, w in words.items() if word in w}
    return sorted(score.items(), key=lambda x: (-x[1], x[0]))


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, *b) for i, b in BOOKS.items()], SCHEMA).cache()


def asked(rows, **request):
    return [(r["id"], r["score"]) for r in execute(request, rows, SPEC).results.collect()]


def close(got, want):
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-6)


def test_single_sources(rows):
    close(asked(rows, vector=AT, top_k=4), near(AT)[:4])
    close(asked(rows, rank_by=["blurb", "BM25", "harbour"], top_k=4), matching())


def test_rrf(rows):
    total = {}
    for found in (near(AT), matching()):
        for rank, (i, _) in enumerate(found, 1):
            total[i] = total.get(i, 0) + 1 / (30 + rank)
    want = sorted(total.items(), key=lambda x: (-x[1], x[0]))[:4]
    close(asked(rows, sources=[ANN, BM25], candidate_k=6, top_k=4, fusion={"type": "rrf", "k": 30}), want)


def test_weighted(rows):
    total = dict.fromkeys(BOOKS, 0.0)
    for found, weight, lower in ((near(AT), 0.4, True), (matching(), 0.6, False)):
        low, high = min(s for _, s in found), max(s for _, s in found)
        for i, s in found:
            total[i] += weight * ((high - s) if lower else (s - low)) / (high - low)
    want = sorted(total.items(), key=lambda x: (-x[1], x[0]))[:4]
    close(asked(rows, sources=[ANN, BM25], candidate_k=6, top_k=4, fusion={"type": "weighted", "weights": [0.4, 0.6]}), want)


def test_reranks(rows):
    other = [0.0, 0.0, 8.0]
    first = {i for i, _ in near(AT)[:5]}
    close(asked(rows, vector=AT, candidate_k=5, top_k=3, rerank={"type": "vector", "vector": other}), [x for x in near(other) if x[0] in first][:3])
    got = asked(rows, vector=AT, candidate_k=5, top_k=3, rerank={"type": "bm25", "rank_by": ["blurb", "BM25", "harbour"]})
    assert {i for i, _ in got} == {i for i, _ in matching()} & first


def test_neighbours_of_a_row(rows):
    close(asked(rows, sources=[{"type": "ann", "id": "b5"}], top_k=3), [x for x in near(BOOKS["b5"][0]) if x[0] != "b5"][:3])


def test_facets_count_the_frontier(rows):
    got = execute({"sources": [ANN], "candidate_k": 4, "top_k": 2, "facets": ["place", "marks"]}, rows, SPEC)
    want = {}
    for i, _ in near(AT)[:4]:
        for key in [("place", BOOKS[i][1]), *(("marks", m) for m in BOOKS[i][2])]:
            want[key] = want.get(key, 0) + 1
    assert {(r["field"], r["value"]): r["count"] for r in got.facets.collect()} == want


def test_grouping(rows):
    got = execute({"sources": [ANN], "candidate_k": 6, "top_k": 2, "grouping": {"field": "place", "max_per_group": 2}}, rows, SPEC)
    groups = [(r["group_rank"], r["group_key"], r["id"]) for r in got.groups.orderBy("group_rank", "rank_in_group").collect()]
    assert groups == [(1, "field:sea", "b1"), (1, "field:sea", "b2"), (2, "field:hills", "b3"), (2, "field:hills", "b4")]


def test_cursor_pages(rows):
    base = {"vector": AT, "candidate_k": 3, "top_k": 2}
    order = [i for i, _ in near(AT)]
    first = execute(base | {"cursor": None}, rows, SPEC)
    assert [r["id"] for r in first.results.collect()] == order[:2]
    second = execute(base | {"cursor": first.next_cursor}, rows, SPEC)
    assert [r["id"] for r in second.results.collect()] == order[2:3] and second.next_cursor is None
    for bad in ((Cursors(b"other"), base, 0), (Cursors(b"local"), base | {"top_k": 1}, 0), (Cursors(b"local"), base, 2)):
        with pytest.raises(ValidationError):
            bad[0].read(first.next_cursor, bad[1], policy=bad[2])


def test_batch_catches_errors_alone(rows):
    ok, bad = execute_batch([{"vector": AT, "top_k": 1}, {"vector": [0.0], "top_k": 1}], rows, SPEC)
    assert ok.results.count() == 1 and isinstance(bad, DimensionMismatch)


def test_masked_fields_are_refused_and_hidden(rows):
    decision = Decision({"op": "eq", "field": "place", "value": "sea"}, frozenset(["marks"]), {}, frozenset())
    got = execute({"vector": AT, "top_k": 5}, rows, SPEC, decision).results
    assert "marks" not in got.columns and [r["id"] for r in got.collect()] == ["b1", "b2"]
    with pytest.raises(Denied):
        execute({"vector": AT, "facets": ["marks"]}, rows, SPEC, decision)
    with pytest.raises(Denied):
        execute({"vector": AT, "filter": {"op": "eq", "field": "marks", "value": "x"}}, rows, SPEC, decision)


@pytest.mark.parametrize(
    "request_",
    [{}, {"vector": AT, "rank_by": ["blurb", "BM25", "x"]}, {"vector": AT, "what": 1}, {"vector": AT, "top_k": 0}, {"vector": AT, "top_k": 5, "candidate_k": 2}, {"vector": AT, "candidate_k": 10**9},
     {"rank_by": ["nothing", "BM25", "x"]}, {"sources": [ANN, BM25], "fusion": {"type": "rrf", "k": 0}}, {"vector": AT, "filter": {"op": "near"}},
     {"vector": AT, "as_of": 1}, {"vector": AT, "nprobe": 2}, {"vector": AT, "explain": "all"}],
)
def test_bad_requests(rows, request_):
    with pytest.raises(ValidationError):
        execute(request_, rows, SPEC)


def test_requests_over_a_namespace(spark, rows, tmp_path):
    shelf = Namespace.create(spark, str(tmp_path), SPEC, T.StructType([f for f in SCHEMA if f.name not in ("id", "values")]))
    shelf.upsert(rows)
    ids = lambda got: [r["id"] for r in got.results.collect()]
    order, by_word = [i for i, _ in near(AT)], [i for i, _ in matching()]
    query, words = {"vector": AT, "top_k": 6}, {"rank_by": ["blurb", "BM25", "harbour"], "top_k": 6}
    for _ in range(2):  # from the log, then from the index
        assert ids(answer(query, shelf)) == order and ids(answer(words, shelf)) == by_word
        shelf.compact()
    shelf.delete_ids(["b1"])
    assert ids(answer(query, shelf)) == order[1:]
    assert ids(answer(query | {"as_of": 1}, shelf)) == order
    assert ids(answer(query | {"consistency": "eventual"}, shelf)) in (order, order[1:])
    assert "b1" not in ids(answer(words, shelf))
    got = answer(query | {"explain": "plan", "debug": True, "filter": {"op": "eq", "field": "place", "value": "city"}}, shelf)
    assert got.plan["version"] == 3 and got.plan["index"]["rows"] == 6 and got.contributions is None
    assert got.debug["returned"] == 2 and got.debug["underfill"] and got.debug["uncompacted"] == 1
    full = answer({"sources": [ANN, BM25], "explain": "full"}, shelf)
    assert full.contributions is not None and answer(query, shelf).plan is None
    first, second = answer_batch([query, {"vector": [1.0]}], shelf)
    assert ids(first) == order[1:] and isinstance(second, DimensionMismatch)
    decision = Decision({"op": "eq", "field": "place", "value": "hills"}, frozenset(), {}, frozenset())
    assert ids(answer(query, shelf, decision)) == [i for i in order if BOOKS[i][1] == "hills"]


def test_late_interaction_source(spark):
    import pytest

    from tessera.errors import DimensionMismatch, ValidationError
    from tessera.plans.request import Plan, execute
    from tessera.spec import NamespaceSpec

    spec = NamespaceSpec("late", 2)
    rows = spark.createDataFrame([("a", [[1.0, 0.0], [0.0, 2.0]]), ("b", [[3.0, 0.0]]), ("c", []), ("d", None)], "id string, matrix array<array<double>>")
    source = {"type": "late_interaction", "field": "matrix", "vectors": [[1.0, 0.0], [0.0, 1.0]]}
    ask = {"sources": [source], "include_attributes": False}
    got = [(r["id"], r["score"]) for r in execute(ask, rows, spec).results.collect()]
    assert got == [("a", 3.0), ("b", 3.0)]
    some = execute({"sources": [source | {"candidates": 10}], "include_attributes": False}, rows, spec).results.collect()
    assert [(r["id"], r["score"]) for r in some] == got
    for bad in ({"vectors": []}, {"field": ""}, {"candidates": 0}):
        with pytest.raises(ValidationError):
            Plan({"sources": [source | bad]}, spec)
    with pytest.raises(DimensionMismatch):
        Plan({"sources": [source | {"vectors": [[1.0], [1.0, 2.0]]}]}, spec)
    with pytest.raises(ValidationError):
        execute({"sources": [source | {"field": "other"}]}, rows, spec)
