"""Retrieval requests: JSON to a checked plan, a plan to DataFrames.

Stages run in a fixed order: sources, fusion, facets (over the first-stage
frontier), rerank, grouping, cursor, cut, projection. All is lazy but the
lookup of a seed vector.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import Denied, EngineError, NotImplementedYet, ValidationError
from tessera.operators import algebra, ann, late
from tessera.operators.distance import check_dimensions
from tessera.operators.filters import Compiler, checked, fields, refuse_masked
from tessera.operators.governance import Decision
from tessera.operators.text import RankBy, ranked
from tessera.sources import index
from tessera.sources.log import underfill
from tessera.sources.store import Namespace
from tessera.spec import NamespaceSpec

KEYS = {
    "vector", "rank_by", "last_as_prefix", "sources", "filter", "top_k", "candidate_k", "consistency", "fusion", "rerank", "facets", "grouping", "cursor",
    "include_attributes", "projection", "explain", "debug", "nprobe", "as_of",
}
MAX_TOP_K = 10_000
MAX_CANDIDATES = 4 * MAX_TOP_K
#: Keys that only a namespace can serve; a bare snapshot refuses them.
OF_NAMESPACE = {"as_of", "nprobe"}
MAX_BATCH = 256


@dataclass
class Result:
    """Frames of an answer; those not asked for are None."""

    results: DataFrame
    lower: bool
    facets: DataFrame | None = None
    groups: DataFrame | None = None
    contributions: DataFrame | None = None
    next_cursor: str | None = None
    plan: dict[str, Any] | None = None
    debug: dict[str, Any] = field(default_factory=dict)


class Plan:
    """A request that passed all checks."""

    def __init__(self, request: dict, spec: NamespaceSpec, defaults: dict | None = None):
        extra = set(request) - KEYS
        if extra:
            raise ValidationError(f"unknown keys: {sorted(extra)}")
        self.request, self.spec = request, spec
        self.top_k = request.get("top_k", (defaults or {}).get("default_top_k", 10))
        if not 1 <= self.top_k <= MAX_TOP_K:
            raise ValidationError("top_k out of range")
        legacy = [k for k in ("vector", "rank_by") if k in request]
        if "sources" in request and legacy:
            raise ValidationError("sources can't be mixed with a top-level query")
        if len(legacy) == 2 or not (legacy or request.get("sources")):
            raise ValidationError("exactly one of vector, rank_by and sources")
        if legacy:
            kind = "ann" if legacy[0] == "vector" else "bm25"
            self.sources = [{"type": kind, legacy[0]: request[legacy[0]], **({"last_as_prefix": request["last_as_prefix"]} if "last_as_prefix" in request else {})}]
        else:
            self.sources = request["sources"]
        for s in self.sources:
            self._source(s)
        self.candidate_k = request.get("candidate_k", algebra.default_candidates(self.top_k))
        if not self.top_k <= self.candidate_k <= MAX_CANDIDATES:
            raise ValidationError("candidate_k out of range")
        if request.get("explain") not in (None, False, "plan", "full"):
            raise ValidationError("explain is plan or full")
        if not isinstance(request.get("nprobe", 1), int) or request.get("nprobe", 1) < 1:
            raise ValidationError("nprobe out of range")
        if request.get("filter"):
            checked(request["filter"])
        if request.get("consistency", "strong") not in ("strong", "eventual"):
            raise ValidationError("consistency")
        if request.get("grouping") and "cursor" in request:
            raise ValidationError("grouping takes no cursor")
        projection = request.get("projection") or {}
        if projection.get("include_vectors") or projection.get("fields"):
            raise NotImplementedYet("projection of vectors or fields")
        fusion = request.get("fusion")
        if fusion and fusion.get("type") not in ("rrf", "weighted"):
            raise ValidationError("unknown fusion")
        self.fusion = fusion or ({"type": "rrf"} if len(self.sources) > 1 else None)
        if self.fusion and self.fusion["type"] == "rrf" and self.fusion.get("k", 60) <= 0:
            raise ValidationError("the rank constant must be positive")
        wide = any(request.get(k) for k in ("rerank", "grouping", "facets")) or "cursor" in request
        self.first_k = self.candidate_k if wide else self.top_k
        self.lower = self.fusion is None and self.sources[0]["type"] == "ann"

    def _source(self, s: dict) -> None:
        kind = s.get("type")
        if kind == "ann":
            if ("vector" in s) == ("id" in s):
                raise ValidationError("an ann source takes a vector or an id")
            if "vector" in s:
                check_dimensions(s["vector"], self.spec.dimensions)
        elif kind == "bm25":
            for name, _ in RankBy(s["rank_by"]).leaves:
                if name not in self.spec.text_fields:
                    raise ValidationError(f"{name} is no full-text field")
        elif kind == "late_interaction":
            vectors = s.get("vectors")
            if not vectors or not s.get("field"):
                raise ValidationError("a late_interaction source takes vectors and the field that holds the rows' matrices")
            for v in vectors:
                check_dimensions(v, len(vectors[0]))
            if not 1 <= s.get("candidates", 1) <= MAX_CANDIDATES:
                raise ValidationError("candidates out of range")
        else:
            raise ValidationError(f"unknown source: {kind!r}")

    def reads(self) -> set[str]:
        """Fields that the request reads."""
        r = self.request
        out = fields(r["filter"]) if r.get("filter") else set()
        out |= set(r.get("facets") or ()) | ({r["grouping"]["field"]} if r.get("grouping") else set())
        for s in self.sources:
            out |= {f for f, _ in RankBy(s["rank_by"]).leaves} if s["type"] == "bm25" else set()
            out |= {s["field"]} if s["type"] == "late_interaction" else set()
        return out

    def describe(self) -> dict:
        return {
            "top_k": self.top_k,
            "candidate_k": self.candidate_k,
            "first_stage_top_k": self.first_k,
            "fusion": self.fusion,
            "sources": [{"index": i, "type": s["type"], "score_direction": "lower_is_better" if s["type"] == "ann" else "higher_is_better"} for i, s in enumerate(self.sources)],
            "consistency": self.request.get("consistency", "strong"),
        }


def answer(request: dict, namespace: Namespace, decision: Decision | None = None, **options) -> Result:
    """Answer a request over a namespace, at its ``as_of`` and in its ``consistency``.

    Sources go through the index where there is one: clusters for vectors, stored
    postings for words. Under a row policy neither is used, since both were made
    of rows that the caller must not see.
    """
    manifest = namespace.resolve(request.get("as_of"))
    snapshot = namespace.snapshot(manifest["version"], request.get("consistency", "strong"))
    return execute(request, snapshot, namespace.spec, decision, held=(namespace, manifest), **options)


def execute(
    request: dict,
    snapshot: DataFrame,
    spec: NamespaceSpec,
    decision: Decision | None = None,
    cursors: algebra.Cursors | None = None,
    policy: int = 0,
    defaults: dict | None = None,
    held: tuple[Namespace, dict] | None = None,
) -> Result:
    """Answer a request over a snapshot (id, values, attributes); ``held`` is the namespace and the manifest that it is of."""
    plan = Plan(request, spec, defaults)
    if not held and (unserved := OF_NAMESPACE & set(request)):
        raise ValidationError(f"only a namespace serves {sorted(unserved)}")
    namespace, manifest = held if held and not (decision and decision.filter) else (None, None)
    rows = snapshot
    if decision:
        refuse_masked(request.get("filter"), set(decision.mask))
        if plan.reads() & decision.mask:
            raise Denied("request on masked fields")
        if request.get("debug") and decision.filter:
            raise Denied("debug under a row policy")
        rows = rows.where(Compiler(rows.schema, spec.text_fields).where(decision.filter))
    keep: Column = Compiler(rows.schema, spec.text_fields).where(request.get("filter"))
    shown = rows.where(keep)
    seeds = [s["id"] for s in plan.sources if "id" in s]
    attributes = [c for c in snapshot.columns if c not in ("id", "values")]
    width = plan.candidate_k if (plan.fusion or plan.first_k == plan.candidate_k) else plan.first_k
    found: list[tuple[DataFrame, bool]] = []
    for s in plan.sources:
        if s["type"] == "ann":
            vector = s["vector"] if "vector" in s else ann.seed_vector(rows, s["id"])
            if namespace:
                found.append((namespace.nearest(vector, width, manifest["version"], request.get("consistency", "strong"), request.get("nprobe"), request.get("filter"), seeds), True))
                continue
            pool = shown.where(~F.col("id").isin(seeds)) if seeds else shown
            found.append((ann.exact(pool, vector, spec.metric, width), True))
        elif s["type"] == "late_interaction":
            if s["field"] not in rows.columns:
                raise ValidationError(f"no field {s['field']}")
            pool = shown.where(~F.col("id").isin(seeds)) if seeds else shown
            found.append((late.matched(pool.select("id", F.col(f"`{s['field']}`").alias("matrix")), s["vectors"], width, s.get("candidates")), False))
        else:
            # statistics over all visible rows; the caller's filter only gates what comes out
            if namespace and namespace.has_text(manifest, {f for f, _ in RankBy(s["rank_by"]).leaves}):
                scored = index.ranked(rows.sparkSession, namespace.folder(manifest), s["rank_by"], spec.text_fields, s.get("last_as_prefix", False))
            else:
                scored = ranked(rows, "id", s["rank_by"], spec.text_fields, s.get("last_as_prefix", False))
            scored = scored.join(shown.select("id"), "id", "left_semi") if request.get("filter") else scored
            scored = scored.where(~F.col("id").isin(seeds)) if seeds else scored
            found.append((ann.ordered(scored, width, descending=True), False))
    contributions = None
    if plan.fusion:
        if plan.fusion["type"] == "rrf":
            contributions = algebra.contributions_rrf(found, plan.fusion.get("k", 60))
        else:
            contributions = algebra.contributions_weighted(found, plan.fusion["weights"])
        frontier = algebra.fused(contributions, plan.first_k)
    else:
        frontier = ann.ordered(found[0][0], plan.first_k, descending=not plan.lower)
    out = Result(frontier, plan.lower)
    if request.get("explain"):
        out.plan = plan.describe() | {"version": manifest["version"] if manifest else None, "index": manifest["segment"] and manifest["segment"]["index"] if manifest else None}
        out.contributions = contributions if request["explain"] == "full" else None
    held = rows.join(F.broadcast(frontier), "id")
    if request.get("facets"):
        out.facets = algebra.facets(held, request["facets"])
    lower = plan.lower
    rerank = request.get("rerank") or {"type": "none"}
    if rerank["type"] == "vector":
        frontier, lower = algebra.rerank_vector(rows, frontier, check_dimensions(rerank["vector"], spec.dimensions), spec.metric, plan.candidate_k), True
    elif rerank["type"] == "bm25":
        ((name, query),) = RankBy(rerank["rank_by"]).leaves
        frontier, lower = algebra.rerank_bm25(rows, frontier, name, query, plan.candidate_k, spec.text_fields[name]), False
    out.lower = lower
    if request.get("grouping"):
        g = request["grouping"]
        held = rows.join(F.broadcast(frontier), "id")
        out.groups = algebra.grouped(held, g["field"], plan.top_k, g.get("max_per_group", 1), lower)
        frontier = out.groups.select("id", "score")
    elif "cursor" in request:
        cursors = cursors or algebra.Cursors(b"local")
        token = request["cursor"]
        page = ann.ordered(frontier, plan.top_k + 1, not lower) if not token else algebra.after(frontier, *cursors.read(token, request, policy), lower, plan.top_k + 1)
        got = page.collect()
        if len(got) > plan.top_k:
            last = got[plan.top_k - 1]
            out.next_cursor = cursors.issue(request, last["score"], str(last["id"]), policy)
        frontier = ann.ordered(page, plan.top_k, not lower)
    else:
        frontier = ann.ordered(frontier, plan.top_k, not lower)
    include = request.get("include_attributes", True)
    names = [a for a in attributes if not (decision and a in decision.mask)]
    if include:
        best = F.col("score").asc() if lower else F.col("score").desc()
        shown = rows.select("id", *names).join(F.broadcast(frontier), "id")
        out.results = algebra.projected(shown, names, include).orderBy(best, F.col("id").cast("string"))
    else:
        out.results = frontier
    if request.get("debug"):
        returned = frontier.count()
        stale = bool(manifest) and request.get("consistency") == "eventual" and bool(manifest["batches"])
        reason = underfill(plan.top_k, returned, stale, 0 if snapshot.isEmpty() else 1, bool(request.get("filter")), namespace is not None)
        out.debug = {"returned": returned, "underfill": reason, "version": manifest["version"] if manifest else None, "uncompacted": len(manifest["batches"]) if manifest else None}
    return out


def answer_batch(requests: list[dict], namespace: Namespace, **options) -> list[Result | EngineError]:
    """Answers over one generation, in the strong view if any request asks for it; an entry that fails gives its error alone."""
    if len(requests) > MAX_BATCH:
        raise ValidationError(f"at most {MAX_BATCH} queries")
    view = "strong" if any(r.get("consistency", "strong") == "strong" for r in requests) else "eventual"
    version = namespace.manifest()["version"]
    out: list[Result | EngineError] = []
    for r in requests:
        try:
            out.append(answer({"as_of": version} | r | {"consistency": view}, namespace, **options))
        except EngineError as e:
            out.append(e)
    return out


def execute_batch(requests: list[dict], snapshot: DataFrame, spec: NamespaceSpec, **options) -> list[Result | EngineError]:
    """Answers over one snapshot; an entry that fails gives its error alone."""
    if len(requests) > MAX_BATCH:
        raise ValidationError(f"at most {MAX_BATCH} queries")
    out: list[Result | EngineError] = []
    for r in requests:
        try:
            out.append(execute(r, snapshot, spec, **options))
        except EngineError as e:
            out.append(e)
    return out
