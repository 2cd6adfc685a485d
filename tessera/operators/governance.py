"""Row and field governance: grants, masks, write constraints, locks."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import Denied
from tessera.operators.filters import Compiler, combined


@dataclass(frozen=True)
class Grant:
    """Actions that a principal may take on namespaces, and under which bounds."""

    actions: frozenset[str]
    namespaces: str = "*"
    filter: dict | None = None
    mask: frozenset[str] = frozenset()
    stamp: dict = field(default_factory=dict)
    forbid_set: frozenset[str] = frozenset()
    attribute_admin: bool = False


@dataclass(frozen=True)
class Decision:
    filter: dict | None
    mask: frozenset[str]
    stamp: dict
    forbid_set: frozenset[str]


def decide(grants: Iterable[Grant], action: str, namespace: str) -> Decision:
    """Every matching grant applies: filters are and-ed, masks and write constraints joined."""
    found = [g for g in grants if action in g.actions and fnmatchcase(namespace, g.namespaces)]
    if not found:
        raise Denied(f"{action} on {namespace}")
    joint, mask, stamp, forbid = None, frozenset(), {}, frozenset()
    for g in found:
        joint = combined(joint, g.filter)
        mask |= g.mask
        for k, v in g.stamp.items():
            if stamp.setdefault(k, v) != v:
                raise Denied(f"grants stamp {k} differently")
        forbid |= g.forbid_set
    if any(g.attribute_admin for g in found):
        forbid = frozenset()
    return Decision(joint, mask, stamp, forbid)


def visible(rows: DataFrame, decision: Decision, present=None) -> DataFrame:
    """Rows that the policy shows, without masked fields. ``present`` tests that a row has attributes at all."""
    out = rows.where(Compiler(rows.schema).where(decision.filter))
    if decision.filter and present is not None:
        out = out.where(present)
    return out.drop(*decision.mask)


def masked_map(attributes, denied: Iterable[str]):
    """Attribute map without denied keys; null if nothing is left."""
    out = F.map_filter(attributes, lambda k, v: ~k.isin(*denied)) if denied else attributes
    return F.when(F.size(out) > 0, out)


def stamped(rows: DataFrame, decision: Decision, existing: DataFrame | None = None) -> DataFrame:
    """Rows to write, with stamps set. Forbidden fields keep what ``existing`` rows (id and fields) have and are null in new ones."""
    for name, value in decision.stamp.items():
        rows = rows.withColumn(name, F.lit(value))
    held = [f for f in sorted(decision.forbid_set) if f in rows.columns and f not in decision.stamp]
    if not held:
        return rows
    if existing is None:
        for name in held:
            rows = rows.withColumn(name, F.lit(None).cast(rows.schema[name].dataType))
        return rows
    old = existing.select("id", *[F.col(f"`{f}`").alias(f"__{f}") for f in held])
    joined = rows.drop(*held).join(old, "id", "left")
    return joined.select(*[F.col(f"__{c}").alias(c) if c in held else F.col(f"`{c}`") for c in rows.columns])


def violations(rows: DataFrame, decision: Decision) -> DataFrame:
    """Rows that set a forbidden field or lie outside the write scope."""
    bad = F.lit(False)
    for name in sorted(decision.forbid_set & set(rows.columns)):
        bad = bad | F.col(f"`{name}`").isNotNull()
    if decision.filter:
        bad = bad | ~Compiler(rows.schema).write_scope(decision.filter)
    return rows.where(bad)


@dataclass(frozen=True)
class Lock:
    """Preservation lock: global, of a namespace, or of a filter inside one (which still blocks all of its deletes)."""

    scope: str
    namespace: str | None = None
    filter: dict | None = None

    def blocks(self, namespace: str) -> bool:
        return self.scope == "global" or self.namespace == namespace


def check_locks(locks: Iterable[Lock], namespace: str) -> None:
    """Refuse deletes in a locked namespace."""
    if any(lock.blocks(namespace) for lock in locks):
        raise Denied(f"{namespace} is preserved")
