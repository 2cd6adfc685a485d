"""Attribute filters: a checked tree compiled into one Column.

Filters are two-valued: a leaf on a missing field is false, its negated form
true, and never NULL. What a leaf means depends on the column's type, which is
known when the plan is made, so the predicate stays inside code generation. For
WHERE, which drops NULL like false, ``Compiler.where`` leaves comparisons bare
under ``and`` and ``or``, so that they reach the scan.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import Denied, ValidationError
from tessera.operators.text import query_tokens, tokens
from tessera.spec import TextField

EPSILON = 2.220446049250313e-16
KEYS = {
    "eq": {"field", "value"},
    "not_eq": {"field", "value"},
    "range": {"field", "gte", "lte", "gt", "lt"},
    "in": {"field", "values"},
    "not_in": {"field", "values"},
    "and": {"filters"},
    "or": {"filters"},
    "not": {"filter"},
    "contains": {"field", "value"},
    "contains_all_tokens": {"field", "query"},
    "contains_token_sequence": {"field", "query"},
}
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_REAL = (T.FloatType, T.DoubleType, T.DecimalType)
NUMERIC = _WHOLE + _REAL


def checked(node: dict) -> dict:
    """The tree itself, if its operators and keys are known."""
    op = node.get("op")
    if op not in KEYS:
        raise ValidationError(f"unknown filter: {op!r}")
    extra = set(node) - KEYS[op] - {"op"}
    if extra:
        raise ValidationError(f"unknown keys of {op}: {sorted(extra)}")
    for child in node.get("filters", []) if op in ("and", "or") else [node["filter"]] if op == "not" else []:
        checked(child)
    return node


def fields(node: dict) -> set[str]:
    """Fields that a tree reads."""
    own = {node["field"]} if "field" in node else set()
    return own.union(*map(fields, node.get("filters", [])), *([fields(node["filter"])] if "filter" in node else []))


def refuse_masked(node: dict | None, denied: set[str]) -> None:
    """Refuse a tree that reads a field the caller must not see."""
    if node and (seen := fields(node) & denied):
        raise Denied(f"filter on masked fields: {sorted(seen)}")


def _kind(value) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "float"
    if isinstance(value, str):
        return "string"
    if isinstance(value, (list, tuple)):
        return "list"
    raise ValidationError(f"unsupported value: {value!r}")


def _type(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, _WHOLE):
        return "int"
    if isinstance(kind, _REAL):
        return "float"
    if isinstance(kind, T.StringType):
        return "string"
    if isinstance(kind, T.ArrayType):
        return "list"
    return "other"


def _equal(col: Column, kind: T.DataType, value) -> Column | None:
    """col = value with the engine's coercions; None where it can never hold."""
    have, want = _type(kind), _kind(value)
    if have == "list" and want == "list":
        return None
    if have == "list":
        element = _type(kind.elementType)
        return F.array_contains(col, F.lit(value).cast(kind.elementType)) if element == want else None
    if want == "list":
        same = [v for v in value if _kind(v) == have]
        return col.isin(same) if same else None
    if have == want == "float" or (have, want) == ("float", "int"):
        return _near(col, float(value))
    if have == want:
        return col == F.lit(value)
    if (have, want) == ("int", "float"):
        if abs(value) < 1 << 53:  # below, whole numbers are told apart as doubles
            return col == F.lit(round(value)) if abs(round(value) - value) < EPSILON else None
        return _near(col.cast("double"), value)
    return None


def _near(col: Column, value: float) -> Column:
    """Within EPSILON of a value. The bounds around it, a little wider, are what a scan can use."""
    if not math.isfinite(value):
        return F.abs(col - F.lit(value)) < EPSILON
    low, high = math.nextafter(value - EPSILON, -math.inf), math.nextafter(value + EPSILON, math.inf)
    return (col >= F.lit(low)) & (col <= F.lit(high)) & (F.abs(col - F.lit(value)) < EPSILON)


def _range(col: Column, kind: T.DataType, node: dict) -> Column | None:
    """Bounds on numbers. A NaN passes, since no bound rejects it, and so bounds on real numbers are tested after the scan."""
    if not isinstance(kind, NUMERIC):
        return None
    bounds = [test(F.lit(node[name])) for name, test in (("gte", lambda v: col >= v), ("lte", lambda v: col <= v), ("gt", lambda v: col > v), ("lt", lambda v: col < v)) if node.get(name) is not None]
    inside = reduce(lambda a, b: a & b, bounds, F.lit(True))
    return col.isNotNull() & ((inside | F.isnan(col)) if isinstance(kind, (T.FloatType, T.DoubleType)) else inside)


def _contains(col: Column, kind: T.DataType, value) -> Column | None:
    if isinstance(kind, T.StringType) and isinstance(value, str):
        return col.contains(value)
    if isinstance(kind, T.ArrayType) and _type(kind.elementType) == _kind(value):
        return F.array_contains(col, F.lit(value).cast(kind.elementType))
    return None


def _sequence(found: Column, wanted: list[str]) -> Column:
    n = len(wanted)
    if not n:
        return F.lit(True)
    query = F.array(*[F.lit(w) for w in wanted])

    def inside(words: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0)))
        return (F.size(words) >= n) & F.exists(places, lambda i: F.slice(words, i + 1, n) == query)

    # an array of one binds the words to a variable, so that they are made once a row
    return F.exists(F.array(found), inside)


class Compiler:
    """Filters over the columns of a schema. Unknown fields are missing in every row."""

    def __init__(self, schema: T.StructType, text_fields: dict[str, TextField] | None = None, query_tokens: Callable[[str, TextField], list[str]] | None = None):
        self.types = {f.name: f.dataType for f in schema.fields}
        self.text_fields = text_fields or {}
        self.query_tokens = query_tokens

    def leaf(self, node: dict) -> Column | None:
        """Three-valued test of a leaf: NULL where the field is missing, None where it can never hold."""
        name, op = node["field"], node["op"]
        if name not in self.types:
            return F.lit(None).cast("boolean")
        col, kind = F.col(f"`{name}`"), self.types[name]
        if op in ("eq", "not_eq"):
            return _equal(col, kind, node["value"])
        if op in ("in", "not_in"):
            tests = [t for v in node["values"] if (t := _equal(col, kind, v)) is not None]
            return reduce(lambda a, b: a | b, tests) if tests else None
        if op == "range":
            return _range(col, kind, node)
        if op == "contains":
            return _contains(col, kind, node["value"])
        if not isinstance(kind, T.StringType):
            return None
        config = self.text_fields.get(name, TextField(stemming=False))
        wanted = (self.query_tokens or query_tokens)(node["query"], config)
        found = tokens(col, config)
        if op == "contains_all_tokens":
            return F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), found)) == 0 if wanted else F.lit(True)
        return _sequence(found, wanted)

    def compile(self, node: dict | None) -> Column:
        """Two-valued predicate of a tree; no tree passes all rows."""
        return F.coalesce(self.where(node), F.lit(False))

    def where(self, node: dict | None) -> Column:
        """The same for WHERE: true for the rows that pass, false or NULL for others."""
        return F.lit(True) if not node else self._compile(checked(node))

    def _compile(self, node: dict) -> Column:
        op = node["op"]
        if op == "and":
            return reduce(lambda a, b: a & b, map(self._compile, node["filters"]), F.lit(True))
        if op == "or":
            return reduce(lambda a, b: a | b, map(self._compile, node["filters"]), F.lit(False))
        if op == "not":
            return ~F.coalesce(self._compile(node["filter"]), F.lit(False))
        test = self.leaf(node)
        if op in ("not_eq", "not_in"):
            if test is None:
                return F.lit(True)
            kind = self.types.get(node["field"])
            if kind is None or isinstance(kind, T.ArrayType):  # a list may hold NULLs
                return F.coalesce(~test, F.lit(True))
            return F.col(f"`{node['field']}`").isNull() | ~test
        return F.lit(False) if test is None else test

    def write_scope(self, node: dict) -> Column:
        """Predicate of a write scope: a missing field is unknown through and, or and not; only what surely matches passes."""
        return F.coalesce(self._scope(checked(node)), F.lit(False))

    def _scope(self, node: dict) -> Column:
        op = node["op"]
        if op == "and":
            return reduce(lambda a, b: a & b, map(self._scope, node["filters"]), F.lit(True))
        if op == "or":
            return reduce(lambda a, b: a | b, map(self._scope, node["filters"]), F.lit(False))
        if op == "not":
            return ~self._scope(node["filter"])
        test = self.leaf(node)
        name = node["field"]
        if test is None:
            test = F.lit(False) if name not in self.types else F.when(F.col(f"`{name}`").isNotNull(), F.lit(False))
        return ~test if op in ("not_eq", "not_in") else test


def combined(policy: dict | None, caller: dict | None) -> dict | None:
    """Policy and caller filters as one, the policy first."""
    if policy and caller:
        return {"op": "and", "filters": [policy, caller]}
    return policy or caller
