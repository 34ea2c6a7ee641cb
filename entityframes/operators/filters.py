"""Typed filter trees, read scopes and flat predicates.

A tree is a dict: field names map to a dict of arms, and ``and``, ``or`` (lists of trees) and ``not``
(a tree) combine. All siblings hold together. ``where`` only builds one Column; Catalyst simplifies and
pushes it to the scan.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import EntitySpec, Field, SpecError

MAX_DEPTH, MAX_IN, MAX_STRING_BYTES = 10, 200, 1024
_COMPARE = {
    "eq": lambda c, v: c == v,
    "neq": lambda c, v: c != v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
}
_NULL_ARMS = ("is_null", "is_not_null")
_ARMS = {
    "string": ("eq", "neq", "in", "not_in", "prefix", "suffix", "contains", "ilike"),
    "int": (*_COMPARE, "in", "not_in", "between"),
    "float": (*_COMPARE, "in", "not_in", "between"),
    "bool": ("eq",),
    "timestamp": (*_COMPARE, "between"),
    "bytes": ("eq", "neq", "in"),
    "json": ("eq", "neq", "in"),
    "numeric": (*_COMPARE, "in"),
}


def _all(parts: list[Column]) -> Column | None:
    return reduce(lambda a, b: a & b, parts) if parts else None


def _value(f: Field, value: Any) -> Any:
    if value is None:
        raise SpecError(f"{f.name}: a predicate value is null; use is_null")
    if isinstance(value, str) and len(value.encode()) > MAX_STRING_BYTES:
        raise SpecError(f"{f.name}: a string is longer than {MAX_STRING_BYTES} bytes")
    if f.kind.kind == "numeric":
        return F.lit(Decimal(str(value)))
    return value


def _arm(f: Field, c: Column, arm: str, value: Any) -> Column | None:
    kind = f.kind.kind
    if arm in _NULL_ARMS:
        if not value:
            return None  # false is no predicate, not the opposite
        return c.isNull() if arm == "is_null" else c.isNotNull()
    if arm not in _ARMS.get(kind, ()):
        raise SpecError(f"{f.name}: no arm {arm!r} for {f.type}")
    if f.type == "citext":
        c = F.collate(c, "UTF8_LCASE")
    if arm in ("in", "not_in"):
        values = [_value(f, v) for v in value]
        if len(values) > MAX_IN:
            raise SpecError(f"{f.name}: more than {MAX_IN} values")
        if not values:
            return None  # an empty list adds no predicate
        return c.isin(values) if arm == "in" else ~c.isin(values)
    if arm == "between":
        lo, hi = (_value(f, v) for v in value)
        if lo > hi:
            raise SpecError(f"{f.name}: between from {lo} to {hi}")
        return c.between(lo, hi)
    value = _value(f, value)
    if arm == "prefix":
        return c.startswith(value)
    if arm == "suffix":
        return c.endswith(value)
    if arm == "contains":
        return c.contains(value)
    if arm == "ilike":
        return F.lower(c).contains(value.lower())
    return _COMPARE[arm](c, value)


def condition(spec: EntitySpec, tree: dict, depth: int = 1) -> Column | None:
    """The predicate of a tree; None where it says nothing."""
    if depth > MAX_DEPTH:
        raise SpecError(f"a filter is nested deeper than {MAX_DEPTH}")
    parts: list[Column | None] = []
    for name, arms in tree.items():
        if name in ("and", "or"):
            inner = [p for p in (condition(spec, t, depth + 1) for t in arms) if p is not None]
            if inner:
                parts.append(reduce((lambda a, b: a & b) if name == "and" else (lambda a, b: a | b), inner))
        elif name == "not":
            inner_one = condition(spec, arms, depth + 1)
            parts.append(None if inner_one is None else ~inner_one)
        else:
            f = spec[name]
            parts += [_arm(f, F.col(name), arm, v) for arm, v in arms.items()]
    return _all([p for p in parts if p is not None])


def where(df: DataFrame, spec: EntitySpec, tree: dict | None, extra: list[Column] = ()) -> DataFrame:
    """Rows for which the tree and all ``extra`` predicates are true; an empty tree keeps all."""
    parts = [p for p in (condition(spec, tree or {}), *extra) if p is not None]
    return df.filter(_all(parts)) if parts else df


def scoped(df: DataFrame, spec: EntitySpec, tenant: Any = None) -> DataFrame:
    """What a reader may see: no soft-deleted rows, and of a tenant's table the caller's rows only."""
    if spec.soft_delete:
        df = df.filter(F.col(spec.soft_delete).isNull())
    if spec.tenant:
        if tenant is None:
            raise SpecError(f"{spec.name} is read by tenant, and none is given")
        df = df.filter(F.col(spec.tenant) == tenant)
    return df


_FIND = {"=": "eq", "!=": "neq", "<": "lt", "<=": "lte", ">": "gt", ">=": "gte"}


def find(df: DataFrame, spec: EntitySpec, predicates: list[tuple[str, str, Any]]) -> DataFrame:
    """Flat predicates (column, op, value) that hold together.

    Ops are = != < <= > >= ``is null`` and ``is not null``. Unlike ``neq`` in a tree, ``!=`` keeps rows
    whose value is null.
    """
    for column, op, value in predicates:
        c = F.col(spec[column].name)
        if op == "is null":
            df = df.filter(c.isNull())
        elif op == "is not null":
            df = df.filter(c.isNotNull())
        elif op == "!=":
            df = df.filter(c.isNull() | (c != value))
        elif op in _FIND:
            df = df.filter(_COMPARE[_FIND[op]](c, value))
        else:
            raise SpecError(f"unknown operator {op!r}")
    return df


def member(df: DataFrame, column: str, values: list | DataFrame) -> DataFrame:
    """Rows whose column is in a list, or in the one column of a table of any size."""
    if isinstance(values, DataFrame):
        return df.join(values.toDF(column), column, "left_semi")
    return df.filter(F.col(column).isin(list(values)))


def matching(df: DataFrame, expression: str) -> DataFrame:
    """Rows for which a free boolean SQL expression is true; aggregates and windows fail analysis."""
    return df.filter(F.expr(expression))
