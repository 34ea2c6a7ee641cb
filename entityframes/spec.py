"""Entity specifications: what a table is, declared once and used by every operator.

A specification is plain driver-side metadata. Data is always a DataFrame with the columns of
``EntitySpec.struct()``.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CASCADE, SET_NULL, RESTRICT, NO_ACTION = "cascade", "set null", "restrict", "no action"
_SIMPLE: dict[str, tuple[str, T.DataType]] = {
    "smallint": ("int", T.ShortType()),
    "int": ("int", T.IntegerType()),
    "bigint": ("int", T.LongType()),
    "real": ("float", T.FloatType()),
    "double": ("float", T.DoubleType()),
    "boolean": ("bool", T.BooleanType()),
    "text": ("string", T.StringType()),
    "uuid": ("string", T.StringType()),
    "citext": ("string", T.StringType()),
    "timestamptz": ("timestamp", T.TimestampType()),
    "date": ("timestamp", T.DateType()),
    "interval": ("interval", T.DayTimeIntervalType()),
    "bytea": ("bytes", T.BinaryType()),
    "jsonb": ("json", T.StringType()),
}
_SIZED = re.compile(r"(varchar|numeric|vector)\((\d+)(?:\s*,\s*(\d+))?\)")


class SpecError(ValueError):
    """A specification or a request that contradicts it."""


@dataclass(frozen=True)
class FieldType:
    """kind: int, float, bool, string, timestamp, interval, bytes, json, numeric, vector or array."""

    declared: str
    kind: str
    spark: T.DataType
    length: int | None = None
    precision: int | None = None
    scale: int | None = None
    dim: int | None = None


def field_type(declared: str) -> FieldType:
    text = declared.strip().lower()
    if text.endswith("[]"):
        inner = field_type(text[:-2])
        if inner.kind in ("vector", "array"):
            raise SpecError(f"no arrays of {inner.declared}")
        return FieldType(text, "array", T.ArrayType(inner.spark))
    if text in _SIMPLE:
        return FieldType(text, *_SIMPLE[text])
    if m := _SIZED.fullmatch(text):
        a, b = int(m[2]), int(m[3] or 0)
        if m[1] == "varchar" and a > 0 and m[3] is None:
            return FieldType(text, "string", T.StringType(), length=a)
        if m[1] == "numeric" and 0 < a <= 38 and b <= a:
            return FieldType(text, "numeric", T.DecimalType(a, b), precision=a, scale=b)
        if m[1] == "vector" and 0 < a <= 16000 and m[3] is None:
            return FieldType(text, "vector", T.ArrayType(T.FloatType()), dim=a)
    raise SpecError(f"unknown type {declared!r}")


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    nullable: bool = True
    unique: bool = False
    serial: bool = False
    default: Any = None  # a value, or a Column for now() and expressions
    check: str | None = None
    references: tuple[str, str] | None = None  # entity, field
    on_delete: str = NO_ACTION

    @property
    def kind(self) -> FieldType:
        return field_type(self.type)


@dataclass(frozen=True)
class EntitySpec:
    name: str
    fields: tuple[Field, ...]
    primary_key: tuple[str, ...]
    unique_sets: tuple[tuple[tuple[str, ...], str | None], ...] = ()  # (columns, predicate or None)
    checks: tuple[str, ...] = ()
    soft_delete: str | None = None
    touch: str | None = None
    tenant: str | None = None
    time: str | None = None
    chunk: str = "7 days"
    ttl: str | None = None
    relations: dict[str, tuple[str, str, bool]] = field(default_factory=dict, hash=False)  # name: entity, via field, many

    def __post_init__(self):
        names = [f.name for f in self.fields]
        if len(set(names)) < len(names):
            raise SpecError(f"{self.name}: a field is declared twice")
        if not self.primary_key:
            raise SpecError(f"{self.name}: no primary key")
        markers = [self.soft_delete, self.touch, self.tenant, self.time, self.ttl]
        for c in [*self.primary_key, *(c for cols, _ in self.unique_sets for c in cols), *(m for m in markers if m)]:
            if c not in names:
                raise SpecError(f"{self.name}: unknown field {c!r}")
        for f in self.fields:
            f.kind  # noqa: B018  the type must be known
        if self.soft_delete and not (self[self.soft_delete].nullable and self[self.soft_delete].type == "timestamptz"):
            raise SpecError(f"{self.name}: the soft-delete field must be a nullable timestamptz")
        if self.tenant and self[self.tenant].nullable:
            raise SpecError(f"{self.name}: the tenant field must be not null")
        if self.time and self[self.time].type != "timestamptz":
            raise SpecError(f"{self.name}: the time field must be a timestamptz")

    def __getitem__(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise SpecError(f"{self.name} has no field {name!r}")

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.fields]

    def struct(self) -> T.StructType:
        pk = set(self.primary_key)

        def made(f: Field) -> T.StructField:
            k = f.kind
            extra = {n: v for n, v in (("length", k.length), ("dim", k.dim), ("declared", k.declared)) if v is not None}
            return T.StructField(f.name, k.spark, f.nullable and f.name not in pk, extra)

        return T.StructType([made(f) for f in self.fields])

    def check_columns(self, names: list[str]) -> None:
        for n in names:
            self[n]

    def lines(self) -> list[str]:
        """Canonical text of the schema, one line a fact."""
        out = [f"entity {self.name}"]
        out += [f"{f.name} {f.kind.declared} {'null' if f.nullable else 'not null'}" for f in self.fields]
        out.append("key " + ",".join(self.primary_key))
        out += [f"{n} {v}" for n in ("soft_delete", "touch", "tenant", "time", "ttl") if (v := getattr(self, n))]
        return out


def signature(specs: list[EntitySpec]) -> str:
    """SHA-256 over the canonical lines of all entities in order of name."""
    lines = [line for s in sorted(specs, key=lambda s: s.name) for line in s.lines()]
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def inbound(specs: list[EntitySpec], target: str) -> list[tuple[EntitySpec, Field]]:
    """The foreign keys that point at ``target``, in a stable order."""
    return [(s, f) for s in sorted(specs, key=lambda s: s.name) for f in s.fields if f.references and f.references[0] == target]


def key_of(spec: EntitySpec, alias: str | None = None) -> Column:
    """The key as a struct of its columns: the row's identity in joins and windows."""
    prefix = f"{alias}." if alias else ""
    return F.struct(*[F.col(prefix + c) for c in spec.primary_key])


def key_text(spec: EntitySpec, separator: str = "\x1f") -> Column:
    """The key as text; the unit separator does not occur in key values."""
    return F.concat_ws(separator, *[F.col(c).cast("string") for c in spec.primary_key])


def conform(df: DataFrame, spec: EntitySpec) -> DataFrame:
    """The declared columns in the declared order."""
    return df.select(*spec.columns)
