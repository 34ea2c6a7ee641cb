"""Declared queries and procedures: SQL over declared tables, ordered steps over a dict of tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import writes
from ..spec import EntitySpec, SpecError, field_type

Tables = dict[str, DataFrame]
_SELECT = re.compile(r"\s*\(*\s*(select|with|values)\b", re.I)


#: leaves of a plan that read no table
_TABLELESS = ("OneRowRelation", "LocalRelation", "Range", "CTERelationRef", "UnionLoopRef", "ResolvedInlineTable", "EmptyRelation")


def _relations(plan: Any, declared: set[str]) -> Iterator[str]:
    """What an analysed plan and its subqueries read beside the views in ``declared``."""
    inside = lambda seq: (seq.apply(k) for k in range(seq.size()))
    if plan.nodeName() == "View":
        if (name := plan.desc().identifier().table()) not in declared:
            yield name
        return
    for part in inside(plan.subqueries()):
        yield from _relations(part, declared)
    children = plan.children()
    if not children.size() and plan.nodeName() not in _TABLELESS:
        yield plan.simpleStringWithNodeId().split("[")[0].strip()
    for child in inside(children):
        yield from _relations(child, declared)


@dataclass(frozen=True)
class NamedQuery:
    """A SELECT with typed inputs (``:name``), a declared output, and the tables it may read (``{name}``).

    The analysed plan may hold no relation but those: a view or table of the session or a path to files is refused.
    """

    name: str
    sql: str
    inputs: dict[str, str] = field(default_factory=dict)
    output: dict[str, str] | EntitySpec = field(default_factory=dict)
    touches: tuple[str, ...] = ()

    def run(self, spark: SparkSession, tables: Tables, **inputs: Any) -> DataFrame:
        if set(inputs) != set(self.inputs):
            raise SpecError(f"{self.name} takes {sorted(self.inputs)}")
        if not _SELECT.match(self.sql):
            raise SpecError(f"{self.name} is not a SELECT")
        if missing := set(self.touches) - set(tables):
            raise SpecError(f"{self.name} reads {sorted(missing)}, which are not there")
        views = {t: f"{self.name}_{t}_{uuid.uuid4().hex}" for t in self.touches}
        try:
            for t, view in views.items():
                tables[t].createTempView(f"`{view}`")
            df = spark.sql(self.sql.format(**{t: f"`{view}`" for t, view in views.items()}), args=inputs or None)
        except KeyError as e:
            raise SpecError(f"{self.name} reads {e}, which it does not declare") from e
        finally:
            for view in views.values():
                spark.catalog.dropTempView(view)
        if others := sorted(set(_relations(df._jdf.queryExecution().analyzed(), set(views.values())))):
            raise SpecError(f"{self.name} reads {', '.join(others)}, which it does not declare")
        self._check(df)
        return df

    def _check(self, df: DataFrame) -> None:
        want = {f.name: f.kind.spark for f in self.output.fields} if isinstance(self.output, EntitySpec) else {k: field_type(t).spark for k, t in self.output.items()}
        if not want:
            return
        have = {f.name: f.dataType for f in df.schema}
        if set(have) != set(want):
            raise SpecError(f"{self.name} gives {sorted(have)}, declared are {sorted(want)}")
        for name, kind in want.items():
            if have[name].simpleString() != kind.simpleString():
                raise SpecError(f"{self.name}.{name} is {have[name].simpleString()}, declared is {kind.simpleString()}")


@dataclass(frozen=True)
class Step:
    """insert (rows), update (where, set), delete (where), or a function of (tables, inputs) that returns (table, changed)."""

    entity: str
    action: str
    rows: Callable[[Tables, dict], DataFrame] | None = None
    where: Callable[[dict], Column] | None = None
    set: Callable[[dict], dict] | None = None
    call: Callable[[Tables, dict], writes.Written] | None = None


@dataclass(frozen=True)
class Procedure:
    """Ordered writes. Steps see the results of earlier ones; either all tables are returned or an error is raised."""

    name: str
    inputs: dict[str, str]
    steps: tuple[Step, ...]

    def run(self, tables: Tables, specs: dict[str, EntitySpec], **inputs: Any) -> tuple[Tables, DataFrame]:
        """(all tables, changed rows as (entity, op, n))."""
        if set(inputs) != set(self.inputs):
            raise SpecError(f"{self.name} takes {sorted(self.inputs)}")
        out, counts = dict(tables), []
        for s in self.steps:
            spec = specs[s.entity]
            if s.action == "insert":
                out[s.entity], changed = writes.insert(out[s.entity], s.rows(out, inputs), spec)
            elif s.action == "update":
                out[s.entity], changed = writes.update(out[s.entity], s.where(inputs), s.set(inputs), spec)
            elif s.action == "delete":
                out[s.entity], changed = writes.delete(out[s.entity], s.where(inputs), spec)
            elif s.action == "call":
                out[s.entity], changed = s.call(out, inputs)
            else:
                raise SpecError(f"{self.name}: unknown action {s.action!r}")
            counts.append(changed.groupBy("op").agg(F.count(F.lit(1)).alias("n")).select(F.lit(s.entity).alias("entity"), "op", "n"))
        return out, reduce(DataFrame.unionByName, counts).groupBy("entity", "op").agg(F.sum("n").alias("n"))
