"""Constraint audits: jobs that return the violating rows, and a report of counts over many tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import EntitySpec, field_type


def audit_not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, violations) of all columns in one pass."""
    counts = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("violations")) for c in columns])
    return counts.select(F.explode(pairs).alias("x")).select("x.*")


def audit_unique(df: DataFrame, columns: list[str], where: str | None = None) -> DataFrame:
    """(columns, rows) of values that occur more than once; a null never collides. ``where`` makes it partial."""
    if where is not None:
        df = df.filter(F.expr(where))
    df = df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def audit_fk(df: DataFrame, column: str, target: DataFrame, target_column: str) -> DataFrame:
    """The distinct values that refer to nothing."""
    values = df.filter(F.col(column).isNotNull()).select(column).distinct()
    return values.join(target.select(F.col(target_column).alias("_target")), F.col(column) == F.col("_target"), "left_anti")


def audit_check(df: DataFrame, expression: str) -> DataFrame:
    """Rows for which the check is false; null passes."""
    return df.filter(~F.coalesce(F.expr(expression), F.lit(True)))


def audit_narrowing(df: DataFrame, column: str, new_type: str) -> DataFrame:
    """Rows whose value does not fit into the narrower type."""
    t = field_type(new_type)
    c = F.col(column)
    if t.length is not None:
        bad: Column = F.char_length(c) > t.length
    elif t.kind == "numeric":
        # the target of a cast rounds: a value fits if its digits before the point do
        limit = 10 ** (t.precision - t.scale)
        bad = F.abs(F.round(c.cast("decimal(38,10)"), t.scale)) >= F.lit(limit)
    else:
        bad = c.try_cast(t.spark).isNull()
    return df.filter(c.isNotNull() & bad)


def audit_pk(df: DataFrame, spec: EntitySpec) -> DataFrame:
    """(key, rows, reason) of keys that are null or repeated."""
    null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in spec.primary_key])
    counts = df.groupBy(*spec.primary_key).agg(F.count(F.lit(1)).alias("rows"))
    reason = F.when(null, "null").when(F.col("rows") > 1, "repeated")
    return counts.withColumn("reason", reason).filter("reason is not null")


def audit_serial(df: DataFrame, column: str, next_id: int) -> DataFrame:
    """One row (max_id, next_id) if the next generated id would not be above the greatest; else none."""
    return df.agg(F.max(column).alias("max_id")).withColumn("next_id", F.lit(next_id).cast("long")).filter("max_id >= next_id")


def audit_all(tables: dict[str, DataFrame], specs: list[EntitySpec]) -> DataFrame:
    """(entity, audit, target, violations) of every declared constraint, sorted; not-null and checks take one scan."""
    parts: list[DataFrame] = []

    def counted(df: DataFrame, entity: str, audit: str, target: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(entity).alias("entity"), F.lit(audit).alias("audit"), F.lit(target).alias("target"), "violations")

    for s in specs:
        df = tables[s.name]
        rules = [("not null", f.name, F.col(f.name).isNull()) for f in s.fields if not f.nullable or f.name in s.primary_key]
        rules += [("check", e, ~F.coalesce(F.expr(e), F.lit(True))) for e in [*s.checks, *(f.check for f in s.fields if f.check)]]
        rules += [("length", f.name, F.char_length(f.name) > f.kind.length) for f in s.fields if f.kind.length]
        rules += [("dimension", f.name, F.size(f.name) != f.kind.dim) for f in s.fields if f.kind.dim]
        one = df.agg(*[F.count(F.when(bad, 1)).alias(f"_{i}") for i, (_, _, bad) in enumerate(rules)])
        rows = F.array(*[F.struct(F.lit(a).alias("audit"), F.lit(t).alias("target"), F.col(f"_{i}").alias("violations")) for i, (a, t, _) in enumerate(rules)])
        parts.append(one.select(F.explode(rows).alias("x")).select(F.lit(s.name).alias("entity"), "x.*"))
        parts.append(counted(audit_unique(df, list(s.primary_key)), s.name, "key", ",".join(s.primary_key)))
        for columns, where in [*s.unique_sets, *(((f.name,), None) for f in s.fields if f.unique)]:
            parts.append(counted(audit_unique(df, list(columns), where), s.name, "unique", ",".join(columns)))
        for f in s.fields:
            if f.references and f.references[0] in tables:
                parts.append(counted(audit_fk(df, f.name, tables[f.references[0]], f.references[1]), s.name, "reference", f.name))
    return reduce(DataFrame.unionByName, parts).orderBy("entity", "audit", "target")
