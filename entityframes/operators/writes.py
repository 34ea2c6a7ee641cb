"""Writes as table transforms: each returns (new table, changed rows).

``changed`` has the key columns and ``op`` (insert, update, delete); its count is the number of affected
rows. A new table never overwrites what it was read from: write it to a new place.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import EntitySpec, SpecError, conform
from .reads import numbered

Written = tuple[DataFrame, DataFrame]


class KeyConflict(ValueError):
    """A key is missing, or there twice."""


def _changed(df: DataFrame, spec: EntitySpec, op: str) -> DataFrame:
    return df.select(*spec.primary_key, F.lit(op).alias("op"))


def _col(value: Any) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _same(spec: EntitySpec, a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}") == F.col(f"{b}.{c}") for c in spec.primary_key])


def with_defaults(rows: DataFrame, spec: EntitySpec, as_of: datetime | None = None) -> DataFrame:
    """Missing columns added; null or missing values of fields with a default become it ("now" is ``as_of``)."""
    out = []
    for f in spec.fields:
        c = F.col(f.name) if f.name in rows.columns else F.lit(None)
        if f.default is not None:
            if f.default == "now" if isinstance(f.default, str) else False:
                if as_of is None:
                    raise SpecError(f"{spec.name}.{f.name}: the default is now, and as_of is not given")
                c = F.coalesce(c, F.lit(as_of))
            else:
                c = F.coalesce(c, _col(f.default))
        out.append(c.cast(f.kind.spark).alias(f.name))
    return rows.select(*out)


def with_serials(rows: DataFrame, table: DataFrame, spec: EntitySpec, order: list[str]) -> DataFrame:
    """Ids above the table's maximum for rows without one, in ``order``; numbered by range-partitioned sort."""
    name = next(f.name for f in spec.fields if f.serial)
    top = max(table.agg(F.coalesce(F.max(name), F.lit(0)).alias("m")).first()["m"], rows.agg(F.coalesce(F.max(name), F.lit(0)).alias("m")).first()["m"])
    given, missing = rows.filter(F.col(name).isNotNull()), rows.filter(F.col(name).isNull())
    made = numbered(missing, [F.col(c).asc_nulls_last() for c in order], "_n")
    made = made.withColumn(name, (F.col("_n") + F.lit(top + 1)).cast(rows.schema[name].dataType)).drop("_n")
    return given.unionByName(made.select(*rows.columns))


def check_new_keys(rows: DataFrame, spec: EntitySpec) -> None:
    """Input keys must be there and differ."""
    null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in spec.primary_key])
    found = rows.groupBy(*spec.primary_key).agg(F.count(F.lit(1)).alias("_n")).agg(F.max(null).alias("null"), F.max("_n").alias("most")).first()
    if found["null"]:
        raise KeyConflict(f"{spec.name}: a key is null")
    if (found["most"] or 0) > 1:
        raise KeyConflict(f"{spec.name}: two rows have the same key")


def insert(table: DataFrame, rows: DataFrame, spec: EntitySpec, as_of: datetime | None = None) -> Written:
    """A key that is null, twice in the input, or in the table already, is an error and nothing is written."""
    rows = with_defaults(rows, spec, as_of)
    check_new_keys(rows, spec)
    # an inner join: Spark may send the smaller side to the other one, which mostly are the new rows
    if not table.select(*spec.primary_key).join(rows.select(*spec.primary_key), list(spec.primary_key)).isEmpty():
        raise KeyConflict(f"{spec.name}: a key exists")
    return conform(table, spec).unionByName(rows), _changed(rows, spec, "insert")


def insert_ignore(table: DataFrame, rows: DataFrame, spec: EntitySpec, as_of: datetime | None = None) -> Written:
    """Rows whose key exists are skipped."""
    rows = with_defaults(rows, spec, as_of)
    check_new_keys(rows, spec)
    new = rows.join(table.select(*spec.primary_key), list(spec.primary_key), "left_anti")
    return conform(table, spec).unionByName(new), _changed(new, spec, "insert")


def _settable(spec: EntitySpec, names: list[str]) -> None:
    spec.check_columns(names)
    for n in names:
        if n in spec.primary_key:
            raise SpecError(f"{spec.name}: the key field {n!r} cannot be set")


def upsert(table: DataFrame, rows: DataFrame, spec: EntitySpec, set_: dict[str, Column] | None = None, as_of: datetime | None = None) -> Written:
    """Insert new keys; on existing ones set columns from expressions over ``excluded.*`` (proposed) and ``current.*``.

    ``set_`` defaults to all other columns as proposed. Two proposed rows of one key are an error. One
    full outer join on the key.
    """
    rest = [c for c in spec.columns if c not in spec.primary_key]
    set_ = {c: F.col(f"excluded.{c}") for c in rest} if set_ is None else set_
    _settable(spec, list(set_))
    rows = with_defaults(rows, spec, as_of)
    check_new_keys(rows, spec)
    if spec.touch and as_of is not None:
        set_ = set_ | {spec.touch: F.lit(as_of)}
    t = conform(table, spec).withColumn("_there", F.lit(True)).alias("current")
    r = rows.withColumn("_there", F.lit(True)).alias("excluded")
    joined = t.join(r, _same(spec, "current", "excluded"), "full")
    old, new = F.col("current._there").isNotNull(), F.col("excluded._there").isNotNull()
    values = [F.coalesce(F.col(f"current.{c}"), F.col(f"excluded.{c}")).alias(c) for c in spec.primary_key]
    for c in rest:
        set_value = set_[c].cast(spec[c].kind.spark) if c in set_ else F.col(f"current.{c}")
        values.append(F.when(old & new, set_value).when(old, F.col(f"current.{c}")).otherwise(F.col(f"excluded.{c}")).alias(c))
    op = F.when(old & new, "update").when(new, "insert")
    out = joined.select(*values, op.alias("_op"))
    return out.select(*spec.columns), out.filter("_op is not null").select(*spec.primary_key, F.col("_op").alias("op"))


def update(table: DataFrame, where: Column, set_: dict[str, Any], spec: EntitySpec, as_of: datetime | None = None) -> Written:
    """Rows for which ``where`` is true get the new values; a touch field gets ``as_of`` on those rows only."""
    _settable(spec, list(set_))
    if spec.touch and as_of is not None and spec.touch not in set_:
        set_ = set_ | {spec.touch: as_of}
    hit = F.coalesce(where, F.lit(False))
    marked = conform(table, spec).withColumn("_hit", hit)
    out = marked.select(*[F.when(F.col("_hit"), _col(set_[c]).cast(spec[c].kind.spark)).otherwise(F.col(c)).alias(c) if c in set_ else F.col(c) for c in spec.columns])
    return out, _changed(marked.filter("_hit"), spec, "update")


def update_from(table: DataFrame, rows: DataFrame, set_: dict[str, Any], spec: EntitySpec, on: dict[str, str] | None = None, where: Column | None = None, as_of: datetime | None = None) -> Written:
    """Set columns of the rows that have a partner in ``rows``, from expressions over ``current.*`` and ``source.*``.

    ``on`` maps columns of the table to those of ``rows``; by default both have the key. A partner counts if ``where`` is
    true for it. Rows without a partner stay as they are, and partners without a row are not inserted. Two source
    rows of one join key are an error, as either could be meant. One left join; a null key has no partner.
    """
    _settable(spec, list(set_))
    on = dict.fromkeys(spec.primary_key) if on is None else on
    right = [other or c for c, other in on.items()]
    if not rows.dropna(subset=right).groupBy(*right).count().filter("count > 1").isEmpty():
        raise KeyConflict(f"{spec.name}: two source rows have the same key")
    if spec.touch and as_of is not None and spec.touch not in set_:
        set_ = set_ | {spec.touch: F.lit(as_of)}
    same = reduce(lambda x, y: x & y, [F.col(f"current.{c}") == F.col(f"source.{other or c}") for c, other in on.items()])
    joined = conform(table, spec).alias("current").join(rows.withColumn("_there", F.lit(True)).alias("source"), same, "left")
    hit = F.col("source._there").isNotNull() & (F.coalesce(where, F.lit(False)) if where is not None else F.lit(True))
    value = lambda c: F.when(hit, _col(set_[c]).cast(spec[c].kind.spark)).otherwise(F.col(f"current.{c}")) if c in set_ else F.col(f"current.{c}")
    out = joined.select(*[value(c).alias(c) for c in spec.columns], hit.alias("_hit"))
    return out.select(*spec.columns), _changed(out.filter("_hit"), spec, "update")


def delete(table: DataFrame, where: Column, spec: EntitySpec) -> Written:
    """Rows for which ``where`` is true go; rows for which it is null stay."""
    hit = F.coalesce(where, F.lit(False))
    return conform(table, spec).filter(~hit), _changed(table.filter(hit), spec, "delete")


def soft_delete(table: DataFrame, where: Column, spec: EntitySpec, as_of: datetime) -> Written:
    """Mark rows that are not marked yet; marked ones are neither changed nor counted."""
    if not spec.soft_delete:
        raise SpecError(f"{spec.name} has no soft-delete field")
    return update(table, where & F.col(spec.soft_delete).isNull(), {spec.soft_delete: as_of}, spec, as_of)


def returning(table: DataFrame, rows: DataFrame, spec: EntitySpec) -> DataFrame:
    """The table's rows for the keys of ``rows``: inserted, updated, or (after insert_ignore) existing."""
    return table.join(rows.select(*spec.primary_key).distinct(), list(spec.primary_key), "left_semi")


def newest_first(df: DataFrame, spec: EntitySpec, order: str) -> DataFrame:
    """One row per key, the newest: prepares proposed rows for ``upsert``."""
    w = Window.partitionBy(*spec.primary_key).orderBy(F.col(order).desc())
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
