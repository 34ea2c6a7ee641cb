"""Table differences, change events, versions and invalidation by value or tag."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import EntitySpec, SpecError, key_text

ADDED, REMOVED, MODIFIED = "added", "removed", "modified"


def _sides(before: DataFrame, after: DataFrame, key: list[str]) -> tuple[DataFrame, list[str]]:
    rest = [c for c in before.columns if c not in key]
    b = before.select(*key, F.struct(F.lit(1).alias("_"), *rest).alias("_before"))
    a = after.select(*key, F.struct(F.lit(1).alias("_"), *rest).alias("_after"))
    return b.join(a, key, "full"), rest


def table_diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(key, change): rows added, removed or modified; nulls are equal. One full outer join on the key."""
    joined, _ = _sides(before, after, key)
    change = F.when(F.col("_before").isNull(), ADDED).when(F.col("_after").isNull(), REMOVED).when(~F.col("_before").eqNullSafe(F.col("_after")), MODIFIED)
    return joined.select(*key, change.alias("change")).filter("change is not null")


def column_changes(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(key, columns): the names of the columns that differ in each modified row."""
    joined, rest = _sides(before, after, key)
    names = F.array_compact(F.array(*[F.when(~F.col(f"_before.{c}").eqNullSafe(F.col(f"_after.{c}")), F.lit(c)) for c in rest]))
    both = joined.filter("_before is not null and _after is not null")
    return both.select(*key, names.alias("columns")).filter(F.size("columns") > 0)


def table_diff_counts(before: dict[str, DataFrame], after: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    """(table, added, removed, modified) of the tables that changed; a table on one side counts all its rows."""
    parts = []
    for name in sorted(set(before) | set(after)):
        if name in before and name in after:
            change = table_diff(before[name], after[name], keys[name]).select("change")
        else:
            df, kind = (after[name], ADDED) if name in after else (before[name], REMOVED)
            change = df.select(F.lit(kind).alias("change"))
        count = lambda k: F.count(F.when(F.col("change") == k, 1)).alias(k)
        parts.append(change.agg(*[count(k) for k in (ADDED, REMOVED, MODIFIED)]).select(F.lit(name).alias("table"), ADDED, REMOVED, MODIFIED))
    return reduce(DataFrame.unionByName, parts).filter("added + removed + modified > 0")


def change_events(before: DataFrame, after: DataFrame, spec: EntitySpec, version: int) -> DataFrame:
    """One ``invalidation`` per written row and, if there is any, one ``generation_bump`` for the table."""
    changed = table_diff(before, after, list(spec.primary_key))
    rows = changed.select(F.lit("invalidation").alias("kind"), F.lit(spec.name).alias("entity"), key_text(spec).alias("row_id"), F.lit(version).cast("long").alias("new_version"))
    bump = changed.agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.lit("generation_bump").alias("kind"), F.lit(spec.name).alias("entity"), F.lit(None).cast("string").alias("row_id"), F.lit(version).cast("long").alias("new_version"))
    return rows.unionByName(bump)


def latest_version(events: DataFrame, keys: tuple[str, ...] = ("entity", "row_id"), version: str = "new_version") -> DataFrame:
    """The highest version of each row; lower ones are stale. A grouped maximum, so duplicates do not matter."""
    return events.groupBy(*keys).agg(F.max(version).alias(version))


def affected_by(changes: DataFrame, table: DataFrame, field: str, self_field: str) -> DataFrame:
    """Rows of ``table`` whose ``self_field`` equals ``field`` of a changed row."""
    wanted = changes.filter(F.col(field).isNotNull()).select(F.col(field).alias("_value")).distinct()
    return table.join(wanted, F.col(self_field) == F.col("_value"), "left_semi")


_PLACE = re.compile(r"\{(\w+)\}")


def tag(template: str, columns: list[str]) -> Column:
    """The tag of a row by a template such as ``customer:{customer_id}``; null if a value is null."""
    parts, at = [], 0
    for m in _PLACE.finditer(template):
        if m[1] not in columns:
            raise SpecError(f"the template names an unknown field {m[1]!r}")
        parts += [F.lit(template[at : m.start()]), F.col(m[1]).cast("string")]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def tag_keys(rows: DataFrame, template: str, name: str = "tag") -> DataFrame:
    return rows.withColumn(name, tag(template, rows.columns))


def invalidate_tags(changes: DataFrame, change_template: str, tables: dict[str, tuple[DataFrame, list[str], str]]) -> DataFrame:
    """(table, row_id, tag) of all rows, in any table (rows, key, template), that share a tag with a change."""
    tags = tag_keys(changes, change_template).select("tag").filter("tag is not null").distinct()
    parts = []
    for name, (df, key, template) in sorted(tables.items()):
        row_id = F.concat_ws("\x1f", *[F.col(c).cast("string") for c in key])
        parts.append(tag_keys(df, template).join(tags, "tag", "left_semi").select(F.lit(name).alias("table"), row_id.alias("row_id"), "tag"))
    return reduce(DataFrame.unionByName, parts)


def counters(events: DataFrame, kind: str, result: str) -> DataFrame:
    """Processed events by kind and result."""
    return events.groupBy(kind, result).agg(F.count(F.lit(1)).alias("processed"))
