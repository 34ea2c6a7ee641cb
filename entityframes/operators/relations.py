"""Joins along foreign keys: includes, joins with aggregated sides, existence joins, cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import CASCADE, RESTRICT, SET_NULL, EntitySpec, SpecError, inbound
from ..storage import materialise
from .aggregates import numbered, ranges_of

Tables = dict[str, DataFrame]


def include(parents: DataFrame, children: DataFrame, key: str, via: str, slot: str, columns: list[str] | None = None, max_children: int | None = None, order: Column | None = None) -> DataFrame:
    """``parents`` with an array ``slot`` of their children, sorted; without children it is empty.

    Children are grouped before the join, so parents are not multiplied. ``max_children`` bounds the
    array of a hot parent: the first ones in ``order``, of which every task passes on that many at most. Where all children
    of parents without a bound are wanted, use ``include_chunks``.
    """
    names = columns or [c for c in children.columns if c != via]
    if max_children is not None:
        w = Window.partitionBy(via).orderBy(order if order is not None else F.struct(*names))
        children = children.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= max_children)
    grouped = children.filter(F.col(via).isNotNull()).groupBy(F.col(via).alias("_via")).agg(F.sort_array(F.collect_list(F.struct(*names))).alias(slot))
    joined = parents.join(grouped, F.col(key) == F.col("_via"), "left").drop("_via")
    return joined.withColumn(slot, F.coalesce(slot, F.array().cast(grouped.schema[slot].dataType)))


def include_chunks(parents: DataFrame, children: DataFrame, key: str, via: str, slot: str, order: list[str], columns: list[str] | None = None, size: int = 10_000, chunk: str = "chunk") -> DataFrame:
    """``parents`` with all their children in arrays of at most ``size``: a row for each parent and chunk, numbered from 0.

    The children of a parent go by ``order``, within a chunk and from chunk to chunk; a parent without children has chunk 0 with an
    empty array. The children of a hot parent are numbered and collected in many tasks.
    """
    names = columns or [c for c in children.columns if c != via]
    held = children.filter(F.col(via).isNotNull()).select(via, *dict.fromkeys([*order, *names]))
    n = ranges_of(held)
    placed = numbered(held, [via], order, "_number", n)
    cut = F.floor((F.col("_number") - 1) / size).cast("long").alias("_chunk")
    grouped = placed.withColumn("_chunk", cut).repartition(n, via, "_chunk").groupBy(F.col(via).alias("_via"), "_chunk").agg(F.sort_array(F.collect_list(F.struct(F.col("_number"), F.struct(*names).alias("child")))).alias("_held"))
    grouped = grouped.withColumn("_held", F.transform("_held", lambda x: x["child"]))
    joined = parents.join(grouped, F.col(key) == F.col("_via"), "left")
    empty = F.array().cast(grouped.schema["_held"].dataType)
    return joined.select(*parents.columns, F.coalesce("_chunk", F.lit(0)).alias(chunk), F.coalesce("_held", empty).alias(slot))


def include_many(parents: DataFrame, relations: list[tuple[DataFrame, str, str, str, list[str] | None]]) -> DataFrame:
    """Several includes (children, key, via, slot, columns), each for itself."""
    for children, key, via, slot, columns in relations:
        parents = include(parents, children, key, via, slot, columns)
    return parents


def include_one(parents: DataFrame, children: DataFrame, key: str, via: str, slot: str, columns: list[str] | None = None) -> DataFrame:
    """At most one child as a struct, null without one. Two children of one parent fail the job."""
    names = columns or [c for c in children.columns if c != via]
    one = F.when(F.count(F.lit(1)) == 1, F.first(F.struct(*names))).otherwise(F.raise_error(F.concat(F.lit(f"{slot}: more than one for "), F.first(F.col(via).cast("string")))))
    grouped = children.filter(F.col(via).isNotNull()).groupBy(F.col(via).alias("_via")).agg(one.alias(slot))
    return parents.join(grouped, F.col(key) == F.col("_via"), "left").drop("_via")


def related(spec: EntitySpec, name: str, parents: DataFrame, tables: Tables, key: str) -> DataFrame:
    """A relation that ``spec`` declares, by its name."""
    if name not in spec.relations:
        raise SpecError(f"{spec.name} has no relation {name!r}")
    entity, via, many = spec.relations[name]
    return (include if many else include_one)(parents, tables[entity], key, via, name)


def with_counts(owners: DataFrame, owned: DataFrame, key: str, via: str, name: str) -> DataFrame:
    """``owners`` with the number of rows they own, 0 for none."""
    counts = owned.groupBy(F.col(via).alias("_via")).agg(F.count(F.lit(1)).alias(name))
    return owners.join(counts, F.col(key) == F.col("_via"), "left").drop("_via").withColumn(name, F.coalesce(name, F.lit(0)))


def presence(left: DataFrame, right: DataFrame, left_key: str, right_key: str, key: str = "key") -> DataFrame:
    """The union of two key sets: key, rows on each side, and flags for which sides have it."""
    a = left.groupBy(F.col(left_key).alias(key)).agg(F.count(F.lit(1)).alias("left_rows"))
    b = right.groupBy(F.col(right_key).alias(key)).agg(F.count(F.lit(1)).alias("right_rows"))
    joined = a.join(b, key, "full").withColumns({"in_left": F.col("left_rows").isNotNull(), "in_right": F.col("right_rows").isNotNull()})
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("left_rows", "right_rows")})


def without(df: DataFrame, other: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows without a partner (NOT EXISTS)."""
    return df.join(other.select(F.col(right_key).alias("_other")), F.col(left_key) == F.col("_other"), "left_anti")


def having(df: DataFrame, other: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows with a partner (IN subquery), each once."""
    return df.join(other.select(F.col(right_key).alias("_other")), F.col(left_key) == F.col("_other"), "left_semi")


class RestrictError(ValueError):
    """A delete is refused because rows refer to what it would delete."""


def cascade_delete(specs: list[EntitySpec], tables: Tables, entity: str, doomed: DataFrame, most_levels: int = 1000) -> Tables:
    """All tables after deleting ``doomed`` rows of ``entity`` and following the foreign keys.

    cascade deletes the referring rows in turn, set null clears their field, restrict and no action
    refuse while a referring row would be left over. Tables that are not touched are returned as they are.
    The keys of each level are written before the next is looked for (one semi-join each), and a level holds new rows
    only: entities may refer to themselves or to one another in circles. A longer chain than ``most_levels`` is an error.
    Rows of entities that nothing refers to end a chain: they go by an anti-join on their own field, without being written.
    """
    by_name, out = {s.name: s for s in specs}, dict(tables)
    gone: dict[str, DataFrame] = {}
    ends: dict[str, list[tuple[str, DataFrame, str]]] = {}  # (field, rows, column) of entities that end a chain

    def level(name: str, rows: DataFrame) -> DataFrame | None:
        """The rows not known yet, by their key and the columns that others refer to; None without any."""
        key = list(by_name[name].primary_key)
        named = [f.references[1] for _, f in inbound(specs, name)]
        new = rows.select(*dict.fromkeys([*key, *named]))
        new = materialise(new.join(gone[name], key, "left_anti") if name in gone else new, f"doomed-{name}")
        if new.isEmpty():
            return None
        gone[name] = gone[name].unionByName(new) if name in gone else new
        return new

    todo = {entity: level(entity, doomed.dropDuplicates([*by_name[entity].primary_key]))}
    for _ in range(most_levels):
        following: dict[str, DataFrame] = {}
        for name, rows in todo.items():
            for child, f in inbound(specs, name) if rows is not None else ():
                if f.on_delete == CASCADE and not list(inbound(specs, child.name)):
                    ends.setdefault(child.name, []).append((f.name, rows, f.references[1]))
                elif f.on_delete == CASCADE:
                    hit = having(tables[child.name], rows, f.name, f.references[1])
                    following[child.name] = following[child.name].unionByName(hit).dropDuplicates([*child.primary_key]) if child.name in following else hit
        if not following:
            break
        todo = {name: level(name, rows) for name, rows in following.items()}
    else:
        raise SpecError(f"a cascade from {entity} has more than {most_levels} levels")
    for name, rows in gone.items():
        for child, f in inbound(specs, name):
            if f.on_delete == SET_NULL:
                flag = rows.select(F.col(f.references[1]).alias("_target")).distinct()
                joined = out[child.name].join(flag, F.col(f.name) == F.col("_target"), "left")
                out[child.name] = joined.withColumn(f.name, F.when(F.col("_target").isNull(), F.col(f.name))).select(*out[child.name].columns)
            elif f.on_delete != CASCADE:
                left = having(tables[child.name], rows, f.name, f.references[1])
                if child.name in gone:
                    left = left.join(gone[child.name], list(child.primary_key), "left_anti")
                for field, ended, column in ends.get(child.name, ()):
                    left = without(left, ended, field, column)
                if not left.isEmpty():
                    raise RestrictError(f"{child.name} refers to deleted rows ({f.on_delete if f.on_delete == RESTRICT else 'no action'})")
    for name, found in ends.items():
        for field, rows, column in found:
            out[name] = without(out[name], rows, field, column)
    for name, keys in gone.items():
        out[name] = out[name].join(keys, list(by_name[name].primary_key), "left_anti")
    return out
