"""Schema catalogues as tables: difference, classes, drift, lineage, owners, impact.

A catalogue has one row per column: entity, field, type, len, p, s, is_array, dim, not_null, is_unique,
dflt, ref, on_delete, and where needed version and caller. All jobs are joins, windows and aggregates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..spec import EntitySpec

ADDITIVE, BACKFILL, BREAKING = "additive", "backfill", "breaking"
RANK = {ADDITIVE: 1, BACKFILL: 2, BREAKING: 3}
CATALOGUE = "entity string, field string, type string, len int, p int, s int, is_array boolean, dim int, not_null boolean, is_unique boolean, dflt string, ref string, on_delete string"


def catalogue(spark: SparkSession, specs: list[EntitySpec]) -> DataFrame:
    """The catalogue of declared entities (metadata of the size of the schema)."""
    rows = []
    for e in specs:
        for f in e.fields:
            k = f.kind
            base = "array" if k.kind == "array" else f.type.split("(")[0].lower()
            ref = ".".join(f.references) if f.references else None
            rows.append((e.name, f.name, f.type[:-2] if k.kind == "array" else base, k.length, k.precision, k.scale, k.kind == "array", k.dim, not f.nullable or f.name in e.primary_key, f.unique, None if f.default is None else str(f.default), ref, f.on_delete if ref else None))
    return spark.createDataFrame(rows, CATALOGUE)


def _int_rank(c: Column) -> Column:
    return F.when(c == "smallint", 1).when(c == "int", 2).when(c == "bigint", 3)


def type_change_class(o: str = "o", n: str = "n") -> Column:
    """Class of a type change between the structs or aliases ``o`` and ``n``; null if nothing changed.

    Array to scalar, back, or another vector dimension is breaking; wider numbers and texts are additive,
    narrower ones need a backfill, and so does any other change. A varchar without a length is widest.
    """
    a, b = (lambda c: F.col(f"{o}.{c}")), (lambda c: F.col(f"{n}.{c}"))
    same = reduce(lambda x, y: x & y, [a(c).eqNullSafe(b(c)) for c in ("type", "len", "p", "s", "is_array", "dim")])
    texts = ("varchar", "text")
    a_len, b_len = F.coalesce(a("len"), F.lit((1 << 31) - 1)), F.coalesce(b("len"), F.lit((1 << 31) - 1))
    ra, rb = _int_rank(a("type")), _int_rank(b("type"))
    wider_number = (b("s") >= a("s")) & (b("p") - b("s") >= a("p") - a("s"))
    return (
        F.when(same, None)
        .when(~a("is_array").eqNullSafe(b("is_array")), BREAKING)
        .when((a("type") == "vector") | (b("type") == "vector"), BREAKING)
        .when((a("type") == "numeric") & (b("type") == "numeric"), F.when(wider_number, ADDITIVE).otherwise(BACKFILL))
        .when(a("type").isin(*texts) & b("type").isin(*texts), F.when(b_len >= a_len, ADDITIVE).otherwise(BACKFILL))
        .when(ra.isNotNull() & rb.isNotNull(), F.when(rb >= ra, ADDITIVE).otherwise(BACKFILL))
        .otherwise(BACKFILL)
    )


def _action_rank(c: Column) -> Column:
    return F.when(c == "cascade", 1).when(c == "set null", 2).otherwise(3)


def fk_change_class(o: str = "o", n: str = "n") -> Column:
    """Another target is breaking; a stricter delete action needs a backfill; all else is additive; null if unchanged."""
    a, b = (lambda c: F.col(f"{o}.{c}")), (lambda c: F.col(f"{n}.{c}"))
    return (
        F.when(a("ref").eqNullSafe(b("ref")) & a("on_delete").eqNullSafe(b("on_delete")), None)
        .when(a("ref").isNull(), BACKFILL)
        .when(b("ref").isNull(), ADDITIVE)
        .when(a("ref") != b("ref"), BREAKING)
        .when(_action_rank(b("on_delete")) > _action_rank(a("on_delete")), BACKFILL)
        .otherwise(ADDITIVE)
    )


def schema_diff(old: DataFrame, new: DataFrame, removal: str = BREAKING) -> DataFrame:
    """(kind, class, entity, field, detail), one row a change, in order of entity and field.

    An entity that is new or gone gives one row and none for its fields.
    """
    keep = ["type", "len", "p", "s", "is_array", "dim", "not_null", "is_unique", "dflt", "ref", "on_delete"]
    o = old.select("entity", "field", F.struct(*keep).alias("o"))
    n = new.select("entity", "field", F.struct(*keep).alias("n"))
    eo, en = old.select("entity").distinct().withColumn("_old", F.lit(True)), new.select("entity").distinct().withColumn("_new", F.lit(True))
    entities = eo.join(en, "entity", "full")
    whole = entities.filter("_old is null or _new is null").select(
        F.when(F.col("_old").isNull(), "add_entity").otherwise("remove_entity").alias("kind"),
        F.when(F.col("_old").isNull(), ADDITIVE).otherwise(removal).alias("class"), "entity", F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("detail"))
    both = entities.filter("_old and _new").select("entity")
    rows = o.join(n, ["entity", "field"], "full").join(both, "entity", "left_semi")

    def change(kind: str, cls: Column, detail: Column) -> Column:
        return F.when(cls.isNotNull(), F.struct(F.lit(kind).alias("kind"), cls.alias("class"), detail.alias("detail")))

    there = F.col("o").isNotNull() & F.col("n").isNotNull()
    shown = lambda a, b: F.concat(F.coalesce(a.cast("string"), F.lit("-")), F.lit(" > "), F.coalesce(b.cast("string"), F.lit("-")))
    none = F.lit(None).cast("string")
    needed = F.col("n.not_null") & F.col("n.dflt").isNull()
    flag = lambda c, on, off: F.when(there & ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.when(F.col(f"n.{c}"), on).otherwise(off))
    changes = F.array_compact(F.array(
        change("add_field", F.when(F.col("o").isNull(), F.when(needed, BACKFILL).otherwise(ADDITIVE)), F.col("n.type")),
        change("remove_field", F.when(F.col("n").isNull(), F.lit(removal)), F.col("o.type")),
        change("change_type", F.when(there, type_change_class()), shown(F.col("o.type"), F.col("n.type"))),
        change("change_not_null", flag("not_null", BACKFILL, ADDITIVE), shown(F.col("o.not_null"), F.col("n.not_null"))),
        change("change_unique", flag("is_unique", BACKFILL, ADDITIVE), shown(F.col("o.is_unique"), F.col("n.is_unique"))),
        change("change_default", F.when(there & ~F.col("o.dflt").eqNullSafe(F.col("n.dflt")), ADDITIVE), shown(F.col("o.dflt"), F.col("n.dflt"))),
        change("change_reference", F.when(there, fk_change_class()), shown(F.col("o.ref"), F.col("n.ref"))),
    ))
    fields = rows.select("entity", "field", F.explode(changes).alias("c")).select("c.kind", "c.class", "entity", "field", F.coalesce("c.detail", none).alias("detail"))
    return whole.unionByName(fields).orderBy("entity", F.col("field").asc_nulls_first(), "kind")


def removal_class(removed: DataFrame, caller: str, owners: DataFrame, references: DataFrame) -> DataFrame:
    """``removed`` (entity) with its class: additive only if ``caller`` owns it and no other caller refers to it."""
    mine = owners.filter(F.col("caller") == caller).select("entity").distinct().withColumn("_mine", F.lit(True))
    used = references.filter(F.col("caller") != caller).select("entity").distinct().withColumn("_used", F.lit(True))
    joined = removed.join(mine, "entity", "left").join(used, "entity", "left")
    return joined.withColumn("class", F.when(F.col("_mine").isNotNull() & F.col("_used").isNull(), ADDITIVE).otherwise(BREAKING)).drop("_mine", "_used")


def highest_class(diff: DataFrame) -> DataFrame:
    """(class, changes): the highest class of a difference; additive without changes."""
    rank = reduce(lambda c, k: F.when(F.col("class") == k, RANK[k]).otherwise(c), RANK, F.lit(0))
    top = diff.agg(F.coalesce(F.max(rank), F.lit(1)).alias("r"), F.count(F.lit(1)).alias("changes"))
    return top.select(F.element_at(F.array(*[F.lit(k) for k in RANK]), F.col("r")).alias("class"), "changes")


def type_drift(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """(entity, field, declared_type, actual_type) of columns on both sides whose type or width differs."""
    shape = lambda: F.concat_ws(":", "type", F.coalesce(F.col("len").cast("string"), F.lit("")), F.coalesce(F.col("p").cast("string"), F.lit("")), F.coalesce(F.col("s").cast("string"), F.lit("")), F.col("is_array").cast("string"), F.coalesce(F.col("dim").cast("string"), F.lit("")))
    d, a = declared.select("entity", "field", shape().alias("declared_type")), actual.select("entity", "field", shape().alias("actual_type"))
    return d.join(a, ["entity", "field"]).filter("declared_type <> actual_type")


def unique_drift(declared: DataFrame, actual: DataFrame, columns: DataFrame) -> DataFrame:
    """Actual unique sets (entity, cols array) that are not declared in any order, if all their columns (entity, field) are."""
    key = lambda df: df.select("entity", F.array_sort("cols").alias("cols")).distinct()
    known = columns.groupBy("entity").agg(F.collect_set("field").alias("_known"))
    extra = key(actual).join(key(declared), ["entity", "cols"], "left_anti").join(known, "entity")
    return extra.filter(F.size(F.array_except("cols", "_known")) == 0).drop("_known")


def _plain_checks(df: DataFrame) -> DataFrame:
    """``df`` with the _key of its checks: the expression without what surely means nothing.

    That is white space, the case of names, and up to three brackets around the whole. Inner brackets and literals stay
    as they are, and so does the case of a check with quoted names.
    """
    squeeze = lambda x: F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r" ?([^\w\s]) ?", "$1")
    outside = lambda x: squeeze(F.when(F.contains("expression", F.lit('"')), x).otherwise(F.lower(x)))
    parts = F.transform(F.split("expression", "'"), lambda x, i: F.when(i % 2 == 0, outside(x)).otherwise(x))
    df = df.withColumn("_key", F.trim(F.array_join(parts, "'")))

    def deeper(acc: Column, c: Column) -> Column:
        now = acc["deep"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)
        return F.struct(now.alias("deep"), F.least(acc["least"], F.when(c == "", acc["least"]).otherwise(now)).alias("least"))

    for _ in range(3):
        inside = F.regexp_replace("_key", "'[^']*'", "''")
        all_but_last = F.split(F.substring(inside, F.lit(1), F.length(inside) - 1), "")
        least = F.aggregate(all_but_last, F.struct(F.lit(0).alias("deep"), F.lit(1).alias("least")), deeper)["least"]
        around = F.startswith("_key", F.lit("(")) & F.endswith("_key", F.lit(")")) & (least > 0)
        df = df.withColumn("_key", F.when(around, F.trim(F.substring("_key", F.lit(2), F.length("_key") - 2))).otherwise(F.col("_key")))
    return df


def check_drift(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """(entity, expression, direction) of checks on one side only.

    Two checks are equal if they differ in white space, the case of names and brackets around the whole only. What
    cannot be told equal in this way is drift: different checks are never taken for equal.
    """
    plain = lambda df: _plain_checks(df).dropDuplicates(["entity", "_key"])
    d, a = plain(declared).withColumnRenamed("expression", "_d"), plain(actual).withColumnRenamed("expression", "_a")
    joined = d.join(a, ["entity", "_key"], "full").filter("_d is null or _a is null")
    return joined.select("entity", F.coalesce("_d", "_a").alias("expression"), F.when(F.col("_a").isNull(), "declared_not_enforced").otherwise("enforced_not_declared").alias("direction"))


def drift_severity(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """(entity, field, severity, blocks): addition (declared only), removal (actual only) or mismatch, which blocks."""
    d = declared.select("entity", "field", F.struct("type", "len", "p", "s", "is_array", "dim").alias("d"))
    a = actual.select("entity", "field", F.struct("type", "len", "p", "s", "is_array", "dim").alias("a"))
    severity = F.when(F.col("a").isNull(), "addition").when(F.col("d").isNull(), "removal").when(F.col("d") != F.col("a"), "mismatch")
    severity = F.when(F.col("a").isNotNull() & F.col("d").isNotNull() & F.col("d").eqNullSafe(F.col("a")), None).otherwise(F.coalesce(severity, F.lit("mismatch")))
    out = d.join(a, ["entity", "field"], "full").withColumn("severity", severity).filter("severity is not null")
    return out.select("entity", "field", "severity", (F.col("severity") == "mismatch").alias("blocks"))


def lineage(log: DataFrame) -> DataFrame:
    """Who introduced, last changed and removed each field, from a change log (seq, caller, at, entity, field, op).

    op is add, change or remove; a null field with remove removes every field of the entity known so far.
    removed_at is cleared when a field comes back. Of the removals of an entity only the last one can count, so
    both sides are grouped first, and a field meets at most one row.
    """
    first = F.when(F.col("op") == "add", F.col("seq"))
    touch = F.when(F.col("op").isin("add", "change"), F.col("seq"))
    fields = log.filter("field is not null").groupBy("entity", "field").agg(
        F.min_by("caller", first).alias("introduced_by"), F.min_by("at", first).alias("introduced_at"),
        F.max_by("caller", touch).alias("last_modified_by"), F.max_by("at", touch).alias("last_modified_at"),
        F.max_by(F.struct("op", "at", "seq"), "seq").alias("_last"), F.min(first).alias("_since"))
    whole = log.filter("field is null and op = 'remove'").groupBy(F.col("entity").alias("_entity")).agg(F.max_by(F.struct("at", "seq"), "seq").alias("_whole"))
    joined = fields.join(whole, F.col("entity") == F.col("_entity"), "left")
    later = (F.col("_whole.seq") > F.col("_since")) & (F.col("_whole.seq") > F.col("_last.seq"))
    removed = F.when(later, F.col("_whole.at")).when(F.col("_last.op") == "remove", F.col("_last.at"))
    return joined.withColumn("removed_at", removed).drop("_last", "_since", "_whole", "_entity")


def owners(found: DataFrame) -> DataFrame:
    """(entity, fields, owner): entities with live fields, their number, and who introduced the first."""
    live = found.filter("removed_at is null")
    return live.groupBy("entity").agg(F.count(F.lit(1)).alias("fields"), F.min_by("introduced_by", F.when(F.col("introduced_at").isNotNull(), F.struct("introduced_at", "field"))).alias("owner"))


def version_diff(versions: DataFrame, a: int, b: int) -> DataFrame:
    """``schema_diff`` between two versions of a versioned catalogue."""
    return schema_diff(versions.filter(F.col("version") == a), versions.filter(F.col("version") == b))


def change_counts(log: DataFrame, version: str = "version") -> DataFrame:
    return log.groupBy(version).agg(F.count(F.lit(1)).alias("changes"))


def rollback_plan(versions: DataFrame, to: int) -> tuple[DataFrame, DataFrame]:
    """(changes from the newest version back to ``to``, their class and number)."""
    newest = versions.agg(F.max("version").alias("v")).first()["v"]
    diff = version_diff(versions, newest, to)
    return diff, highest_class(diff)


def impact(changes: DataFrame, declared: DataFrame) -> DataFrame:
    """(caller, affected, changes) of each caller (caller, entity): whether it declares a touched entity."""
    touched = changes.groupBy("entity").agg(F.count(F.lit(1)).alias("_n"))
    joined = declared.select("caller", "entity").distinct().join(touched, "entity", "left")
    return joined.groupBy("caller").agg(F.bool_or(F.col("_n").isNotNull()).alias("affected"), F.coalesce(F.sum("_n"), F.lit(0)).alias("changes"))


def caller_summary(registrations: DataFrame, versions: DataFrame) -> DataFrame:
    """(caller, files, versions, last_version, registered, applied): both sides counted before they are joined."""
    r = registrations.groupBy("caller").agg(F.countDistinct("file_path").alias("files"))
    v = versions.groupBy("caller").agg(F.countDistinct("version").alias("versions"), F.max("version").alias("last_version"))
    joined = r.join(v, "caller", "full").withColumns({"registered": F.col("files").isNotNull(), "applied": F.col("versions").isNotNull()})
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("files", "versions")})


def content_hash(df: DataFrame) -> DataFrame:
    """(rows, content): identity of a table, whatever the order of its rows; sums of two row hashes."""
    row = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(df.columns)]
    parts = [F.sum(F.xxhash64(F.lit(k), *row).cast("decimal(38,0)")) for k in (0, 1)]
    rows = F.count(F.lit(1))
    return df.agg(rows.alias("rows"), F.sha2(F.concat_ws(":", rows.cast("string"), *[F.coalesce(p.cast("string"), F.lit("0")) for p in parts]), 256).alias("content"))


def ordered_changes(log: DataFrame) -> DataFrame:
    """The log with each change's place within its field's history."""
    return log.withColumn("place", F.row_number().over(Window.partitionBy("entity", "field").orderBy("seq")))
