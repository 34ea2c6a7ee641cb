"""Schema catalogues, drift, lineage and owners (H), over catalogues that are derived from ``part`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog
from .registry import load, query

_COLUMNS = {
    "entity": "p_brand",
    "field": "concat('f', p_partkey)",
    "type": "CASE p_size % 4 WHEN 0 THEN 'varchar' WHEN 1 THEN 'numeric' WHEN 2 THEN 'int' ELSE 'bigint' END",
    "len": "CASE WHEN p_size % 4 = 0 THEN p_size END",
    "p": "CASE WHEN p_size % 4 = 1 THEN 10 + p_size % 5 END",
    "s": "CASE WHEN p_size % 4 = 1 THEN 2 END",
    "is_array": "p_partkey % 10 = 0",
    "dim": "CAST(NULL AS INT)",
    "not_null": "p_partkey % 3 = 0",
    "is_unique": "p_partkey % 5 = 0",
    "dflt": "CASE WHEN p_partkey % 4 = 0 THEN 'x' END",
    "ref": "CASE WHEN p_partkey % 6 = 0 THEN 'a.id' END",
    "on_delete": "CASE WHEN p_partkey % 6 = 0 THEN 'set null' END",
}
_CHANGED = _COLUMNS | {
    "type": "CASE WHEN p_partkey % 17 = 0 THEN 'bigint' ELSE CASE p_size % 4 WHEN 0 THEN 'varchar' WHEN 1 THEN 'numeric' WHEN 2 THEN 'int' ELSE 'bigint' END END",
    "len": "CASE WHEN p_size % 4 = 0 AND p_partkey % 17 <> 0 THEN CAST(p_size + (p_partkey % 3 - 1) * 5 AS INT) END",
    "p": "CASE WHEN p_size % 4 = 1 AND p_partkey % 17 <> 0 THEN CAST(10 + p_size % 5 + p_partkey % 2 AS INT) END",
    "s": "CASE WHEN p_size % 4 = 1 AND p_partkey % 17 <> 0 THEN CAST(2 + p_partkey % 3 AS INT) END",
    "is_array": "p_partkey % 20 = 0",
    "not_null": "p_partkey % 2 = 0",
    "ref": "CASE WHEN p_partkey % 18 = 0 THEN 'b.id' WHEN p_partkey % 6 = 0 THEN 'a.id' END",
    "on_delete": "CASE WHEN p_partkey % 6 = 0 THEN CASE WHEN p_partkey % 12 = 0 THEN 'cascade' ELSE 'restrict' END END",
}
_OLD_ROWS, _NEW_ROWS = "p_partkey % 7 <> 0 AND p_brand <> 'Brand#3'", "p_partkey % 11 <> 0 AND p_brand <> 'Brand#7'"


def _list(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in columns.items())


def _catalogues(spark, d) -> tuple[DataFrame, DataFrame]:
    p = load(spark, d, "part")
    return p.filter(_OLD_ROWS).selectExpr(*_list_of(_COLUMNS)), p.filter(_NEW_ROWS).selectExpr(*_list_of(_CHANGED))


def _list_of(columns: dict[str, str]) -> list[str]:
    return [f"{e} AS {n}" for n, e in columns.items()]


_TYPE_CLASS = """CASE WHEN o.type = n.type AND o.len IS NOT DISTINCT FROM n.len AND o.p IS NOT DISTINCT FROM n.p AND o.s IS NOT DISTINCT FROM n.s AND o.is_array = n.is_array THEN NULL
    WHEN o.is_array <> n.is_array THEN 'breaking'
    WHEN o.type = 'numeric' AND n.type = 'numeric' THEN CASE WHEN n.s >= o.s AND n.p - n.s >= o.p - o.s THEN 'additive' ELSE 'backfill' END
    WHEN o.type = 'varchar' AND n.type = 'varchar' THEN CASE WHEN n.len >= o.len THEN 'additive' ELSE 'backfill' END
    WHEN o.type IN ('int', 'bigint') AND n.type IN ('int', 'bigint') THEN CASE WHEN o.type = 'int' OR n.type = 'bigint' THEN 'additive' ELSE 'backfill' END
    ELSE 'backfill' END"""
_CTES = f"""old AS (SELECT {_list(_COLUMNS)} FROM part WHERE {_OLD_ROWS}), new AS (SELECT {_list(_CHANGED)} FROM part WHERE {_NEW_ROWS}),
    both_have AS (SELECT entity FROM old INTERSECT SELECT entity FROM new),
    o AS (SELECT * FROM old WHERE entity IN (SELECT * FROM both_have)), n AS (SELECT * FROM new WHERE entity IN (SELECT * FROM both_have)),
    rank(x, r) AS (VALUES ('cascade', 1), ('set null', 2), ('restrict', 3)),
    diff AS (
        SELECT 'add_entity' AS kind, 'additive' AS class, entity, NULL AS field FROM (SELECT entity FROM new EXCEPT SELECT entity FROM old)
        UNION ALL SELECT 'remove_entity', 'breaking', entity, NULL FROM (SELECT entity FROM old EXCEPT SELECT entity FROM new)
        UNION ALL SELECT 'add_field', CASE WHEN n.not_null AND n.dflt IS NULL THEN 'backfill' ELSE 'additive' END, entity, field FROM n ANTI JOIN o USING (entity, field)
        UNION ALL SELECT 'remove_field', 'breaking', entity, field FROM o ANTI JOIN n USING (entity, field)
        UNION ALL SELECT 'change_type', {_TYPE_CLASS} AS c, o.entity, o.field FROM o JOIN n USING (entity, field) WHERE ({_TYPE_CLASS}) IS NOT NULL
        UNION ALL SELECT 'change_not_null', CASE WHEN n.not_null THEN 'backfill' ELSE 'additive' END, o.entity, o.field FROM o JOIN n USING (entity, field) WHERE o.not_null <> n.not_null
        UNION ALL SELECT 'change_reference', CASE WHEN o.ref <> n.ref THEN 'breaking' WHEN (SELECT r FROM rank WHERE x = n.on_delete) > (SELECT r FROM rank WHERE x = o.on_delete) THEN 'backfill' ELSE 'additive' END, o.entity, o.field
            FROM o JOIN n USING (entity, field) WHERE o.ref IS DISTINCT FROM n.ref OR o.on_delete IS DISTINCT FROM n.on_delete)"""


@query("h2_h4_schema_diff", f"WITH {_CTES} SELECT * FROM diff")
def h2(spark, d):
    return catalog.schema_diff(*_catalogues(spark, d)).drop("detail")


@query("h3_type_change_class", f"WITH {_CTES} SELECT entity, field, {_TYPE_CLASS} AS class FROM o JOIN n USING (entity, field)")
def h3(spark, d):
    old, new = _catalogues(spark, d)
    return old.alias("o").join(new.alias("n"), ["entity", "field"]).select("entity", "field", catalog.type_change_class().alias("class"))


@query("h5_removal_class", "SELECT p_brand AS entity, CASE WHEN bool_or(p_partkey % 50 = 1) AND NOT bool_or(p_partkey % 97 = 5) THEN 'additive' ELSE 'breaking' END AS class FROM part GROUP BY 1")
def h5(spark, d):
    p = load(spark, d, "part")
    owners = p.filter("p_partkey % 50 = 1").select(F.col("p_brand").alias("entity"), F.lit("me").alias("caller"))
    refs = p.filter("p_partkey % 97 = 5").select(F.col("p_brand").alias("entity"), F.lit("other").alias("caller"))
    return catalog.removal_class(p.select(F.col("p_brand").alias("entity")).distinct(), "me", owners, refs.unionByName(owners))


@query("h6_highest_class", f"WITH {_CTES} SELECT CASE max(CASE class WHEN 'breaking' THEN 3 WHEN 'backfill' THEN 2 ELSE 1 END) WHEN 3 THEN 'breaking' WHEN 2 THEN 'backfill' ELSE 'additive' END AS class, count(*) AS changes FROM diff")
def h6(spark, d):
    return catalog.highest_class(catalog.schema_diff(*_catalogues(spark, d)))


@query("h7_type_drift", f"WITH {_CTES} SELECT entity, field FROM old o JOIN new n USING (entity, field) WHERE o.type <> n.type OR o.len IS DISTINCT FROM n.len OR o.p IS DISTINCT FROM n.p OR o.s IS DISTINCT FROM n.s OR o.is_array <> n.is_array")
def h7(spark, d):
    return catalog.type_drift(*_catalogues(spark, d)).select("entity", "field")


@query("h8_unique_drift", "SELECT DISTINCT p_brand AS entity, least(p_name, p_type) || '+' || greatest(p_name, p_type) AS cols FROM part WHERE p_size % 3 = 0 AND (p_brand, p_name, p_type) NOT IN (SELECT p_brand, p_name, p_type FROM part WHERE p_partkey % 2 = 0) AND (p_brand, p_type) IN (SELECT p_brand, p_type FROM part WHERE p_partkey % 3 = 0) AND (p_brand, p_name) IN (SELECT p_brand, p_name FROM part)")
def h8(spark, d):
    p = load(spark, d, "part")
    sets = lambda df: df.select(F.col("p_brand").alias("entity"), F.array("p_type", "p_name").alias("cols"))
    declared = p.filter("p_partkey % 2 = 0").select(F.col("p_brand").alias("entity"), F.array("p_name", "p_type").alias("cols"))
    columns = p.filter("p_partkey % 3 = 0").select(F.col("p_brand").alias("entity"), F.col("p_type").alias("field")).unionByName(p.select(F.col("p_brand").alias("entity"), F.col("p_name").alias("field")))
    return catalog.unique_drift(declared, sets(p.filter("p_size % 3 = 0")), columns).select("entity", F.array_join("cols", "+").alias("cols"))


@query("h9_check_drift", """SELECT p_brand AS entity, p_size::INT AS size, CASE WHEN bool_or(p_partkey % 2 = 0) THEN 'declared_not_enforced' ELSE 'enforced_not_declared' END AS direction
    FROM part GROUP BY ALL HAVING bool_or(p_partkey % 2 = 0) <> bool_or(p_partkey % 2 = 1)""")
def h9(spark, d):
    p = load(spark, d, "part")
    declared = p.filter("p_partkey % 2 = 0").select(F.col("p_brand").alias("entity"), F.expr("concat('Size = ', p_size)").alias("expression"))
    actual = p.filter("p_partkey % 2 = 1").select(F.col("p_brand").alias("entity"), F.expr("concat('(size=', p_size, ')')").alias("expression"))
    found = catalog.check_drift(declared, actual)
    return found.select("entity", F.regexp_extract("expression", r"(\d+)", 1).cast("int").alias("size"), "direction")


@query("h10_drift_severity", f"""WITH {_CTES} SELECT entity, field, CASE WHEN n.type IS NULL THEN 'addition' WHEN o.type IS NULL THEN 'removal' ELSE 'mismatch' END AS severity, n.type IS NOT NULL AND o.type IS NOT NULL AS blocks
    FROM old o FULL JOIN new n USING (entity, field) WHERE n.type IS NULL OR o.type IS NULL OR o.type <> n.type OR o.len IS DISTINCT FROM n.len OR o.p IS DISTINCT FROM n.p OR o.s IS DISTINCT FROM n.s OR o.is_array <> n.is_array""")
def h10(spark, d):
    return catalog.drift_severity(*_catalogues(spark, d))


_LOG = "(SELECT o_orderkey AS seq, 'c' || o_custkey % 7 AS caller, o_orderdate AS happened, 'e' || o_custkey % 40 AS entity, CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE 'f' || o_custkey END AS field, CASE WHEN o_orderkey % 41 = 0 THEN 'remove' WHEN o_orderkey % 5 = 0 THEN 'remove' WHEN o_orderkey % 3 = 0 THEN 'change' ELSE 'add' END AS op FROM orders)"


def _log(spark, d) -> DataFrame:
    return load(spark, d, "orders").selectExpr("o_orderkey as seq", "concat('c', o_custkey % 7) as caller", "o_orderdate as at", "concat('e', o_custkey % 40) as entity", "case when o_orderkey % 41 = 0 then null else concat('f', o_custkey) end as field",
                                               "case when o_orderkey % 41 = 0 then 'remove' when o_orderkey % 5 = 0 then 'remove' when o_orderkey % 3 = 0 then 'change' else 'add' end as op")


_LINEAGE = f"""log AS {_LOG}, known AS (SELECT entity, field, min(seq) AS since FROM log WHERE op = 'add' AND field IS NOT NULL GROUP BY ALL),
    ev AS (SELECT seq, caller, happened, entity, field, op FROM log WHERE field IS NOT NULL UNION ALL SELECT l.seq, l.caller, l.happened, l.entity, k.field, l.op FROM log l JOIN known k ON k.entity = l.entity AND l.seq > k.since WHERE l.field IS NULL),
    lineage AS (SELECT entity, field, arg_min(caller, seq) FILTER (op = 'add') AS introduced_by, arg_min(happened, seq) FILTER (op = 'add') AS introduced_at,
        arg_max(caller, seq) FILTER (op IN ('add', 'change')) AS last_modified_by, arg_max(happened, seq) FILTER (op IN ('add', 'change')) AS last_modified_at,
        CASE WHEN arg_max(op, seq) = 'remove' THEN arg_max(happened, seq) END AS removed_at FROM ev GROUP BY ALL)"""


@query("h11_lineage", f"WITH {_LINEAGE} SELECT * FROM lineage")
def h11(spark, d):
    return catalog.lineage(_log(spark, d))


@query("h12_owners", f"WITH {_LINEAGE} SELECT entity, count(*) AS fields, arg_min(introduced_by, (introduced_at, field)) FILTER (introduced_at IS NOT NULL) AS owner FROM lineage WHERE removed_at IS NULL GROUP BY 1")
def h12(spark, d):
    return catalog.owners(catalog.lineage(_log(spark, d)))


@query("h13_version_diff", f"WITH {_CTES} SELECT * FROM diff")
def h13(spark, d):
    old, new = _catalogues(spark, d)
    versions = old.withColumn("version", F.lit(1)).unionByName(new.withColumn("version", F.lit(2)))
    return catalog.version_diff(versions, 1, 2).drop("detail")


@query("h14_change_counts", f"SELECT seq // 100 AS version, count(*) AS changes FROM {_LOG} GROUP BY 1")
def h14(spark, d):
    return catalog.change_counts(_log(spark, d).withColumn("version", F.expr("seq div 100")))


# the way back: the newer version is where the difference starts
_BACK = _CTES.replace(f"old AS (SELECT {_list(_COLUMNS)} FROM part WHERE {_OLD_ROWS}), new AS (SELECT {_list(_CHANGED)} FROM part WHERE {_NEW_ROWS})",
                      f"new AS (SELECT {_list(_COLUMNS)} FROM part WHERE {_OLD_ROWS}), old AS (SELECT {_list(_CHANGED)} FROM part WHERE {_NEW_ROWS})")


@query("h15_rollback_plan", f"WITH {_BACK} SELECT kind, class, entity, field, count(*) OVER () AS changes, max(class) FILTER (class = 'breaking') OVER () AS highest FROM diff")
def h15(spark, d):
    old, new = _catalogues(spark, d)
    versions = old.withColumn("version", F.lit(1)).unionByName(new.withColumn("version", F.lit(2)))
    changes, found = catalog.rollback_plan(versions, 1)
    return changes.drop("detail").crossJoin(F.broadcast(found.select("changes", F.col("class").alias("highest"))))  # one row


@query("h16_impact", f"""WITH {_CTES}, t AS (SELECT entity, count(*) AS n FROM diff GROUP BY 1), d AS (SELECT DISTINCT p_type AS caller, p_brand AS entity FROM part WHERE p_size % 2 = 0)
    SELECT caller, bool_or(n IS NOT NULL) AS affected, coalesce(sum(n), 0)::BIGINT AS changes FROM d LEFT JOIN t USING (entity) GROUP BY 1""")
def h16(spark, d):
    declared = load(spark, d, "part").filter("p_size % 2 = 0").select(F.col("p_type").alias("caller"), F.col("p_brand").alias("entity"))
    return catalog.impact(catalog.schema_diff(*_catalogues(spark, d)), declared)


@query("h17_caller_summary", """SELECT caller, coalesce(files, 0) AS files, coalesce(versions, 0) AS versions, last_version, files IS NOT NULL AS registered, versions IS NOT NULL AS applied FROM
    (SELECT c_nationkey AS caller, count(DISTINCT c_mktsegment) AS files FROM customer WHERE c_nationkey % 4 <> 0 GROUP BY 1) FULL JOIN (SELECT s_nationkey AS caller, count(DISTINCT s_suppkey) AS versions, max(s_suppkey) AS last_version FROM supplier WHERE s_nationkey % 3 <> 0 GROUP BY 1) USING (caller)""")
def h17(spark, d):
    r = load(spark, d, "customer").filter("c_nationkey % 4 <> 0").select(F.col("c_nationkey").alias("caller"), F.col("c_mktsegment").alias("file_path"))
    v = load(spark, d, "supplier").filter("s_nationkey % 3 <> 0").select(F.col("s_nationkey").alias("caller"), F.col("s_suppkey").alias("version"))
    return catalog.caller_summary(r, v)


@query("h18_content_hash", "SELECT count(*) AS rows, true AS same_in_any_order, false AS same_with_a_value_changed, false AS same_with_a_row_twice FROM orders")
def h18(spark, d):
    o = load(spark, d, "orders")
    changed = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") == F.lit(o.agg(F.min("o_orderkey")).first()[0]), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    others = {"same_in_any_order": o.orderBy(F.desc("o_totalprice")), "same_with_a_value_changed": changed, "same_with_a_row_twice": o.unionByName(o.limit(1))}
    out = catalog.content_hash(o)
    for name, df in others.items():  # one row each
        out = out.crossJoin(catalog.content_hash(df).select(F.col("content").alias(f"_{name}")))
    return out.select("rows", *[(F.col("content") == F.col(f"_{name}")).alias(name) for name in others])
