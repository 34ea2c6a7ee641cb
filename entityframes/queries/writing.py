"""Writes, differences, generated data, backfill and audits (W, D, B, A)."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audits, backfill, changes, relations, writes
from ..plans.named import Procedure, Step
from ..plans.store import TableStore
from ..sources import tables
from ..sources.generate import generate
from ..spec import CASCADE, SET_NULL, EntitySpec, Field
from ..storage import fresh_path
from .registry import AS_OF, BEFORE_AFTER_SQL, CUSTOMER, LINEITEM, NATION, ORDERS, REGION, before_after, load, query

SMALL = EntitySpec("accounts", (Field("id", "bigint"), Field("plan", "text", default="free"), Field("score", "bigint", default=7), Field("touched", "timestamptz"), Field("gone_at", "timestamptz")), ("id",), soft_delete="gone_at", touch="touched")
SERIAL = EntitySpec("notes", (Field("id", "bigint", serial=True), Field("owner", "bigint")), ("id",))
ACCOUNTS = "accounts AS (SELECT c_custkey AS id, c_mktsegment AS plan, c_nationkey::BIGINT AS score, NULL::TIMESTAMP AS touched, CASE WHEN c_custkey % 4 = 0 THEN TIMESTAMP '2023-01-01' END AS gone_at FROM customer WHERE c_custkey % 3 <> 0)"
ROWS = "rows AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS plan, c_custkey * 2 AS score FROM customer WHERE c_custkey % 5 = 0)"


def _accounts(spark, d) -> DataFrame:
    c = load(spark, d, "customer").filter("c_custkey % 3 <> 0")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("plan"), F.col("c_nationkey").cast("long").alias("score"), F.lit(None).cast("timestamp").alias("touched"), F.expr("case when c_custkey % 4 = 0 then timestamp '2023-01-01' end").alias("gone_at"))


def _rows(spark, d) -> DataFrame:
    return load(spark, d, "customer").filter("c_custkey % 5 = 0").select(F.col("c_custkey").alias("id"), F.expr("case when c_custkey % 2 = 0 then c_name end").alias("plan"), (F.col("c_custkey") * 2).alias("score"))


@query("w1_insert", "SELECT o_orderkey, o_custkey FROM orders")
def w1(spark, d):
    o = load(spark, d, "orders")
    return writes.insert(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1"), ORDERS)[0].select("o_orderkey", "o_custkey")


@query("w2_defaults", f"WITH {ROWS} SELECT id, coalesce(plan, 'free') AS plan, score FROM rows")
def w2(spark, d):
    return writes.with_defaults(_rows(spark, d), SMALL).select("id", "plan", "score")


@query("w3_serials", """SELECT CASE WHEN c_custkey % 3 = 0 THEN (SELECT max(c_custkey) FROM customer) + row_number() OVER (PARTITION BY c_custkey % 3 = 0 ORDER BY c_custkey) ELSE c_custkey END AS id, c_custkey AS owner FROM customer""")
def w3(spark, d):
    c = load(spark, d, "customer")
    table = c.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("owner"))
    return writes.with_serials(table.withColumn("id", F.expr("case when owner % 3 = 0 then null else id end")), table, SERIAL, ["owner"])


@query("w4_insert_ignore", f"WITH {ACCOUNTS}, {ROWS} SELECT id, plan, score FROM accounts UNION ALL SELECT id, coalesce(plan, 'free'), score FROM rows WHERE id NOT IN (SELECT id FROM accounts)")
def w4(spark, d):
    return writes.insert_ignore(_accounts(spark, d), _rows(spark, d), SMALL)[0].select("id", "plan", "score")


@query("w5_upsert", f"""WITH {ACCOUNTS}, {ROWS}, r AS (SELECT id, coalesce(plan, 'free') AS plan, score FROM rows)
    SELECT coalesce(a.id, r.id) AS id, CASE WHEN a.id IS NULL THEN r.plan ELSE a.plan END AS plan, CASE WHEN a.id IS NULL THEN r.score WHEN r.id IS NULL THEN a.score ELSE a.score + r.score END AS score,
           CASE WHEN a.id IS NOT NULL AND r.id IS NOT NULL THEN TIMESTAMP '2024-01-20' END AS touched
    FROM accounts a FULL JOIN r ON a.id = r.id""")
def w5(spark, d):
    out, _ = writes.upsert(_accounts(spark, d), _rows(spark, d), SMALL, {"score": F.col("current.score") + F.col("excluded.score")}, AS_OF)
    return out.select("id", "plan", "score", "touched")


@query("w5_upsert_changed", f"WITH {ACCOUNTS}, {ROWS} SELECT id, CASE WHEN id IN (SELECT id FROM accounts) THEN 'update' ELSE 'insert' END AS op FROM rows")
def w5c(spark, d):
    return writes.upsert(_accounts(spark, d), _rows(spark, d), SMALL)[1]


@query("w6_w7_update_touch", f"WITH {ACCOUNTS} SELECT id, CASE WHEN score > 12 THEN 'gold' ELSE plan END AS plan, CASE WHEN score > 12 THEN TIMESTAMP '2024-01-20' END AS touched FROM accounts")
def w6(spark, d):
    return writes.update(_accounts(spark, d), F.col("score") > 12, {"plan": "gold"}, SMALL, AS_OF)[0].select("id", "plan", "touched")


@query("w8_delete", f"WITH {ACCOUNTS} SELECT id FROM accounts WHERE NOT coalesce(gone_at < TIMESTAMP '2024-01-01', false)")
def w8(spark, d):
    return writes.delete(_accounts(spark, d), F.col("gone_at") < datetime(2024, 1, 1), SMALL)[0].select("id")


@query("w9_soft_delete", f"WITH {ACCOUNTS} SELECT id, CASE WHEN score < 5 AND gone_at IS NULL THEN TIMESTAMP '2024-01-20' ELSE gone_at END AS gone_at FROM accounts")
def w9(spark, d):
    return writes.soft_delete(_accounts(spark, d), F.col("score") < 5, SMALL, AS_OF)[0].select("id", "gone_at")


def _cascaded(spark, d, specs, doomed):
    t = {n: load(spark, d, n) for n in ("region", "nation", "customer", "orders", "lineitem")}
    return relations.cascade_delete(specs, t, "nation", t["nation"].filter(doomed))


@query("w10_cascade_delete", """WITH c AS (SELECT * FROM customer WHERE c_nationkey % 4 <> 0), o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)), l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o))
    SELECT 'nation' AS entity, n_nationkey::BIGINT AS id, count(*) AS rows FROM nation WHERE n_nationkey % 4 <> 0 GROUP BY ALL UNION ALL SELECT 'customer', c_custkey, count(*) FROM c GROUP BY ALL
    UNION ALL SELECT 'orders', o_orderkey, count(*) FROM o GROUP BY ALL UNION ALL SELECT 'lineitem', l_orderkey, count(*) FROM l GROUP BY ALL""")
def w10(spark, d):
    line = EntitySpec("lineitem", LINEITEM.fields, ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"))
    out = _cascaded(spark, d, [REGION, NATION, CUSTOMER, ORDERS, line], "n_nationkey % 4 = 0")
    ids = {"nation": "n_nationkey", "customer": "c_custkey", "orders": "o_orderkey", "lineitem": "l_orderkey"}
    return reduce(DataFrame.unionByName, [out[n].groupBy(F.col(c).cast("long").alias("id")).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("entity"), "id", "rows") for n, c in ids.items()])


@query("w10_self_reference", """WITH RECURSIVE gone AS (SELECT c_custkey FROM customer WHERE c_custkey IN (7, 12, 130) UNION SELECT c.c_custkey FROM customer c JOIN gone g ON c.c_custkey // 10 = g.c_custkey AND c.c_custkey >= 10)
    SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM gone)""")
def w10s(spark, d):
    staff = EntitySpec("staff", (Field("id", "bigint"), Field("boss", "bigint", references=("staff", "id"), on_delete=CASCADE)), ("id",))
    people = load(spark, d, "customer").selectExpr("c_custkey as id", "case when c_custkey >= 10 then c_custkey div 10 end as boss")
    return relations.cascade_delete([staff], {"staff": people}, "staff", people.filter("id in (7, 12, 130)"))["staff"].select("id")


@query("j11_update_from", """SELECT o_orderkey, CASE WHEN c_acctbal < 0 THEN c_mktsegment ELSE o_orderpriority END AS o_orderpriority, CASE WHEN c_acctbal < 0 THEN o_totalprice + c_nationkey ELSE o_totalprice END AS o_totalprice, coalesce(c_acctbal < 0, false) AS changed
    FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON c_custkey = o_custkey""")
def j11(spark, d):
    o, c = load(spark, d, "orders"), load(spark, d, "customer").filter("c_custkey % 3 <> 0")
    set_ = {"o_orderpriority": F.col("source.c_mktsegment"), "o_totalprice": F.col("current.o_totalprice") + F.col("source.c_nationkey")}
    out, changed = writes.update_from(o, c, set_, ORDERS, on={"o_custkey": "c_custkey"}, where=F.col("source.c_acctbal") < 0)
    marked = out.join(changed.select("o_orderkey", F.lit(True).alias("_changed")), "o_orderkey", "left")
    return marked.select("o_orderkey", "o_orderpriority", "o_totalprice", F.coalesce("_changed", F.lit(False)).alias("changed"))


@query("w10_set_null", "SELECT c_custkey, CASE WHEN c_nationkey % 4 <> 0 THEN c_nationkey END AS c_nationkey FROM customer")
def w10n(spark, d):
    fields = tuple(Field("c_nationkey", "int", references=("nation", "n_nationkey"), on_delete=SET_NULL) if f.name == "c_nationkey" else f for f in CUSTOMER.fields)
    loose = EntitySpec("customer", fields, CUSTOMER.primary_key)
    return _cascaded(spark, d, [NATION, loose], "n_nationkey % 4 = 0")["customer"].select("c_custkey", "c_nationkey")


@query("w11_procedure", f"""WITH {ACCOUNTS} SELECT id, CASE WHEN score >= 20 THEN 'gold' ELSE plan END AS plan FROM accounts WHERE score > 2
    UNION ALL SELECT 1000000 + c_custkey, CASE WHEN c_custkey >= 20 THEN 'gold' ELSE 'free' END FROM customer WHERE c_custkey < 40 AND c_custkey > 2""")
def w11(spark, d):
    new = load(spark, d, "customer").filter("c_custkey < 40").select((F.col("c_custkey") + 1_000_000).alias("id"), F.col("c_custkey").alias("score"))
    p = Procedure("promote", {"least": "bigint"}, (
        Step("accounts", "insert", rows=lambda tables, i: new),
        Step("accounts", "update", where=lambda i: F.col("score") >= i["least"], set=lambda i: {"plan": "gold"}),
        Step("accounts", "delete", where=lambda i: F.col("score") <= 2)))
    tables, _ = p.run({"accounts": _accounts(spark, d)}, {"accounts": SMALL}, least=20)
    return tables["accounts"].select("id", "plan")


@query("w11_stored_procedure", f"""WITH {ACCOUNTS} SELECT 'accounts' AS place, id, CASE WHEN score >= 20 THEN 'gold' ELSE plan END AS plan FROM accounts WHERE score > 2
    UNION ALL SELECT 'promoted', id, plan FROM accounts WHERE score >= 20""")
def w11s(spark, d):
    """Two tables in a store: one run that changes both, and one whose last step fails and changes neither."""
    promoted = EntitySpec("promoted", SMALL.fields, SMALL.primary_key)
    kept = TableStore(fresh_path(spark, "store"), (SMALL, promoted))
    kept.publish(spark, {"accounts": _accounts(spark, d)})
    rich = lambda tables, i: tables["accounts"].filter(F.col("score") >= i["least"])
    steps = (
        Step("promoted", "insert", rows=rich),
        Step("accounts", "update", where=lambda i: F.col("score") >= i["least"], set=lambda i: {"plan": "gold"}),
        Step("accounts", "delete", where=lambda i: F.col("score") <= 2))
    kept.run(spark, Procedure("promote", {"least": "bigint"}, steps), least=20)
    torn = (*steps[1:], Step("promoted", "insert", rows=rich))  # keys that are there already
    try:
        kept.run(spark, Procedure("again", {"least": "bigint"}, torn), least=0)
    except writes.KeyConflict:
        kept.recover(spark)
    tables = kept.tables(spark)
    return tables["accounts"].select(F.lit("accounts").alias("place"), "id", "plan").unionByName(tables["promoted"].select(F.lit("promoted").alias("place"), "id", "plan"))


@query("w12_returning", f"WITH {ACCOUNTS}, {ROWS} SELECT id, plan, score FROM accounts WHERE id IN (SELECT id FROM rows) UNION ALL SELECT id, coalesce(plan, 'free'), score FROM rows WHERE id NOT IN (SELECT id FROM accounts)")
def w12(spark, d):
    rows = _rows(spark, d)
    out, _ = writes.insert_ignore(_accounts(spark, d), rows, SMALL)
    return writes.returning(out, rows, SMALL).select("id", "plan", "score")


@query("d1_table_diff", f"""WITH {BEFORE_AFTER_SQL} SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'added' WHEN a.o_orderkey IS NULL THEN 'removed' ELSE 'modified' END AS change
    FROM before b FULL JOIN after a ON a.o_orderkey = b.o_orderkey WHERE b.o_orderkey IS NULL OR a.o_orderkey IS NULL OR a.o_totalprice IS DISTINCT FROM b.o_totalprice""")
def d1(spark, d):
    before, after = before_after(spark, d)
    return changes.table_diff(before, after, ["o_orderkey"])


@query("d2_table_diff_counts", f"""WITH {BEFORE_AFTER_SQL} SELECT 'orders' AS table, (SELECT count(*) FROM after WHERE o_orderkey NOT IN (SELECT o_orderkey FROM before)) AS added,
    (SELECT count(*) FROM before WHERE o_orderkey NOT IN (SELECT o_orderkey FROM after)) AS removed, (SELECT count(*) FROM before b JOIN after a USING (o_orderkey) WHERE a.o_totalprice <> b.o_totalprice) AS modified
    UNION ALL SELECT 'region', (SELECT count(*) FROM region), 0, 0""")
def d2(spark, d):
    before, after = before_after(spark, d)
    n = load(spark, d, "nation")
    return changes.table_diff_counts({"orders": before, "nation": n}, {"orders": after, "nation": n, "region": load(spark, d, "region")}, {"orders": ["o_orderkey"], "nation": ["n_nationkey"]})


_EDITED = "CASE WHEN o_orderkey BETWEEN 40 AND 45 THEN o_totalprice + 1 ELSE o_totalprice END"


@query("d2_from_snapshots", """SELECT 'orders' AS table, (SELECT count(*) FROM orders WHERE o_orderkey BETWEEN 1 AND 30) AS added, (SELECT count(*) FROM orders WHERE o_orderkey BETWEEN 61 AND 64) AS removed,
    (SELECT count(*) FROM orders WHERE o_orderkey BETWEEN 40 AND 45) AS modified""")
def d2s(spark, d):
    """Two snapshots cut alike: only the ranges of keys whose digests differ are read and joined."""
    o, n = load(spark, d, "orders"), load(spark, d, "nation")
    before, after, specs = fresh_path(spark, "before"), fresh_path(spark, "after"), [ORDERS, NATION]
    tables.save_snapshot({"orders": o.filter("o_orderkey NOT BETWEEN 1 AND 30"), "nation": n}, specs, before)
    edited = o.filter("o_orderkey NOT BETWEEN 61 AND 64").withColumn("o_totalprice", F.expr(_EDITED))
    tables.save_snapshot({"orders": edited, "nation": n}, specs, after, like=before)
    return changes.table_diff_counts(*tables.differing(spark, before, after, specs), {"orders": ["o_orderkey"], "nation": ["n_nationkey"]})


@query("d3_column_changes", f"WITH {BEFORE_AFTER_SQL} SELECT b.o_orderkey, 'o_totalprice' AS columns FROM before b JOIN after a USING (o_orderkey) WHERE a.o_totalprice <> b.o_totalprice")
def d3(spark, d):
    before, after = before_after(spark, d)
    return changes.column_changes(before, after, ["o_orderkey"]).select("o_orderkey", F.array_join("columns", ",").alias("columns"))


@query("d4_generate", """SELECT c_custkey, c_nationkey % 5 AS grp, 'customer' AS entity, true AS has_key, true AS in_range, true AS null_share_fits, true AS seeded FROM customer""")
def d4(spark, d):
    """As many rows as the table has, with keys from its least one on: a generated row for each row of the table, and what the values keep to."""
    c = load(spark, d, "customer")
    n, least = c.agg(F.count(F.lit(1)), F.min("c_custkey")).first()
    made = generate(spark, CUSTOMER, n, seed=4, pk_start=least)
    again = generate(spark, CUSTOMER, n, seed=4, pk_start=least).repartition(3)
    nulls = F.avg(sum(F.col(x).isNull().cast("int") for x in ("c_name", "c_nationkey", "c_acctbal", "c_mktsegment")) / 4)
    share = made.agg((nulls.between(0.05, 0.15) | (F.count(F.lit(1)) < 200)).alias("null_share_fits"))
    fits = F.coalesce(F.col("c_nationkey").between(0, 999_999), F.lit(True)) & F.coalesce(F.col("c_acctbal").between(0, 1000), F.lit(True)) & F.coalesce(F.col("c_name").startswith("Name "), F.lit(True))
    mine = made.select(F.col("c_custkey").alias("k"), fits.alias("in_range"), F.xxhash64(*made.columns).alias("h"))
    twice = mine.join(again.select(F.col("c_custkey").alias("k"), F.xxhash64(*made.columns).alias("g")), "k").withColumn("seeded", F.col("h") == F.col("g"))
    found = c.join(twice, c["c_custkey"] == twice["k"], "left").crossJoin(F.broadcast(share))  # one row
    return found.select("c_custkey", (F.col("c_nationkey") % 5).alias("grp"), F.lit("customer").alias("entity"), F.col("k").isNotNull().alias("has_key"), "in_range", "null_share_fits", "seeded")


@query("b1_backfill", "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), concat(lower(c_name), '/', c_nationkey)) AS c_mktsegment FROM customer")
def b1(spark, d):
    c = load(spark, d, "customer").withColumn("c_mktsegment", F.expr("nullif(c_mktsegment, 'BUILDING')"))
    return backfill.backfill(c, CUSTOMER, "c_mktsegment", lambda fn, col: fn("concat", fn("lower", col("c_name")), F.lit("/"), col("c_nationkey"))).select("c_custkey", "c_mktsegment")


@query("b2_backfill_chunk", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' AND c_custkey > 300 AND c_custkey <= (SELECT max(k) FROM (SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey > 300 ORDER BY 1 LIMIT 50)) THEN c_name ELSE nullif(c_mktsegment, 'BUILDING') END AS c_mktsegment FROM customer")
def b2(spark, d):
    c = load(spark, d, "customer").withColumn("c_mktsegment", F.expr("nullif(c_mktsegment, 'BUILDING')"))
    return backfill.backfill_chunk(c, CUSTOMER, "c_mktsegment", lambda fn, col: col("c_name"), last_key=300, size=50)[0].select("c_custkey", "c_mktsegment")


@query("b3_backfill_resumable", "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), c_name) AS c_mktsegment FROM customer")
def b3(spark, d):
    c = load(spark, d, "customer").withColumn("c_mktsegment", F.expr("nullif(c_mktsegment, 'BUILDING')"))
    path, calls = fresh_path(spark, "backfill"), []

    def stop_once(i: int) -> None:
        calls.append(i)
        if len(calls) == 3:
            raise RuntimeError("stopped")

    try:
        backfill.backfill_resumable(c, CUSTOMER, "c_mktsegment", lambda fn, col: col("c_name"), path, 5, stop_once)
    except RuntimeError:
        pass
    return backfill.backfill_resumable(c, CUSTOMER, "c_mktsegment", lambda fn, col: col("c_name"), path, 5).select("c_custkey", "c_mktsegment")


def _plans(spark, d) -> tuple[DataFrame, DataFrame]:
    c, o = load(spark, d, "customer"), load(spark, d, "orders")
    plans = c.select(F.col("c_custkey").alias("plan_hash"), F.col("c_mktsegment").alias("caller"), F.lit("running").alias("status"), F.expr("timestamp '2024-01-01' + make_dt_interval(0, 0, 0, (c_custkey * 7919) % 100003)").alias("started_at"))
    fields = o.select(F.col("o_custkey").alias("plan_hash"), F.lit("orders").alias("entity_id"), F.concat(F.lit("f"), "o_orderkey").alias("field"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("complete").alias("status"))
    return plans, fields


@query("b5_ready_for_not_null", "SELECT c_custkey AS plan_hash FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def b5(spark, d):
    return backfill.ready_for_not_null(*_plans(spark, d)).select("plan_hash")


@query("b6_backfill_status", """WITH p AS (SELECT c_custkey AS plan_hash FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY (c_custkey * 7919) % 100003 DESC, c_custkey DESC LIMIT 1)
    SELECT plan_hash, 'f' || o_orderkey AS field FROM p JOIN orders ON o_custkey = plan_hash""")
def b6(spark, d):
    return backfill.backfill_status(*_plans(spark, d), caller="BUILDING").select("plan_hash", "field")


@query("a1_audit_not_null", "SELECT 'o_orderstatus' AS column, count(*) AS violations FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'o_custkey', 0")
def a1(spark, d):
    return audits.audit_not_null(load(spark, d, "orders").withColumn("o_orderstatus", F.expr("nullif(o_orderstatus, 'F')")), ["o_orderstatus", "o_custkey"])


@query("a2_audit_unique", "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def a2(spark, d):
    return audits.audit_unique(load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("a3_audit_partial_unique", "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL HAVING count(*) > 1")
def a3(spark, d):
    return audits.audit_unique(load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_returnflag = 'R'")


@query("a4_audit_fk", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 9 = 0")
def a4(spark, d):
    return audits.audit_fk(load(spark, d, "orders"), "o_custkey", load(spark, d, "customer").filter("c_custkey % 9 <> 0"), "c_custkey")


@query("a5_audit_check", "SELECT o_orderkey FROM orders WHERE NOT coalesce(nullif(o_orderstatus, 'F') = 'O' OR o_totalprice < 300000, true)")
def a5(spark, d):
    return audits.audit_check(load(spark, d, "orders"), "nullif(o_orderstatus, 'F') = 'O' OR o_totalprice < 300000").select("o_orderkey")


@query("a6_audit_narrowing", "SELECT 'p_name' AS column, count(*) AS rows FROM part WHERE length(p_name) > 9 UNION ALL SELECT 'p_partkey', count(*) FROM part WHERE p_partkey > 32767 UNION ALL SELECT 'p_retailprice', count(*) FROM part WHERE round(p_retailprice, 1) >= 1000")
def a6(spark, d):
    p = load(spark, d, "part")
    one = lambda c, t: audits.audit_narrowing(p, c, t).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(c).alias("column"), "rows")
    return one("p_name", "varchar(9)").unionByName(one("p_partkey", "smallint")).unionByName(one("p_retailprice", "numeric(4,1)"))


@query("a7_audit_pk", "SELECT l_orderkey, l_linenumber, count(*) AS rows, 'repeated' AS reason FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def a7(spark, d):
    return audits.audit_pk(load(spark, d, "lineitem"), LINEITEM)


@query("a8_audit_serial", "SELECT max(o_orderkey) AS max_id, 1000 AS next_id FROM orders HAVING max(o_orderkey) >= 1000")
def a8(spark, d):
    return audits.audit_serial(load(spark, d, "orders"), "o_orderkey", 1000)


@query("a9_audit_all", """SELECT 'customer' AS entity, 'key' AS audit, 'c_custkey' AS target, 0 AS violations UNION ALL SELECT 'customer', 'not null', 'c_custkey', 0 UNION ALL SELECT 'customer', 'reference', 'c_nationkey', (SELECT count(DISTINCT c_nationkey) FROM customer WHERE c_nationkey % 5 = 0)
    UNION ALL SELECT 'lineitem', 'key', 'l_orderkey,l_linenumber', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) UNION ALL SELECT 'lineitem', 'not null', 'l_orderkey', 0 UNION ALL SELECT 'lineitem', 'not null', 'l_linenumber', 0
    UNION ALL SELECT 'nation', 'key', 'n_nationkey', 0 UNION ALL SELECT 'nation', 'not null', 'n_nationkey', 0""")
def a9(spark, d):
    t = {n: load(spark, d, n) for n in ("customer", "lineitem", "nation")}
    t["nation"] = t["nation"].filter("n_nationkey % 5 <> 0")
    return audits.audit_all(t, [CUSTOMER, LINEITEM, NATION])


