"""Joins, relations, aggregates and declared queries (J, G, Q, N2)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import aggregates, reads, relations
from ..plans.named import NamedQuery
from .registry import AS_OF, CUSTOMER, LINEITEM, ORDERS, SOFT_ORDERS, SOFT_ORDERS_SQL, load, query, soft_orders


@query("j1_get", f"SELECT * FROM {SOFT_ORDERS_SQL} WHERE o_orderkey = 77 AND deleted_at IS NULL AND tenant_id = (SELECT o_custkey % 5 FROM orders WHERE o_orderkey = 77)")
def j1(spark, d):
    rows = soft_orders(spark, d)
    tenant = rows.filter("o_orderkey = 77").select("tenant_id").first()["tenant_id"]
    return reads.get(rows, SOFT_ORDERS, {"o_orderkey": 77}, tenant)


@query("j2_batch_get_composite", "SELECT * FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT o_orderkey, 2 FROM orders WHERE o_custkey % 9 = 0)")
def j2(spark, d):
    keys = load(spark, d, "orders").filter("o_custkey % 9 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(2).alias("l_linenumber"))
    return reads.batch_get(load(spark, d, "lineitem"), LINEITEM, keys)


@query("j3_include", """SELECT c_custkey, coalesce(list_aggregate(ks, 'string_agg', ','), '') AS orders FROM (
    SELECT c_custkey, list(o_orderkey::VARCHAR ORDER BY o_orderkey) FILTER (o_orderkey IS NOT NULL) AS ks FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)""")
def j3(spark, d):
    found = relations.include(load(spark, d, "customer"), load(spark, d, "orders"), "c_custkey", "o_custkey", "orders", ["o_orderkey"])
    return found.select("c_custkey", F.array_join(F.transform("orders", lambda o: o["o_orderkey"].cast("string")), ",").alias("orders"))


@query("j3_include_chunks", """SELECT n_nationkey, chunk, coalesce(string_agg(c_custkey::VARCHAR, ',' ORDER BY n), '') AS customers FROM (
    SELECT n_nationkey, c_custkey, n, coalesce((n - 1) // 40, 0) AS chunk FROM nation LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY nation_of ORDER BY c_acctbal, c_custkey) AS n
        FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_nationkey END AS nation_of FROM customer WHERE c_nationkey <> 5)) ON nation_of = n_nationkey) GROUP BY 1, 2""")
def j3c(spark, d):
    """A third of all customers belong to one nation; every array has at most 40 of them."""
    c = load(spark, d, "customer").filter("c_nationkey <> 5").withColumn("c_nationkey", F.expr("case when c_custkey % 3 = 0 then 0 else c_nationkey end"))
    found = relations.include_chunks(load(spark, d, "nation"), c, "n_nationkey", "c_nationkey", "customers", ["c_acctbal", "c_custkey"], ["c_custkey"], 40)
    return found.select("n_nationkey", "chunk", F.array_join(F.transform("customers", lambda x: x["c_custkey"].cast("string")), ",").alias("customers"))


@query("j4_include_many", """SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation""")
def j4(spark, d):
    found = relations.include_many(load(spark, d, "nation"), [
        (load(spark, d, "customer"), "n_nationkey", "c_nationkey", "customers", ["c_custkey"]),
        (load(spark, d, "supplier"), "n_nationkey", "s_nationkey", "suppliers", ["s_suppkey"])])
    return found.select("n_nationkey", F.size("customers").cast("long").alias("customers"), F.size("suppliers").cast("long").alias("suppliers"))


@query("j6_with_counts", "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def j6(spark, d):
    return relations.with_counts(load(spark, d, "customer"), load(spark, d, "orders"), "c_custkey", "o_custkey", "n_orders").select("c_custkey", "n_orders")


@query("j7_presence", """SELECT key, coalesce(l, 0) AS left_rows, coalesce(r, 0) AS right_rows, l IS NOT NULL AS in_left, r IS NOT NULL AS in_right FROM
    (SELECT c_custkey AS key, count(*) AS l FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1) FULL JOIN (SELECT o_custkey AS key, count(*) AS r FROM orders WHERE o_custkey % 4 <> 0 GROUP BY 1) USING (key)""")
def j7(spark, d):
    return relations.presence(load(spark, d, "customer").filter("c_custkey % 3 <> 0"), load(spark, d, "orders").filter("o_custkey % 4 <> 0"), "c_custkey", "o_custkey")


@query("j8_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def j8(spark, d):
    return relations.without(load(spark, d, "customer"), load(spark, d, "orders").filter("o_totalprice > 450000"), "c_custkey", "o_custkey").select("c_custkey")


@query("j9_semi", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def j9(spark, d):
    return relations.having(load(spark, d, "orders"), load(spark, d, "customer").filter("c_mktsegment = 'BUILDING'"), "o_custkey", "c_custkey").select("o_orderkey")


@query("j10_inner_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 1000")
def j10(spark, d):
    q = NamedQuery("owned", "SELECT o_orderkey, c_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE c_acctbal > :least", {"least": "double"}, {"o_orderkey": "bigint", "c_name": "text"}, ("orders", "customer"))
    return q.run(spark, {t: load(spark, d, t) for t in ("orders", "customer")}, least=1000.0)


@query("j12_declared_relation", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def j12(spark, d):
    t = {"orders": load(spark, d, "orders")}
    return relations.related(CUSTOMER, "orders", load(spark, d, "customer"), t, "c_custkey").select("c_custkey", F.size("orders").cast("long").alias("n"))


@query("j13_recent_with_lookup", "SELECT o_orderkey, o_orderdate, c_name FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 200")
def j13(spark, d):
    found = reads.recent_with_lookup(load(spark, d, "orders"), load(spark, d, "customer"), ("o_custkey", "c_custkey"), [("o_orderdate", "desc"), ("o_orderkey", "asc")], 200)
    return found.select("o_orderkey", "o_orderdate", "c_name")


@query("g1_count_rows", "SELECT count(*) AS rows FROM lineitem")
def g1(spark, d):
    return aggregates.count_rows(load(spark, d, "lineitem"))


@query("g2_global_aggregates", "SELECT count(*) AS n, max(o_totalprice) AS most, min(o_orderdate) AS first FROM orders")
def g2(spark, d):
    return load(spark, d, "orders").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("most"), F.min("o_orderdate").alias("first"))


@query("g3_count_by_time", "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS bucket, count(*) AS rows FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1 ORDER BY 1")
def g3(spark, d):
    return aggregates.count_by_time(load(spark, d, "orders"), "o_orderdate", "month", datetime(1996, 1, 1))


@query("g4_sum_by_time", "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS bucket, sum(o_totalprice::DECIMAL(12,2))::DOUBLE AS total FROM orders WHERE o_custkey = 37 GROUP BY 1")
def g4(spark, d):
    rows = load(spark, d, "orders").withColumn("price", F.col("o_totalprice").cast("decimal(12,2)"))
    return aggregates.sum_by_time(rows, "o_orderdate", "month", "price", filters=F.col("o_custkey") == 37).withColumn("total", F.col("total").cast("double"))


@query("g5_array_agg", "SELECT o_custkey, string_agg(o_orderstatus, '' ORDER BY o_orderstatus) AS statuses FROM orders GROUP BY 1")
def g5(spark, d):
    return aggregates.collect_values(load(spark, d, "orders"), ["o_custkey"], "o_orderstatus", "v").select("o_custkey", F.array_join("v", "").alias("statuses"))


@query("g5_array_chunks", """SELECT l_returnflag, chunk, count(*) AS n, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM (
    SELECT *, (row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1) // 700 AS chunk FROM lineitem) GROUP BY 1, 2""")
def g5c(spark, d):
    found = aggregates.collect_chunks(load(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", 700)
    return found.select("l_returnflag", "chunk", F.size("values").cast("long").alias("n"), F.array_min("values").alias("lo"), F.array_max("values").alias("hi"))


@query("g6_status_counts", "SELECT s AS o_orderstatus, (SELECT count(*) FROM orders WHERE o_orderstatus = s) AS rows FROM (SELECT unnest(['F', 'O', 'P', 'X']) AS s)")
def g6(spark, d):
    return aggregates.status_counts(load(spark, d, "orders"), "o_orderstatus", ["F", "O", "P", "X"])


@query("g7_queue_lag", "SELECT epoch(TIMESTAMP '2024-01-20')::BIGINT - floor(epoch(min(ts)))::BIGINT AS lag_seconds FROM events")
def g7(spark, d):
    return aggregates.queue_lag(load(spark, d, "events"), "ts", AS_OF)


@query("g8_latest_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def g8(spark, d):
    return aggregates.latest_per_key(load(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def _named(name, spark_sql, oracle, output, touches, inputs=None):
    @query(name, oracle)
    def run(spark, d):
        q = NamedQuery(name, spark_sql, {k: t for k, (t, _) in (inputs or {}).items()}, output, touches)
        return q.run(spark, {t: load(spark, d, t) for t in touches}, **{k: v for k, (_, v) in (inputs or {}).items()})


def _both(name, sql, output, touches, inputs=None):
    """One text for both engines: tables in braces, inputs as :name."""
    plain = sql
    for t in touches:
        plain = plain.replace("{" + t + "}", t)
    for k, (_, v) in (inputs or {}).items():
        plain = plain.replace(f":{k}", repr(v))
    _named(name, sql, plain, output, touches, inputs)


_both("q1_group_having", "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most FROM {orders} GROUP BY o_custkey HAVING count(*) >= :least", {"o_custkey": "bigint", "n": "bigint", "most": "double"}, ("orders",), {"least": ("int", 12)})
_both("q1_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)", {"l_returnflag": "text", "l_linestatus": "text", "n": "bigint"}, ("lineitem",))
_both("q1_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM {orders}", {"o_orderstatus": "text", "o_orderpriority": "text"}, ("orders",))
_both("q3_union", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}", {"k": "int"}, ("customer", "supplier"))
_both("q3_intersect", "SELECT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'P'", {"k": "bigint"}, ("orders",))
_both("q3_except", "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders}", {"k": "bigint"}, ("customer", "orders"))
_both("q4_cte", "WITH big AS (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) SELECT c_mktsegment, sum(n) AS n FROM big JOIN {customer} ON c_custkey = o_custkey GROUP BY c_mktsegment", {"c_mktsegment": "text", "n": "bigint"}, ("orders", "customer"))
_both("q5_recursive_cte", "WITH RECURSIVE chain(k, depth) AS (SELECT n_nationkey, 0 FROM {nation} WHERE n_nationkey = 0 UNION ALL SELECT n_nationkey, depth + 1 FROM chain JOIN {nation} ON n_nationkey = k + 3) SELECT k, depth FROM chain", {"k": "int", "depth": "int"}, ("nation",))
_both("n2_running_sum", "SELECT o_orderkey, sum(o_custkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM {orders}", {"o_orderkey": "bigint", "running": "bigint", "place": "int"}, ("orders",))
_named("q6_distinct_on", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM {orders}) WHERE n = 1",
       "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey", {"o_custkey": "bigint", "o_orderkey": "bigint"}, ("orders",))
