"""Scans, projections, filters, order and paging (S, P, F, O, N, T)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import filters, reads
from ..sources import series, tables
from ..spec import EntitySpec, Field
from ..storage import fresh_path
from .registry import AS_OF, CUSTOMER, EVENTS, LINEITEM, ORDERS, PART, SOFT_ORDERS, SOFT_ORDERS_SQL, load, query, soft_orders

KEYS = "SELECT o_orderkey FROM orders WHERE "


@query("flagship", """SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders
    WHERE o_orderstatus IN ('F', 'O') AND o_totalprice >= 100000 AND NOT starts_with(o_orderpriority, '5') ORDER BY o_orderdate DESC, o_orderkey LIMIT 100 OFFSET 100""")
def flagship(spark, d):
    tree = {"o_orderstatus": {"in": ["F", "O"]}, "o_totalprice": {"gte": 100000.0}, "not": {"o_orderpriority": {"prefix": "5"}}}
    rows = filters.where(tables.scan(spark, ORDERS, f"{d}/orders.parquet"), ORDERS, tree)
    names = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"]
    return reads.project(reads.order(rows, reads.with_tiebreak(ORDERS, [("o_orderdate", "desc")])).offset(100).limit(100), ORDERS, names)


@query("s1_scan", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def s1(spark, d):
    return tables.scan(spark, ORDERS, f"{d}/orders.parquet")


@query("s2_s3_snapshot_round_trip", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def s2(spark, d):
    path = fresh_path(spark, "snapshot")
    tables.save_snapshot({"part": load(spark, d, "part")}, [PART], path)
    return tables.load_snapshot(spark, path, [PART])["part"]


@query("s4_read_changes_since", "SELECT * FROM (SELECT * FROM events WHERE event_id > 500 ORDER BY event_id DESC LIMIT 200) ORDER BY event_id")
def s4(spark, d):
    return tables.read_changes_since(load(spark, d, "events"), 500, 200, "event_id")


@query("s5_t3_chunked_range", "SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts < TIMESTAMP '2024-01-09 18:00:00'")
def s5(spark, d):
    path = fresh_path(spark, "chunks")
    series.write_chunked(load(spark, d, "events"), "ts", "1 day", path)
    return series.read_range(spark, path, "ts", "1 day", datetime(2024, 1, 5, 6), datetime(2024, 1, 9, 18))


@query("s7_describe", """SELECT f.field, (SELECT count(*) FROM orders) AS rows FROM (SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS field) f""")
def s7(spark, d):
    return tables.describe(load(spark, d, "orders"), ORDERS).select("field", "rows")


@query("s8_sample_rows", "SELECT * FROM customer ORDER BY c_custkey LIMIT 50")
def s8(spark, d):
    return reads.sample_rows(load(spark, d, "customer"), CUSTOMER, 50)


@query("p1_project", "SELECT c_custkey, c_name FROM customer")
def p1(spark, d):
    return reads.project(load(spark, d, "customer"), CUSTOMER, ["c_custkey", "c_name"])


@query("p2_star_and_named", "SELECT *, c_custkey AS again FROM customer")
def p2(spark, d):
    return load(spark, d, "customer").select("*", F.col("c_custkey").alias("again"))


@query("p3_expression", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def p3(spark, d):
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr("l_extendedprice * (1 - l_discount)").alias("net"))


def _filter(name, table, spec, key, tree, predicate):
    @query(name, f"SELECT {key} FROM {table} WHERE {predicate}")
    def run(spark, d):
        return filters.where(load(spark, d, table), spec, tree).select(*key.split(", "))


_filter("f1_string_eq_neq", "orders", ORDERS, "o_orderkey", {"o_orderstatus": {"eq": "F"}, "o_orderpriority": {"neq": "1-URGENT"}}, "o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT'")
_filter("f2_string_in", "orders", ORDERS, "o_orderkey", {"o_orderstatus": {"in": ["F", "P"]}, "o_orderpriority": {"not_in": ["5-LOW"]}}, "o_orderstatus IN ('F', 'P') AND o_orderpriority NOT IN ('5-LOW')")
_filter("f2_empty_in_keeps_all", "orders", ORDERS, "o_orderkey", {"o_orderstatus": {"in": []}}, "true")
_filter("f3_prefix", "part", PART, "p_partkey", {"p_name": {"prefix": "small"}}, "starts_with(p_name, 'small')")
_filter("f4_suffix", "part", PART, "p_partkey", {"p_name": {"suffix": "ring"}}, "ends_with(p_name, 'ring')")
_filter("f5_contains", "part", PART, "p_partkey", {"p_brand": {"contains": "#1"}}, "contains(p_brand, '#1')")
_filter("f6_ilike", "part", PART, "p_partkey", {"p_type": {"ilike": "econ"}}, "contains(lower(p_type), 'econ')")
_filter("f8_int_compare", "lineitem", LINEITEM, "l_orderkey, l_linenumber", {"l_linenumber": {"gt": 2, "lte": 5, "neq": 4}}, "l_linenumber > 2 AND l_linenumber <= 5 AND l_linenumber <> 4")
_filter("f9_int_in", "customer", CUSTOMER, "c_custkey", {"c_nationkey": {"in": [1, 2, 3], "not_in": [2]}}, "c_nationkey IN (1, 2, 3) AND c_nationkey NOT IN (2)")
_filter("f10_int_between", "orders", ORDERS, "o_orderkey", {"o_orderkey": {"between": (100, 900)}}, "o_orderkey BETWEEN 100 AND 900")
_filter("f12_timestamp_compare", "orders", ORDERS, "o_orderkey", {"o_orderdate": {"gte": datetime(1997, 1, 1), "lt": datetime(1998, 1, 1)}}, "o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'")
_filter("f13_timestamp_between", "orders", ORDERS, "o_orderkey", {"o_orderdate": {"between": (datetime(1996, 3, 1), datetime(1996, 5, 1))}}, "o_orderdate BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1996-05-01'")
_filter("f16_and", "orders", ORDERS, "o_orderkey", {"and": [{"o_orderstatus": {"eq": "F"}}, {"o_totalprice": {"gt": 200000.0}}, {}]}, "o_orderstatus = 'F' AND o_totalprice > 200000")
_filter("f17_or_beside_siblings", "orders", ORDERS, "o_orderkey", {"o_orderstatus": {"eq": "F"}, "or": [{"o_orderpriority": {"eq": "5-LOW"}}, {"o_totalprice": {"lt": 5000.0}}]}, "o_orderstatus = 'F' AND (o_orderpriority = '5-LOW' OR o_totalprice < 5000)")
_filter("f19_siblings", "customer", CUSTOMER, "c_custkey", {"c_mktsegment": {"eq": "BUILDING"}, "c_acctbal": {"gte": 0.0}, "c_nationkey": {"lt": 12}}, "c_mktsegment = 'BUILDING' AND c_acctbal >= 0 AND c_nationkey < 12")


@query("f14_bytes", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority <> '5-LOW'")
def f14(spark, d):
    spec = EntitySpec("orders", (Field("o_orderkey", "bigint"), Field("status", "bytea"), Field("priority", "bytea")), ("o_orderkey",))
    o = load(spark, d, "orders").selectExpr("o_orderkey", "encode(o_orderstatus, 'utf-8') as status", "encode(o_orderpriority, 'utf-8') as priority")
    return filters.where(o, spec, {"status": {"in": [b"F", b"P"]}, "priority": {"neq": b"5-LOW"}}).select("o_orderkey")


@query("f7_null_arms", "SELECT o_orderkey FROM (SELECT *, nullif(o_orderstatus, 'F') AS s FROM orders) WHERE s IS NULL UNION ALL SELECT -o_orderkey FROM (SELECT *, nullif(o_orderstatus, 'F') AS s FROM orders) WHERE s IS NOT NULL")
def f7(spark, d):
    o = load(spark, d, "orders").withColumn("o_orderstatus", F.expr("nullif(o_orderstatus, 'F')"))
    null = filters.where(o, ORDERS, {"o_orderstatus": {"is_null": True, "is_not_null": False}})
    return null.select("o_orderkey").unionByName(filters.where(o, ORDERS, {"o_orderstatus": {"is_not_null": True}}).select((-F.col("o_orderkey")).alias("o_orderkey")))


@query("f11_bool", "SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
def f11(spark, d):
    from ..spec import EntitySpec, Field

    spec = EntitySpec("flags", (Field("c_custkey", "bigint"), Field("rich", "boolean")), ("c_custkey",))
    return filters.where(load(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") > 5000).alias("rich")), spec, {"rich": {"eq": True}}).select("c_custkey")


@query("f15_numeric", "SELECT c_custkey FROM customer WHERE c_acctbal::DECIMAL(12,2) >= 100.50 AND c_acctbal::DECIMAL(12,2) < 5000")
def f15(spark, d):
    from ..spec import EntitySpec, Field

    spec = EntitySpec("balances", (Field("c_custkey", "bigint"), Field("balance", "numeric(12,2)")), ("c_custkey",))
    rows = load(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("decimal(12,2)").alias("balance"))
    return filters.where(rows, spec, {"balance": {"gte": "100.50", "lt": "5000"}}).select("c_custkey")


@query("f18_not_unknown", "SELECT o_orderkey FROM (SELECT *, nullif(o_orderstatus, 'F') AS s FROM orders) WHERE NOT (s = 'O')")
def f18(spark, d):
    o = load(spark, d, "orders").withColumn("o_orderstatus", F.expr("nullif(o_orderstatus, 'F')"))
    return filters.where(o, ORDERS, {"not": {"o_orderstatus": {"eq": "O"}}}).select("o_orderkey")


@query("f20_f21_scoped", f"SELECT o_orderkey, tenant_id FROM {SOFT_ORDERS_SQL} WHERE deleted_at IS NULL AND tenant_id = 3")
def f20(spark, d):
    return filters.scoped(soft_orders(spark, d), SOFT_ORDERS, tenant=3).select("o_orderkey", "tenant_id")


@query("f22_extra_predicates", KEYS + "(o_orderstatus = 'F' OR o_orderstatus = 'O') AND o_orderkey % 3 = 0")
def f22(spark, d):
    tree = {"or": [{"o_orderstatus": {"eq": "F"}}, {"o_orderstatus": {"eq": "O"}}]}
    return filters.where(load(spark, d, "orders"), ORDERS, tree, extra=[F.expr("o_orderkey % 3 = 0")]).select("o_orderkey")


@query("f23_find", "SELECT o_orderkey FROM (SELECT *, nullif(o_orderstatus, 'F') AS s FROM orders) WHERE (s IS NULL OR s <> 'O') AND o_totalprice < 90000")
def f23(spark, d):
    o = load(spark, d, "orders").withColumn("o_orderstatus", F.expr("nullif(o_orderstatus, 'F')"))
    return filters.find(o, ORDERS, [("o_orderstatus", "!=", "O"), ("o_totalprice", "<", 90000.0)]).select("o_orderkey")


@query("f24_member", KEYS + "o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)")
def f24(spark, d):
    return filters.member(load(spark, d, "orders"), "o_custkey", load(spark, d, "customer").filter("c_nationkey = 7").select("c_custkey")).select("o_orderkey")


@query("f25_free_expression", KEYS + "o_orderpriority LIKE '%URG%' OR (o_totalprice BETWEEN 1000 AND 2000 AND o_orderstatus IS DISTINCT FROM 'F') OR CASE WHEN o_orderkey % 2 = 0 THEN o_custkey < 100 ELSE false END")
def f25(spark, d):
    text = "o_orderpriority LIKE '%URG%' OR (o_totalprice BETWEEN 1000 AND 2000 AND o_orderstatus IS DISTINCT FROM 'F') OR CASE WHEN o_orderkey % 2 = 0 THEN o_custkey < 100 ELSE false END"
    return filters.matching(load(spark, d, "orders"), text).select("o_orderkey")


@query("n1_with_total", "SELECT c_custkey, count(*) OVER () AS total FROM customer WHERE c_nationkey < 5")
def n1(spark, d):
    return reads.with_total(load(spark, d, "customer").filter("c_nationkey < 5").select("c_custkey"))


@query("o1_order_nulls", "SELECT * FROM (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders ORDER BY s ASC NULLS LAST, o_orderkey DESC NULLS FIRST LIMIT 300)")
def o1(spark, d):
    rows = load(spark, d, "orders").select("o_orderkey", F.expr("nullif(o_orderstatus, 'F')").alias("s"))
    return reads.order(rows, [("s", "asc"), ("o_orderkey", "desc")]).limit(300)


@query("o2_order_by_expression", "SELECT event_id FROM events ORDER BY (props->>'k')::INT DESC, event_id LIMIT 100")
def o2(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return reads.order(load(spark, d, "events"), [(k, "desc"), ("event_id", "asc")]).limit(100).select("event_id")


@query("o3_limit_clamp", "(SELECT o_orderkey, 'default' AS rule FROM orders ORDER BY 1 LIMIT 100) UNION ALL (SELECT o_orderkey, 'most' FROM orders ORDER BY 1 LIMIT 1000)")
def o3(spark, d):
    o = load(spark, d, "orders")
    part = lambda limit, rule: reads.page(o, ORDERS, [], None, limit).select("o_orderkey", F.lit(rule).alias("rule"))
    return part(0, "default").unionByName(part(5000, "most"))


@query("o4_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 70 OFFSET 130")
def o4(spark, d):
    return reads.order(load(spark, d, "orders"), [("o_orderkey", "asc")]).offset(130).limit(70).select("o_orderkey")


@query("o5_keyset_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice, o_orderkey) > (100000.0, 17) ORDER BY o_totalprice, o_orderkey LIMIT 100")
def o5(spark, d):
    return reads.page(load(spark, d, "orders"), ORDERS, [("o_totalprice", "asc")], [100000.0, 17]).select("o_orderkey", "o_totalprice")


@query("o6_mixed_directions", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey < 500 OR (o_custkey = 500 AND o_orderkey > 40) ORDER BY o_custkey DESC, o_orderkey LIMIT 100")
def o6(spark, d):
    return reads.page(load(spark, d, "orders"), ORDERS, [("o_custkey", "desc")], [500, 40]).select("o_orderkey", "o_custkey")


@query("o7_o8_next_page", "SELECT l_orderkey, l_linenumber, q FROM (SELECT l_orderkey, l_linenumber, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY ALL) ORDER BY q DESC, l_orderkey, l_linenumber LIMIT 100 OFFSET 100")
def o7(spark, d):
    rows = load(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").cast("long").alias("q"))
    _, cursor = reads.page_with_cursor(rows, LINEITEM, [("q", "desc")], None, 100)
    return reads.page(rows, LINEITEM, [("q", "desc")], cursor, 100)


@query("o10_page_index", """SELECT page, o_orderdate, o_orderkey, rows FROM (
    SELECT (row_number() OVER w - 1) // 500 AS page, o_orderdate, o_orderkey, count(*) OVER (PARTITION BY 1) AS total, row_number() OVER w AS n FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey)) x
    JOIN LATERAL (SELECT least(500, x.total - x.page * 500) AS rows) ON true WHERE n % 500 = 0 OR n = total""")
def o10(spark, d):
    return reads.page_index(load(spark, d, "orders"), ORDERS, [("o_orderdate", "asc")], 500)


@query("o11_history_page", "SELECT o_orderkey FROM orders WHERE o_orderkey < 9000 AND o_custkey = 11 ORDER BY o_orderkey DESC LIMIT 26")
def o11(spark, d):
    return reads.history_page(load(spark, d, "orders"), "o_orderkey", before=9000, caller=("o_custkey", 11), limit=0).select("o_orderkey")


@query("q7_hash_sample", "SELECT o_orderkey FROM orders WHERE ('0x' || substr(md5('3:' || o_orderkey), 1, 12))::BIGINT % 1000000 < 100000")
def q7(spark, d):
    return reads.hash_sample(load(spark, d, "orders"), ORDERS, percent=10, seed=3).select("o_orderkey")


@query("t1_chunk_of", "SELECT event_id, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS chunk FROM events")
def t1(spark, d):
    return load(spark, d, "events").select("event_id", series.chunk_of(F.col("ts"), "6 hours").alias("chunk"))


@query("t2_chunk_stats", "SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS chunk, count(*) AS rows, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1")
def t2(spark, d):
    return series.chunk_stats(load(spark, d, "events"), "ts", "1 day")


@query("t4_get_by_id_and_time", "SELECT * FROM events WHERE event_id = (SELECT min(event_id) FROM events) AND ts = (SELECT min(ts) FROM events)")
def t4(spark, d):
    from ..spec import EntitySpec

    e = load(spark, d, "events")
    spec = EntitySpec("events", EVENTS.fields, ("event_id", "ts"), time="ts")
    first = e.agg(F.min("event_id").alias("i"), F.min("ts").alias("t")).first()
    return reads.get(e, spec, {"event_id": first["i"], "ts": first["t"]})


@query("t5_month_chunk", "SELECT o_orderkey, date_trunc('month', o_orderdate)::TIMESTAMP AS month_start, (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::TIMESTAMP AS month_end FROM orders")
def t5(spark, d):
    return load(spark, d, "orders").withColumn("m", series.month_chunk("o_orderdate")).select("o_orderkey", F.col("m.start").alias("month_start"), F.col("m.end").alias("month_end"))


@query("t6_drop_chunks_before", "SELECT event_id FROM events WHERE time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') + INTERVAL 1 DAY > TIMESTAMP '2024-01-20 00:00:00'")
def t6(spark, d):
    return series.drop_chunks_before(load(spark, d, "events"), "ts", "1 day", AS_OF)[0].select("event_id")
