"""The table of queries, the specifications of the test tables, and helpers to read them."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import CASCADE, EntitySpec, Field

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

AS_OF = datetime(2024, 1, 20)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return register


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; times without a zone are UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])


def _spec(name: str, key: str, fields: str, **more) -> EntitySpec:
    made, refs = [], more.pop("refs", {})
    for part in fields.split(","):
        n, t = part.split()
        entity = refs.get(n)
        made.append(Field(n, t, nullable=n not in key.split("+") and n != more.get("tenant"), references=entity[:2] if entity else None, on_delete=entity[2] if entity else "no action"))
    return EntitySpec(name, tuple(made), tuple(key.split("+")), **more)


REGION = _spec("region", "r_regionkey", "r_regionkey int,r_name text")
NATION = _spec("nation", "n_nationkey", "n_nationkey int,n_name text,n_regionkey int", refs={"n_regionkey": ("region", "r_regionkey", CASCADE)})
CUSTOMER = _spec("customer", "c_custkey", "c_custkey bigint,c_name text,c_nationkey int,c_acctbal double,c_mktsegment text", refs={"c_nationkey": ("nation", "n_nationkey", CASCADE)}, relations={"orders": ("orders", "o_custkey", True)})
ORDERS = _spec("orders", "o_orderkey", "o_orderkey bigint,o_custkey bigint,o_orderstatus text,o_totalprice double,o_orderdate timestamptz,o_orderpriority text", refs={"o_custkey": ("customer", "c_custkey", CASCADE)}, time="o_orderdate")
PART = _spec("part", "p_partkey", "p_partkey bigint,p_name text,p_brand text,p_type text,p_size int,p_retailprice double")
LINEITEM = _spec("lineitem", "l_orderkey+l_linenumber", "l_orderkey bigint,l_partkey bigint,l_suppkey bigint,l_linenumber int,l_quantity double,l_extendedprice double,l_discount double,l_tax double,l_returnflag text,l_linestatus text,l_shipdate timestamptz", refs={"l_orderkey": ("orders", "o_orderkey", CASCADE)})
EVENTS = _spec("events", "event_id", "event_id bigint,ts timestamptz,user_id bigint,event_type text,value double,props jsonb", time="ts", ttl="ts", chunk="1 day")
EMBEDDINGS = _spec("embeddings", "vec_id", "vec_id bigint,embedding vector(64),label int")
SOFT_ORDERS = _spec("orders", "o_orderkey", "o_orderkey bigint,o_custkey bigint,o_orderstatus text,o_totalprice double,o_orderdate timestamptz,o_orderpriority text,deleted_at timestamptz,tenant_id bigint", soft_delete="deleted_at", tenant="tenant_id", touch=None)


def soft_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a deletion time on every tenth and a tenant."""
    return load(spark, sf_dir, "orders").withColumns({"deleted_at": F.expr("case when o_orderkey % 10 = 0 then o_orderdate end"), "tenant_id": F.expr("o_custkey % 5")})


SOFT_ORDERS_SQL = "(SELECT *, CASE WHEN o_orderkey % 10 = 0 THEN o_orderdate END AS deleted_at, o_custkey % 5 AS tenant_id FROM orders)"


def before_after(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = load(spark, sf_dir, "orders")
    after = o.filter("o_orderkey % 11 <> 0").withColumn("o_totalprice", F.expr("case when o_orderkey % 13 = 0 then o_totalprice + 1 else o_totalprice end"))
    return o.filter("o_orderkey % 7 <> 0"), after


BEFORE_AFTER_SQL = """before AS (SELECT * FROM orders WHERE o_orderkey % 7 <> 0),
    after AS (SELECT * REPLACE (CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice) FROM orders WHERE o_orderkey % 11 <> 0)"""


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as entries of a queue."""
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("job_name"), F.expr("cast(event_id % 6 as int)").alias("attempts"), F.expr("cast(event_id % 4 as int)").alias("max_retries"),
        F.expr("case when event_id % 2 = 0 then ts end").alias("last_error_at"), F.col("ts").alias("enqueued_at"), F.expr("ts + interval 1 hour").alias("scheduled_for"),
        F.expr("case event_id % 3 when 0 then 'pending' when 1 then 'running' else 'done' end").alias("status"), F.expr("case when event_id % 5 <> 0 then ts + interval 2 hours end").alias("claimed_until"))


QUEUE_SQL = """(SELECT event_id AS id, event_type AS job_name, (event_id % 6)::INT AS attempts, (event_id % 4)::INT AS max_retries, CASE WHEN event_id % 2 = 0 THEN ts END AS last_error_at,
    ts AS enqueued_at, ts + INTERVAL 1 HOUR AS scheduled_for, CASE event_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' ELSE 'done' END AS status,
    CASE WHEN event_id % 5 <> 0 THEN ts + INTERVAL 2 HOUR END AS claimed_until FROM events)"""
