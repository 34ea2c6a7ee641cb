"""Scalar functions (C), one query a group."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..spec import key_text
from .registry import AS_OF, LINEITEM, load, query


def _c(name, table, key, column, sql, names=("value",)):
    columns = column if isinstance(column, tuple) else (column,)
    sqls = sql if isinstance(sql, tuple) else (sql,)
    named = list(zip(names, columns, sqls, strict=True))

    @query(name, f"SELECT {key}, " + ", ".join(f"{s} AS {n}" for n, _, s in named) + f" FROM {table}")
    def run(spark, d):
        return load(spark, d, table).select(*key.split(", "), *[c().alias(n) for n, c, _ in named])


two = ("a", "b")
three = ("a", "b", "c")
_c("c1_coalesce_nullif", "orders", "o_orderkey", (lambda: scalar.call("coalesce", scalar.call("nullif", F.col("o_orderstatus"), F.lit("F")), F.lit("none")), lambda: scalar.call("nullif", F.col("o_custkey"), F.lit(37))), ("coalesce(nullif(o_orderstatus, 'F'), 'none')", "nullif(o_custkey, 37)"), two)
_c("c2_lower_upper", "part", "p_partkey", (lambda: scalar.call("lower", F.col("p_type")), lambda: scalar.call("upper", F.col("p_name"))), ("lower(p_type)", "upper(p_name)"), two)
_c("c3_length", "documents", "doc_id", (lambda: scalar.call("length", F.col("text")).cast("long"), lambda: scalar.call("char_length", F.col("source")).cast("long")), ("length(text)", "length(source)"), two)
_c("c4_trim", "part", "p_partkey", (lambda: scalar.call("trim", F.concat(F.lit("  "), "p_name", F.lit(" "))), lambda: scalar.call("ltrim", F.concat(F.lit("  "), "p_name", F.lit(" "))), lambda: scalar.call("rtrim", F.concat(F.lit(" "), "p_name", F.lit("  ")))), ("trim('  ' || p_name || ' ')", "ltrim('  ' || p_name || ' ')", "rtrim(' ' || p_name || '  ')"), three)
_c("c5_abs", "customer", "c_custkey", lambda: scalar.call("abs", F.col("c_acctbal") - 500), "abs(c_acctbal - 500)")
_c("c6_concat_skips_null", "orders", "o_orderkey", (lambda: scalar.call("concat", F.expr("nullif(o_orderstatus, 'F')"), F.lit("-"), F.col("o_orderpriority")), lambda: scalar.call("concat_ws", "/", F.expr("nullif(o_orderstatus, 'F')"), F.col("o_orderpriority"))), ("concat(nullif(o_orderstatus, 'F'), '-', o_orderpriority)", "concat_ws('/', nullif(o_orderstatus, 'F'), o_orderpriority)"), two)
_c("c7_substring", "customer", "c_custkey", (lambda: scalar.call("substring", F.col("c_name"), 10, 4), lambda: scalar.call("substr", F.col("c_name"), 12)), ("substring(c_name, 10, 4)", "substr(c_name, 12)"), two)
_c("c8_replace", "part", "p_partkey", lambda: scalar.call("replace", F.col("p_name"), F.lit("ring"), F.lit("nut")), "replace(p_name, 'ring', 'nut')")
_c("c9_left_right", "part", "p_partkey", (lambda: scalar.call("left", F.col("p_name"), 3), lambda: scalar.call("right", F.col("p_name"), 4)), ("left(p_name, 3)", "right(p_name, 4)"), two)
_c("c10_to_char", "events", "event_id", lambda: scalar.call("to_char", F.col("ts"), "YYYY-MM-DD HH24:MI:SS"), "strftime(ts, '%Y-%m-%d %H:%M:%S')")
_c("c11_operators", "orders", "o_orderkey", (lambda: F.expr("o_orderstatus || o_orderpriority"), lambda: F.expr("case when o_orderpriority rlike '^[12]' then cast(o_custkey as string) else 'x' end"), lambda: scalar.is_distinct(F.expr("nullif(o_orderstatus, 'F')"), F.lit("O"))), ("o_orderstatus || o_orderpriority", "CASE WHEN regexp_matches(o_orderpriority, '^[12]') THEN o_custkey::VARCHAR ELSE 'x' END", "nullif(o_orderstatus, 'F') IS DISTINCT FROM 'O'"), three)
_c("c12_now", "events", "event_id", lambda: (F.unix_timestamp(scalar.now(AS_OF)) - F.unix_timestamp("ts")), "(epoch(TIMESTAMP '2024-01-20')::BIGINT - floor(epoch(ts))::BIGINT)")
_c("c13_date_trunc", "events", "event_id", (lambda: F.date_trunc("hour", "ts"), lambda: F.date_trunc("day", "ts")), ("date_trunc('hour', ts)::TIMESTAMP", "date_trunc('day', ts)::TIMESTAMP"), two)
_c("c14_c15_json", "events", "event_id", (lambda: scalar.json_text(F.concat(F.lit('{"a": '), "props", F.lit(', "t": true, "n": null}')), "a", "k"), lambda: scalar.json_text(F.concat(F.lit('{"a": '), "props", F.lit(', "t": true, "n": null}')), "t"), lambda: scalar.json_text(F.concat(F.lit('{"a": '), "props", F.lit(', "t": true, "n": null}')), "n")), ("""('{"a": ' || props || ', "t": true, "n": null}')::JSON->'a'->>'k'""", """('{"a": ' || props || ', "t": true, "n": null}')::JSON->>'t'""", """('{"a": ' || props || ', "t": true, "n": null}')::JSON->>'n'"""), three)
_c("c16_citext", "part", "p_partkey", lambda: scalar.ci_equal(F.col("p_type"), "economy"), "lower(p_type) = 'economy'")
_c("c17_key_text", "lineitem", "l_orderkey, l_linenumber", lambda: key_text(LINEITEM, "|"), "concat_ws('|', l_orderkey, l_linenumber)")
