"""Filter trees: errors, empty parts, nulls, and random trees against DuckDB."""

import random
from datetime import datetime
from decimal import Decimal

import duckdb
import pytest

from entityframes.operators import filters
from entityframes.spec import EntitySpec, Field, SpecError

SPEC = EntitySpec("t", (Field("id", "bigint"), Field("s", "text"), Field("n", "int"), Field("b", "boolean"), Field("at", "timestamptz"), Field("raw", "bytea"), Field("m", "numeric(12,2)"), Field("c", "citext"), Field("v", "vector(3)")), ("id",))
ROWS = [
    (1, "a%b", 5, True, datetime(2024, 1, 1), b"x", Decimal("9.00"), "Abc", None),
    (2, "axb", None, False, None, b"", Decimal("10.00"), "ABC", None),
    (3, None, 7, None, datetime(2024, 1, 3), None, None, "d", None),
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "id long, s string, n int, b boolean, at timestamp, raw binary, m decimal(12,2), c string, v array<float>")


def ids(out):
    return sorted(r["id"] for r in out.collect())


@pytest.mark.parametrize(("tree", "want"), [
    ({}, [1, 2, 3]), (None, [1, 2, 3]), ({"s": {"prefix": "a%"}}, [1]), ({"s": {"contains": "%"}}, [1]), ({"s": {"ilike": "A%"}}, [1]), ({"s": {"in": []}}, [1, 2, 3]), ({"s": {"neq": "axb"}}, [1]),
    ({"s": {"is_null": True}}, [3]), ({"s": {"is_null": False}}, [1, 2, 3]), ({"not": {"n": {"eq": 5}}}, [3]), ({"not": {}}, [1, 2, 3]), ({"or": []}, [1, 2, 3]), ({"or": [{"n": {"eq": 5}}, {}]}, [1]),
    ({"b": {"eq": False}}, [2]), ({"raw": {"eq": b"x"}}, [1]), ({"raw": {"in": [b"", b"x"]}}, [1, 2]), ({"m": {"gt": "9"}}, [2]), ({"m": {"in": ["9", "10.00"]}}, [1, 2]), ({"c": {"eq": "abc"}}, [1, 2]),
    ({"at": {"between": (datetime(2024, 1, 1), datetime(2024, 1, 2))}}, [1]), ({"n": {"gt": 4}, "or": [{"s": {"eq": "a%b"}}, {"id": {"eq": 2}}]}, [1]), ({"and": [{"and": [{"and": [{"id": {"lt": 3}}]}]}]}, [1, 2]),
])
def test_arms(df, tree, want):
    assert ids(filters.where(df, SPEC, tree)) == want


@pytest.mark.parametrize("tree", [
    {"nope": {"eq": 1}}, {"s": {"like": "x"}}, {"n": {"prefix": "x"}}, {"n": {"between": (3, 2)}}, {"at": {"between": (datetime(2024, 2, 1), datetime(2024, 1, 1))}}, {"n": {"in": list(range(201))}},
    {"s": {"eq": "x" * 1025}}, {"n": {"eq": None}}, {"v": {"eq": 1}}, {"raw": {"not_in": [b"x"]}}, {"m": {"between": (1, 2)}},
])
def test_errors_before_any_work(df, tree):
    with pytest.raises(SpecError):
        filters.where(df, SPEC, tree)


def test_depth(df):
    tree: dict = {"n": {"eq": 1}}
    for _ in range(9):
        tree = {"not": tree}
    assert filters.condition(SPEC, tree) is not None
    with pytest.raises(SpecError):
        filters.condition(SPEC, {"not": tree})


def test_find_keeps_nulls(df):
    assert ids(filters.find(df, SPEC, [("n", "!=", 5)])) == [2, 3]
    assert ids(filters.find(df, SPEC, [("n", "is not null", None), ("n", ">=", 5)])) == [1, 3]
    with pytest.raises(SpecError):
        filters.find(df, SPEC, [("n", "~", 5)])


def test_scope_needs_a_tenant(df):
    spec = EntitySpec("t", (Field("id", "bigint", nullable=False), Field("at", "timestamptz")), ("id",), soft_delete="at", tenant="id")
    assert ids(filters.scoped(df, spec, 2)) == [2] and ids(filters.scoped(df, spec, 1)) == []
    with pytest.raises(SpecError):
        filters.scoped(df, spec)


def test_filter_reaches_the_scan(spark, sf):
    from entityframes.queries.registry import ORDERS

    plan = filters.where(spark.read.parquet(f"{sf}/orders.parquet"), ORDERS, {"o_orderkey": {"lt": 100}, "o_orderstatus": {"in": ["F"]}}).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(o_orderkey,100)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan


def random_tree(rng, depth):
    """(tree, SQL of it)."""
    trees, sqls = {}, []
    for name, values in rng.sample([("o_orderstatus", ["F", "O", "P"]), ("o_custkey", [3, 40, 90]), ("o_orderpriority", ["1-URGENT", "5-LOW"])], rng.randrange(0, 3)):
        arm = rng.choice(["eq", "neq", "in", "not_in", *(["gt", "lte"] if name == "o_custkey" else ["prefix"])])
        v = rng.sample(values, 2) if arm in ("in", "not_in") else rng.choice(values)
        q = lambda x: repr(x)
        op = {"eq": "=", "neq": "<>", "gt": ">", "lte": "<="}
        trees[name] = {arm: v}
        sqls.append(f"{name} {'NOT ' if arm == 'not_in' else ''}IN ({', '.join(map(q, v))})" if isinstance(v, list) else f"starts_with({name}, {q(v)})" if arm == "prefix" else f"{name} {op[arm]} {q(v)}")
    if depth:
        for kind in rng.sample(["and", "or", "not"], rng.randrange(0, 3)):
            inner = [random_tree(rng, depth - 1) for _ in range(1 if kind == "not" else rng.randrange(0, 3))]
            texts = [s for _, s in inner if s]
            trees[kind] = inner[0][0] if kind == "not" else [t for t, _ in inner]
            if texts:
                sqls.append(f"NOT ({texts[0]})" if kind == "not" else "(" + f" {kind.upper()} ".join(texts) + ")")
    return trees, " AND ".join(f"({s})" for s in sqls)


def test_random_trees(spark, sf):
    from entityframes.queries.registry import ORDERS

    rng, db = random.Random(8), duckdb.connect()
    df = spark.read.parquet(f"{sf}/orders.parquet").cache()
    for _ in range(25):
        tree, sql = random_tree(rng, 3)
        got = sorted(r["o_orderkey"] for r in filters.where(df, ORDERS, tree).select("o_orderkey").collect())
        assert got == [r[0] for r in db.execute(f"select o_orderkey from '{sf}/orders.parquet' where {sql or 'true'} order by 1").fetchall()], tree
