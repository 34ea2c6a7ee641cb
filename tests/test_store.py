"""Stored tables: a procedure changes all of them or none."""

import pytest
from pyspark.sql import functions as F

from entityframes.operators import writes
from entityframes.plans.named import Procedure, Step
from entityframes.plans.store import ConflictError, TableStore
from entityframes.spec import EntitySpec, Field, SpecError

SPECS = tuple(EntitySpec(n, (Field("id", "bigint"), Field("v", "text")), ("id",)) for n in ("a", "b", "c"))


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id long, v string")


@pytest.fixture
def store(spark, tmp_path):
    kept = TableStore(f"file://{tmp_path}", SPECS)
    kept.publish(spark, {"a": rows(spark, (1, "x"), (2, "y")), "b": rows(spark, (1, "q"))})
    return kept


def held(spark, store, generation=None):
    return {n: sorted(map(tuple, df.collect())) for n, df in store.tables(spark, generation).items()}


FIRST = {"a": [(1, "x"), (2, "y")], "b": [(1, "q")], "c": []}
MOVE = (Step("b", "insert", rows=lambda t, i: t["a"].filter("id = 2")), Step("a", "delete", where=lambda i: F.col("id") == 2))


def test_all_tables_change_together(spark, store):
    reader = store.tables(spark)["a"]
    assert [tuple(r) for r in store.run(spark, Procedure("move", {}, MOVE)).collect()] == [("a", "delete", 1), ("b", "insert", 1)]
    assert held(spark, store) == {"a": [(1, "x")], "b": [(1, "q"), (2, "y")], "c": []}
    assert store.generation(spark) == 2 and held(spark, store, 1) == FIRST
    assert reader.count() == 2  # a plan goes on reading what it began with


def boom(tables, inputs):
    raise RuntimeError("third step")


def late_failure(tables, inputs):
    """A step whose plan is fine and whose rows fail when they are written."""
    return tables["c"].unionByName(tables["a"].select("id", F.raise_error("row").cast("string").alias("v"))), tables["c"].select("*", F.lit("insert").alias("op"))


@pytest.mark.parametrize(("step", "error"), [
    (Step("c", "call", call=boom), RuntimeError), (Step("c", "call", call=late_failure), Exception),
    (Step("b", "insert", rows=lambda t, i: t["b"].filter("id = 1")), writes.KeyConflict), (Step("c", "other"), SpecError),
])
def test_a_failing_third_step_changes_nothing(spark, store, tmp_path, step, error):
    with pytest.raises(error):
        store.run(spark, Procedure("torn", {}, (*MOVE, step)))
    assert held(spark, store) == FIRST and store.generation(spark) == 1
    store.recover(spark)
    assert len(list((tmp_path / "tables").glob("*/*"))) == 2 and store.recover(spark) == []
    store.run(spark, Procedure("move", {}, MOVE))
    assert held(spark, store)["b"] == [(1, "q"), (2, "y")]


def test_tables_staged_but_not_published_are_not_there(spark, store, tmp_path):
    store._stage({"a": rows(spark, (9, "torn"))}, 2)  # what a run leaves that ends before its rename
    (tmp_path / "drafts" / "torn").write_text("{")
    assert held(spark, store) == FIRST
    assert [g.split("-")[0] for g in store.recover(spark)] == ["drafts/torn", "tables/a/g=2"]
    assert held(spark, store) == FIRST


def test_two_writers_of_one_generation_conflict(spark, store):
    store.publish(spark, {"c": rows(spark, (1, "first"))}, since=1)
    with pytest.raises(ConflictError):
        store.publish(spark, {"c": rows(spark, (1, "second"))}, since=1)
    assert held(spark, store)["c"] == [(1, "first")]
    with pytest.raises(SpecError):
        store.publish(spark, {"d": rows(spark, (1, "x"))})


def test_recover_keeps_what_it_is_told(spark, store):
    for k in range(3):
        store.publish(spark, {"c": rows(spark, (k, "v"))})
    store.recover(spark, keep=2)
    assert held(spark, store, 3)["c"] == [(1, "v")] and held(spark, store, 4)["a"] == FIRST["a"]
    with pytest.raises(Exception):  # noqa: B017
        held(spark, store, 1)
