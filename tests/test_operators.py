"""Errors, edge cases and invariances of the table operators."""

import random
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from entityframes.functions import scalar
from entityframes.operators import aggregates, audits, backfill, catalog, changes, queues, reads, relations, vectors, writes
from entityframes.plans.named import NamedQuery, Procedure, Step
from entityframes.sources import generate, series, tables
from entityframes.spec import CASCADE, RESTRICT, EntitySpec, Field, SpecError, field_type, signature
from entityframes.streaming import streams

USER = EntitySpec("user", (Field("id", "bigint"), Field("email", "varchar(12)", unique=True), Field("plan", "text", default="free"), Field("deleted_at", "timestamptz")), ("id",), soft_delete="deleted_at")
AT = datetime(2024, 1, 1)


def users(spark, rows):
    return spark.createDataFrame(rows, "id long, email string, plan string, deleted_at timestamp")


@pytest.fixture
def some(spark):
    return users(spark, [(1, "a", "x", None), (2, "b", None, AT), (3, None, "y", None)])


# --- specifications


def test_types_and_rules():
    assert field_type("numeric(10,2)").spark.simpleString() == "decimal(10,2)" and field_type("vector(3)").dim == 3 and field_type("int[]").kind == "array"
    for bad in ("map", "numeric(40,2)", "vector(0)", "vector(16001)", "vector(3)[]", "varchar(0)"):
        with pytest.raises(SpecError):
            field_type(bad)
    f = (Field("id", "bigint", nullable=False), Field("at", "date"))
    for more in ({"soft_delete": "at"}, {"tenant": "at"}, {"time": "at"}, {"ttl": "nope"}):
        with pytest.raises(SpecError):
            EntitySpec("e", f, ("id",), **more)
    with pytest.raises(SpecError):
        EntitySpec("e", (*f, Field("id", "int")), ("id",))
    assert signature([USER]) != signature([EntitySpec("user", USER.fields, ("id",))])


# --- reads


def test_null_order(spark):
    df = spark.createDataFrame([(1, "row1"), (2, None), (3, "row3")], "id long, title string")
    got = lambda *key: [r["id"] for r in reads.order(df, [("title", *key)]).collect()]
    assert got("asc") == [1, 3, 2] and got("asc", "first") == [2, 1, 3] and got("desc") == [2, 3, 1] and got("desc", "last") == [3, 1, 2]


def test_pages_cover_everything_once(spark):
    df = spark.range(57).select(F.col("id"), (F.col("id") % 5).alias("k"))
    spec = EntitySpec("r", (Field("id", "bigint"), Field("k", "bigint")), ("id",))
    seen, cursor = [], None
    while True:
        rows, cursor = reads.page_with_cursor(df, spec, [("k", "desc")], cursor, 10)
        seen += [r["id"] for r in rows]
        if cursor is None:
            break
    assert seen == sorted(range(57), key=lambda i: (-(i % 5), i))
    with pytest.raises(SpecError):
        reads.page(df, spec, [("k", "desc")], [None, 3])
    assert reads.clamp(0) == 100 and reads.clamp(9999) == 1000


def test_numbering_is_the_same_for_any_partitioning(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("id"))
    for n in (1, 8):
        got = reads.numbered(df.repartition(n), [F.col("id").asc()], "n")
        assert got.filter("n <> id").count() == 0 and got.count() == 500


def test_get(some):
    assert reads.get(some, USER, {"id": 1}).count() == 1 and reads.get(some, USER, {"id": 2}).count() == 0
    with pytest.raises(SpecError):
        reads.get(some, USER, {"email": "a"})
    assert reads.sample_rows(some, USER, 0).count() == 0


# --- relations


def test_include_and_one(spark):
    parents = spark.createDataFrame([(1,), (2,), (None,)], "id long")
    children = spark.createDataFrame([(10, 1), (11, 1), (12, None)], "cid long, parent long")
    out = {r["id"]: [c["cid"] for c in r["kids"]] for r in relations.include(parents, children, "id", "parent", "kids").collect()}
    assert out == {1: [10, 11], 2: [], None: []}
    top = relations.include(parents, children, "id", "parent", "kids", max_children=1, order=F.col("cid").desc()).filter("id = 1").first()
    assert [c["cid"] for c in top["kids"]] == [11]
    with pytest.raises(Exception, match="more than one"):
        relations.include_one(parents, children, "id", "parent", "kid").collect()
    assert relations.include_one(parents, children.filter("cid > 10"), "id", "parent", "kid").filter("kid.cid = 11").count() == 1


def test_restrict_refuses_and_cascade_wins(spark):
    a = EntitySpec("a", (Field("id", "bigint"),), ("id",))
    b = lambda action: EntitySpec("b", (Field("id", "bigint"), Field("a_id", "bigint", references=("a", "id"), on_delete=action)), ("id",))
    t = {"a": spark.createDataFrame([(1,), (2,)], "id long"), "b": spark.createDataFrame([(5, 1), (6, None)], "id long, a_id long")}
    with pytest.raises(relations.RestrictError):
        relations.cascade_delete([a, b(RESTRICT)], t, "a", t["a"].filter("id = 1"))
    assert relations.cascade_delete([a, b(RESTRICT)], t, "a", t["a"].filter("id = 2"))["a"].count() == 1
    out = relations.cascade_delete([a, b(CASCADE)], t, "a", t["a"].filter("id = 1"))
    assert [r["id"] for r in out["b"].collect()] == [6]
    loop = EntitySpec("c", (Field("id", "bigint"), Field("up", "bigint", references=("c", "id"), on_delete=CASCADE)), ("id",))
    rows = spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, None), (5, 4), (6, 6)], "id long, up long")  # a circle of three
    kept = lambda where, **more: {r["id"] for r in relations.cascade_delete([loop], {"c": rows}, "c", rows.filter(where), **more)["c"].collect()}
    assert kept("id = 2") == {4, 5, 6} and kept("id = 4") == {1, 2, 3, 6} and kept("id = 6") == {1, 2, 3, 4, 5}
    with pytest.raises(SpecError):
        kept("id = 2", most_levels=2)


@pytest.mark.parametrize("direction", ["asc", "desc"])
@pytest.mark.parametrize("nulls", ["first", "last"])
def test_pages_over_nulls_are_complete(spark, direction, nulls):
    spec = EntitySpec("t", (Field("id", "bigint"), Field("k", "bigint")), ("id",))
    df = spark.createDataFrame([(i, None if i % 3 == 0 else i % 4) for i in range(23)], "id long, k long")
    keys, cursor, seen = [("k", direction, nulls)], None, []
    for _ in range(9):
        rows, cursor = reads.page_with_cursor(df, spec, keys, cursor, 4)
        seen += [r["id"] for r in rows]
        if cursor is None:
            break
    assert seen == [r["id"] for r in reads.order(df, reads.with_tiebreak(spec, keys)).collect()]
    with pytest.raises(SpecError):
        reads.page_with_cursor(df, spec, [("k", "desc")], None, 4)  # the nulls come first, and have no place


def test_update_from_needs_one_partner(spark):
    spec = EntitySpec("t", (Field("id", "bigint"), Field("v", "bigint"), Field("at", "timestamptz")), ("id",), touch="at")
    t = spark.createDataFrame([(1, 5, None), (2, 6, None), (3, None, None)], "id long, v long, at timestamp")
    rows = spark.createDataFrame([(1, 10), (3, 30), (9, 90), (None, 1), (None, 2)], "id long, n long")
    out, changed = writes.update_from(t, rows, {"v": F.coalesce("current.v", F.lit(0)) + F.col("source.n")}, spec, as_of=datetime(2024, 1, 1))
    assert {(r["id"], r["v"], r["at"] is not None) for r in out.collect()} == {(1, 15, True), (2, 6, False), (3, 30, True)}
    assert {(r["id"], r["op"]) for r in changed.collect()} == {(1, "update"), (3, "update")}
    with pytest.raises(writes.KeyConflict):
        writes.update_from(t, rows.unionByName(rows.limit(1)), {"v": F.col("source.n")}, spec)


@pytest.mark.parametrize(
    ("a", "b", "equal"),
    [("a > 0", "(A>0)", True), ("((a > 0) and (b > 0))", "(a>0) AND (b>0)", True), ("s = 'F'", "s = 'f'", False), ("(a or b) and c", "a or (b and c)", False),
     ("s = 'a b'", "s = 'ab'", False), ('"A" > 0', '"a" > 0', False), ("(s = ')')", "s=')'", True), ("(a) or (b)", "a) or (b", False), ("a b", "ab", False)],
)
def test_check_drift_never_takes_different_checks_for_equal(spark, a, b, equal):
    one = lambda x: spark.createDataFrame([("e", x)], "entity string, expression string")
    assert catalog.check_drift(one(a), one(b)).count() == (0 if equal else 2)


def test_lineage_counts_the_last_removal(spark):
    at = lambda n: datetime(2024, 1, n)
    log = [(1, "a", at(1), "e", "x", "add"), (2, "b", at(2), "e", None, "remove"), (3, "c", at(3), "e", "x", "add"), (4, "d", at(4), "e", "y", "add"),
           (5, "b", at(5), "e", None, "remove"), (6, "b", at(6), "e", "y", "change"), (7, "b", at(7), "e", "z", "add"), (8, "a", at(8), "e", "z", "remove"), (9, "a", at(9), "g", None, "remove"), (10, "a", at(10), "g", "x", "add")]
    out = {(r["entity"], r["field"]): (r["introduced_by"], r["last_modified_by"], r["removed_at"]) for r in catalog.lineage(spark.createDataFrame(log, "seq long, caller string, at timestamp, entity string, field string, op string")).collect()}
    assert out == {("e", "x"): ("a", "c", at(5)), ("e", "y"): ("d", "b", None), ("e", "z"): ("b", "b", at(8)), ("g", "x"): ("a", "a", None)}


# --- writes


def test_insert_errors(spark, some):
    for rows in ([(1, "z", None, None)], [(7, "z", None, None), (7, "y", None, None)], [(None, "z", None, None)]):
        with pytest.raises(writes.KeyConflict):
            writes.insert(some, users(spark, rows), USER)
    out, changed = writes.insert(some, users(spark, [(7, "z", None, None)]), USER)
    assert out.filter("id = 7 and plan = 'free'").count() == 1 and changed.collect()[0]["op"] == "insert"


def test_upsert_and_updates(spark, some):
    with pytest.raises(SpecError):
        writes.upsert(some, some, USER, {"id": F.lit(1)})
    with pytest.raises(writes.KeyConflict):
        writes.upsert(some, some.unionByName(some), USER)
    out, changed = writes.update(some, F.col("plan") == "x", {"plan": None}, USER)
    assert changed.count() == 1 and out.filter("plan is null").count() == 2 and out.count() == 3
    kept, gone = writes.delete(some, F.col("plan") == "x", USER)
    assert kept.count() == 2 and gone.count() == 1  # a null condition keeps the row
    _, marked = writes.soft_delete(some, F.lit(True), USER, AT)
    assert sorted(r["id"] for r in marked.collect()) == [1, 3]


def test_serials(spark):
    spec = EntitySpec("s", (Field("id", "bigint", serial=True), Field("v", "text")), ("id",))
    rows = spark.createDataFrame([(None, "b"), (None, "a"), (20, "c")], "id long, v string")
    table = spark.createDataFrame([(5, "x")], "id long, v string")
    assert {r["v"]: r["id"] for r in writes.with_serials(rows, table, spec, ["v"]).collect()} == {"c": 20, "a": 21, "b": 22}


def test_procedure_is_all_or_nothing(spark, some):
    steps = (Step("user", "delete", where=lambda i: F.col("id") == 1), Step("user", "insert", rows=lambda t, i: users(spark, [(3, "q", None, None)])))
    t = {"user": some}
    with pytest.raises(writes.KeyConflict):
        Procedure("p", {}, steps).run(t, {"user": USER})
    assert t["user"].count() == 3
    with pytest.raises(SpecError):
        Procedure("p", {"x": "int"}, ()).run(t, {"user": USER})


# --- changes


def test_diff_nulls_are_equal(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "id long, v string")
    b = spark.createDataFrame([(1, None), (2, None), (4, "y")], "id long, v string")
    assert {r["id"]: r["change"] for r in changes.table_diff(a, b, ["id"]).collect()} == {2: "modified", 3: "removed", 4: "added"}
    spec = EntitySpec("t", (Field("id", "bigint"), Field("v", "text")), ("id",))
    assert changes.change_events(a, a, spec, 1).count() == 0
    with pytest.raises(SpecError):
        changes.tag_keys(a, "t:{nope}")


# --- queues


def test_backoff_and_limits(spark):
    rows = [(1, 0, None, AT), (2, 3, datetime(2024, 1, 1, 0, 0, 0), AT), (3, 60, datetime(2024, 1, 1, 0, 0, 0), AT)]
    q = spark.createDataFrame(rows, "id long, attempts int, last_error_at timestamp, enqueued_at timestamp")
    got = lambda s: [r["id"] for r in queues.eligible(q, datetime(2024, 1, 1, s // 3600, s // 60 % 60, s % 60)).collect()]
    assert got(0) == [1] and got(1) == [1, 2] and got(3600) == [1, 2] and got(3601) == [1, 2, 3]
    with pytest.raises(SpecError):
        queues.purge_settled(q, AT, 59)


# --- named queries and functions


def test_named_query_rules(spark, some):
    q = lambda sql, **k: NamedQuery("q", sql, touches=("user",), **k)
    t = {"user": some, "other": some}
    assert q("SELECT id FROM {user} WHERE id = :k", inputs={"k": "bigint"}, output={"id": "bigint"}).run(spark, t, k=3).count() == 1
    for bad in (q("DELETE FROM {user}"), q("SELECT * FROM {other}"), q("SELECT id FROM {user}", output={"id": "text"}), q("SELECT id FROM {user}", output=USER)):
        with pytest.raises(SpecError):
            bad.run(spark, t)
    with pytest.raises(Exception, match="other"):
        q("SELECT * FROM other").run(spark, t)
    some.createOrReplaceTempView("elsewhere")
    try:
        for text in ("SELECT * FROM elsewhere", "SELECT * FROM parquet.`/root/testdata/sf0.001/region.parquet`", "SELECT id FROM {user} WHERE id IN (SELECT id FROM elsewhere)",
                     "WITH elsewhere AS (SELECT * FROM elsewhere) SELECT * FROM elsewhere", "SELECT (SELECT max(id) FROM elsewhere) AS id FROM {user}",
                     "SELECT u.id FROM {user} u, LATERAL (SELECT e.id AS other FROM elsewhere e WHERE e.id = u.id)"):
            with pytest.raises(SpecError, match="does not declare"):
                q(text).run(spark, t)
        fine = q("WITH elsewhere AS (SELECT id FROM {user} WHERE EXISTS (SELECT 1 FROM {user})) SELECT id FROM elsewhere UNION ALL VALUES (9L) UNION ALL SELECT id FROM range(2)")
        assert fine.run(spark, t).count() == 6
        assert NamedQuery("one", "SELECT 1 AS id").run(spark, {}).count() == 1
    finally:
        spark.catalog.dropTempView("elsewhere")
    assert not [v.name for v in spark.catalog.listTables() if v.name.startswith("q_")]
    assert q("SELECT * FROM {user}", output=USER).run(spark, t).count() == 3


def test_function_list_is_closed(some):
    with pytest.raises(SpecError):
        scalar.call("random")
    for bad in (lambda: scalar.left(F.lit("a"), -1), lambda: scalar.substring(F.lit("a"), 0), lambda: scalar.to_char(F.lit(AT), "Mon")):
        with pytest.raises(SpecError):
            bad()
    with pytest.raises(SpecError):
        backfill.backfill(some, USER, "plan", lambda fn, col: col("plan"))
    with pytest.raises(SpecError):
        backfill.backfill(some, USER, "plan", lambda fn, col: fn("now"))


def test_chunks_fill_in_key_order(some):
    last, filled, table = None, [], some.withColumn("plan", F.lit(None).cast("string"))
    while True:
        table, last, n = backfill.backfill_chunk(table, USER, "plan", lambda fn, col: col("email"), last, 2)
        if not n:
            break
        filled.append(n)
    assert filled == [2, 1] and table.filter("plan <=> email").count() == 3


def test_ranges_are_read_once_and_go_on(spark, some, tmp_path):
    table, path, calls = some.withColumn("plan", F.lit(None).cast("string")), f"{tmp_path}/fill", []

    def stop_once(i):
        calls.append(i)
        if len(calls) == 2:
            raise RuntimeError("stopped")

    fill = lambda df, hook=None: backfill.backfill_resumable(df, USER, "plan", lambda fn, col: col("email"), path, 3, hook)
    with pytest.raises(RuntimeError):
        fill(table, stop_once)
    assert (tmp_path / "fill" / "input").exists()
    out = fill(table.limit(0), calls.append)  # the rows are those of the first call
    assert out.count() == out.filter("plan <=> email").count() == 3 and calls.count(calls[0]) == 1
    assert not (tmp_path / "fill" / "input").exists()
    (tmp_path / "fill" / "rows" / "_temporary").mkdir(exist_ok=True)
    assert fill(table).count() == 3  # a call after the last one changes nothing
    empty = backfill.backfill_resumable(table.limit(0), USER, "plan", lambda fn, col: col("email"), f"{tmp_path}/none", 3)
    assert empty.count() == 0 and empty.columns == table.columns


def test_a_killed_backfill_goes_on_where_its_ranges_end(spark, tmp_path):
    """Many ranges, one job a call: a row that fails takes its own ranges with it, not those whose tasks had ended."""
    spec = EntitySpec("t", (Field("id", "bigint"), Field("v", "text"), Field("w", "text")), ("id",))
    broken = tmp_path / "broken"
    broken.touch()
    table = spark.range(3000).selectExpr("id", "if(id % 3 = 0, null, 'kept') as v", "concat('w', id) as w").repartitionByRange(12, "id")

    @F.udf("string")
    def slow(w):
        if broken.exists() and w == "w2500":
            time.sleep(6)
            raise RuntimeError("killed")
        return w

    def fill():
        return backfill.backfill_resumable(table, spec, "v", lambda fn, col: slow(col("w")), str(tmp_path / "fill"), 40)

    with pytest.raises(Exception, match="killed"):
        fill()
    notes = {r["chunk"]: r["status"] for r in spark.read.parquet(str(tmp_path / "fill" / "progress")).collect()}
    done = {c for c, s in notes.items() if s == backfill.DONE and c >= 0}
    assert len(notes) == 41 and 5 < len(done) < 40
    kept = {p: p.stat().st_mtime_ns for c in done for p in (tmp_path / "fill" / "rows" / f"_chunk={c}").glob("*.parquet")}
    broken.unlink()
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("backfill", "")
    out = fill()
    assert len(jobs.getJobIdsForGroup("backfill")) < 20  # not one for each of forty ranges
    assert all(p.stat().st_mtime_ns == t for p, t in kept.items())
    assert {(r["id"], r["v"]) for r in out.collect()} == {(k, "kept" if k % 3 else f"w{k}") for k in range(3000)} and out.count() == 3000


# --- audits and catalogues


def test_audits(spark, some):
    assert audits.audit_unique(some, ["email"]).count() == 0
    assert audits.audit_check(some, "plan = 'x'").count() == 1
    long = users(spark, [(1, "x" * 13, "p", None), (1, "x" * 13, "p", None)])
    found = {(r["audit"], r["target"]): r["violations"] for r in audits.audit_all({"user": long}, [USER]).collect()}
    assert found == {("not null", "id"): 0, ("length", "email"): 2, ("key", "id"): 1, ("unique", "email"): 1}
    numbers = spark.createDataFrame([(99.94,), (99.96,), (None,)], "v double")
    assert audits.audit_narrowing(numbers, "v", "numeric(3,1)").count() == 1


def test_catalogue_of_specs(spark):
    old = catalog.catalogue(spark, [USER])
    wider = EntitySpec("user", (*(Field("email", "varchar(20)", unique=True) if f.name == "email" else f for f in USER.fields), Field("tags", "text[]"), Field("need", "int", nullable=False)), ("id",))
    got = {(r["kind"], r["field"]): r["class"] for r in catalog.schema_diff(old, catalog.catalogue(spark, [wider])).collect()}
    assert got == {("change_type", "email"): "additive", ("add_field", "tags"): "additive", ("add_field", "need"): "backfill"}
    gone = catalog.schema_diff(old, old.limit(0)).collect()
    assert [(r["kind"], r["class"], r["field"]) for r in gone] == [("remove_entity", "breaking", None)]


def test_hot_groups_are_cut_into_bounded_arrays(spark):
    """A tenth of all children and a mass of equal ones belong to one parent; no task of the numbering holds them all."""
    rows = spark.range(20_000).selectExpr("id", "if(id % 10 = 0, 7, id % 400 + 100) as parent", "if(id % 20 = 0, 1, id) as v").unionByName(spark.range(5).selectExpr("id + 50000 as id", "cast(null as bigint) as parent", "id as v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        numbered = aggregates.numbered(rows, ["parent"], ["v"], "n")
        got = numbered.collect()
        ranged = rows.repartitionByRange("parent", "v", "id").withColumn("p", F.spark_partition_id()).filter("parent = 7").groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(ranged) > 2 and max(r["count"] for r in ranged) < 1000
    by = {}
    for r in got:
        by.setdefault(r["parent"], []).append((r["n"], r["v"]))
    assert len(got) == 20_005 and len(by[None]) == 5
    for held in by.values():
        held.sort()
        assert [n for n, _ in held] == list(range(1, len(held) + 1)) and [v for _, v in held] == sorted(v for _, v in held)
    chunks = aggregates.collect_chunks(rows, ["parent"], "v", 300).filter("parent = 7").orderBy("chunk").collect()
    assert [len(r["values"]) for r in chunks] == [300] * 6 + [200] and [x for r in chunks for x in r["values"]] == [v for _, v in by[7]]
    parents = spark.createDataFrame([(7, "hot"), (101, "cool"), (5, "none")], "id long, name string")
    found = relations.include_chunks(parents, rows, "id", "parent", "kids", ["v", "id"], ["id"], 300).collect()
    assert sorted((r["id"], r["chunk"], len(r["kids"])) for r in found) == [(5, 0, 0), *((7, k, 300) for k in range(6)), (7, 6, 200), (101, 0, 50)]
    kids = [x["id"] for r in sorted((r for r in found if r["id"] == 7), key=lambda r: r["chunk"]) for x in r["kids"]]
    assert kids == [i for _, i in sorted((1 if i % 20 == 0 else i, i) for i in range(0, 20_000, 10))]


def test_ranges_grow_with_the_table_and_not_their_rows(spark, monkeypatch):
    """More rows make more ranges and tasks, not larger ones, whatever Spark's own number of partitions is."""
    monkeypatch.setattr(aggregates, "RANGE_ROWS", 500)
    monkeypatch.setattr(aggregates, "LEAST_ROWS", 100)
    rows = spark.range(9000).selectExpr("if(id % 3 = 0, null, id % 3) as g", "(id * 37) % 1000 as v")
    assert aggregates.ranges_of(rows) == 18 and aggregates.ranges_of(rows.limit(250)) == 3 and aggregates.ranges_of(rows.limit(0)) == 1
    for df in (aggregates.numbered(rows, ["g"], ["v"], "n"), aggregates.collect_chunks(rows, ["g"], "v", 70)):
        assert df.rdd.getNumPartitions() == 18
    got = {(r["g"], r["chunk"]): r["values"] for r in aggregates.collect_chunks(rows, ["g"], "v", 70).collect()}
    for g in (None, 1, 2):
        want = sorted((k * 37) % 1000 for k in range(9000) if (k % 3 or None) == g)
        assert [x for c in range(43) for x in got[g, c]] == want


# --- series, snapshots, generation, vectors


def test_only_differing_ranges_of_snapshots_are_read(spark, tmp_path):
    spec = EntitySpec("t", (Field("id", "bigint"), Field("v", "text"), Field("w", "int")), ("id",))
    named = EntitySpec("n", (Field("code", "text"), Field("v", "text")), ("code",))
    rows = spark.range(1000).selectExpr("id", "concat('v', id % 7) as v", "cast(nullif(id % 5, 0) as int) as w")
    words = spark.range(200).selectExpr("concat('k', id) as code", "'x' as v")
    before, after = str(tmp_path / "b"), str(tmp_path / "a")
    tables.save_snapshot({"t": rows, "n": words}, [spec, named], before, ranges=20)
    moved = rows.withColumn("v", F.expr("if(id = 333, 'other', v)")).withColumn("w", F.expr("if(id = 335, null, w)")).filter("id <> 700").unionByName(spark.sql("select 5000L as id, 'new' as v, 1 as w"))
    tables.save_snapshot({"t": moved, "n": words.filter("code <> 'k7'")}, [spec, named], after, like=before)
    b, a = tables.differing(spark, before, after, [spec, named])
    keys = {"t": ["id"], "n": ["code"]}
    for name, whole_before, whole_after in (("t", rows, moved), ("n", words, words.filter("code <> 'k7'"))):
        want = sorted(map(tuple, changes.table_diff(whole_before, whole_after, keys[name]).collect()))
        assert sorted(map(tuple, changes.table_diff(b[name], a[name], keys[name]).collect())) == want and want
    plan = b["t"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_range" in plan
    read = {f["f"].partition("_range=")[2].partition("/")[0] for f in b["t"].select(F.input_file_name().alias("f")).collect()}
    assert read == {"6", "14"} and b["t"].count() == 100 and b["n"].count() < 40
    b, a = tables.differing(spark, before, before, [spec, named])
    assert b["t"].count() == a["n"].count() == 0
    other = str(tmp_path / "o")
    tables.save_snapshot({"t": rows, "n": words}, [spec, named], other, ranges=3)
    b, a = tables.differing(spark, before, other, [spec, named])
    assert b["t"].count() == 1000 and changes.table_diff(b["t"], a["t"], ["id"]).count() == 0  # cut otherwise: whole, and still equal


def test_snapshot_refuses_other_schemas(spark, some, tmp_path):
    path = f"{tmp_path}/s"
    tables.save_snapshot({"user": some}, [USER], path)
    with pytest.raises(tables.SnapshotError):
        tables.load_snapshot(spark, path, [EntitySpec("user", USER.fields, ("id",))])
    assert tables.load_snapshot(spark, path, [USER])["user"].count() == 3


def test_range_read_opens_its_chunks_only(spark, tmp_path):
    df = spark.range(240).select("id", F.timestamp_seconds(F.col("id") * 3600).alias("at"))
    series.write_chunked(df, "at", "1 day", f"{tmp_path}/c")
    out = series.read_range(spark, f"{tmp_path}/c", "at", "1 day", datetime(1970, 1, 3, 5), datetime(1970, 1, 4, 2))
    assert sorted(r["id"] for r in out.collect()) == list(range(53, 74))
    assert len({f for f in out.inputFiles()}) <= 3 * 4 and "PartitionFilters: [isnotnull(chunk" in out._jdf.queryExecution().executedPlan().toString()


def test_generation_is_repeatable(spark):
    spec = EntitySpec("g", (Field("id", "bigint"), Field("email", "varchar(30)"), Field("price", "numeric(6,2)"), Field("v", "vector(5)"), Field("doc", "jsonb"), Field("on", "boolean", nullable=False), Field("at", "timestamptz"), Field("ids", "int[]"), Field("raw", "bytea")), ("id",))
    a, b = (generate.generate(spark, spec, 300, seed=2).repartition(n).orderBy("id").collect() for n in (1, 7))
    assert a == b and a != generate.generate(spark, spec, 300, seed=3).orderBy("id").collect()
    nulls = sum(r["email"] is None for r in a)
    assert 10 < nulls < 60 and all(r["on"] is not None for r in a) and all(r["v"] is None or len(r["v"]) == 5 for r in a)


def test_distances(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None)], "id long, v array<float>")
    spec = EntitySpec("e", (Field("id", "bigint"), Field("v", "vector(2)")), ("id",))
    out = vectors.nearest(df, spec, "v", [1.0, 0.0], "cosine", 9).collect()
    assert [(r["id"], r["distance"]) for r in out] == [(1, 0.0), (2, 1.0)]
    assert [r["id"] for r in vectors.audit_dimension(df, "v", 2).collect()] == [3]
    pairs = vectors.nearest_batch(df, spec, "v", df, "id", "cosine", 9, block=2).collect()
    assert sorted((r["query_id"], r["id"], r["distance"]) for r in pairs) == [(1, 1, 0.0), (1, 2, 1.0), (2, 1, 1.0), (2, 2, 1.0), (3, 3, 0.0)]
    assert vectors.nearest_batch(df, spec, "v", df.limit(0), "id", "l2", 2).count() == 0
    with pytest.raises(ValueError):
        vectors.distance(F.col("v"), F.col("v"), "hamming")


def test_every_dimension_is_answered(spark):
    """More dimensions than any list of them would hold."""
    df = spark.createDataFrame([(k, [1.0] * k) for k in range(1, 1202)], "id long, v array<float>")
    spec = EntitySpec("e", (Field("id", "bigint"), Field("v", "vector(2)")), ("id",))
    found = vectors.nearest_batch(df, spec, "v", df.filter("id > 1100"), "id", "l2", 3, block=80)
    assert {(r["query_id"], r["id"]) for r in found.collect()} == {(k, k) for k in range(1101, 1202)}


# --- streams


def test_debounce_keeps_by_the_last_kept(spark):
    df = spark.createDataFrame([(k, "e", datetime(2024, 1, 1, 0, 0, s)) for k, s in enumerate([0, 4, 8, 12, 12, 25])], "id long, e string, at timestamp")
    assert sorted(r["id"] for r in streams.debounce(df, "e", "at", 10_000, "id").collect()) == [0, 3, 5]
    assert streams.debounce(df, "e", "at", 0, "id").count() == 6


def test_debounce_over_blocks_equals_the_sequential_rule(spark):
    rng = random.Random(6)
    rows, n = [], 0
    for entity in ("a", "b", None):
        t = 0
        for _ in range(400):
            t += rng.choice([0, 1, 2, 5, 30, 400])
            rows.append((n, entity, t))
            n += 1
    df = spark.createDataFrame(rows, "id long, e string, t long").withColumn("at", F.timestamp_millis("t"))
    want = set()
    for entity in ("a", "b", None):
        last = None
        for i, _, t in (r for r in rows if r[1] == entity):
            if last is None or t - last >= 10:
                want.add(i)
                last = t
    for blocks in (1, 3, 64):
        assert {r["id"] for r in streams.debounce(df, "e", "at", 10, "id", blocks).collect()} == want


def test_replayed_batches_change_nothing(spark):
    target = spark.createDataFrame([("e", "1", 5)], "entity string, row_id string, new_version long")
    events = spark.createDataFrame([("e", "1", 3), ("e", "1", 9), ("e", "2", 1)], target.schema)
    once = streams.merge_versions(target, events)
    twice = streams.merge_versions(once, events)
    assert sorted(once.collect()) == sorted(twice.collect()) == [("e", "1", 9), ("e", "2", 1)]


def test_observed_counts(spark):
    rows, seen = streams.counted(spark.range(7).toDF("id"), "n")
    rows.collect()
    assert seen.get["processed"] == 7
