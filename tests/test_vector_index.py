"""The stored vector index: recall, cells that are not read, appended rows, odd rows, bounded tiles."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from entityframes.operators import vector_index, vectors
from entityframes.queries.registry import EMBEDDINGS
from entityframes.spec import EntitySpec, Field

SPEC = EntitySpec("e", (Field("id", "bigint"), Field("v", "vector(12)")), ("id",))


def clustered(spark, n, groups, dim=12, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim)) * 3
    x = centres[rng.integers(0, groups, n)] + rng.normal(size=(n, dim)) * 0.4
    return spark.createDataFrame(list(zip(range(n), x.tolist(), strict=True)), "id long, v array<double>")


def answers(df, key="id"):
    return {(r["query_id"], r[key]) for r in df.collect()}


def test_clustered_vectors_need_few_cells(spark, tmp_path):
    df = clustered(spark, 6000, 40)
    queries = df.filter("id % 50 = 0")
    index = vector_index.build_index(df, SPEC, "v", 12, str(tmp_path / "i"), rows_per_cell=150)
    assert len(index.centres) == 40 and index.probes <= 8 and index.rows(spark).count() == 6000
    exact = answers(vectors.nearest_batch(df, SPEC, "v", queries, "id", "cosine", 10))
    found = vector_index.search_index(index, queries, "id", "v", 10)
    assert len(exact & answers(found)) >= 0.9 * len(exact)
    joined = found.join(df.withColumnRenamed("id", "query_id").withColumnRenamed("v", "q"), "query_id").join(df, "id")
    for r in joined.limit(50).collect():
        a, b = np.array(r["v"]), np.array(r["q"])
        assert abs(r["distance"] - (1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b))) < 1e-9


def test_cells_that_are_not_probed_are_not_read(spark, tmp_path):
    df = clustered(spark, 3000, 20)
    index = vector_index.build_index(df, SPEC, "v", 12, str(tmp_path / "i"), rows_per_cell=100)
    rows = vector_index.probed_rows(index, spark, [3, 5])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_cell" in plan and "IN (3,5)" in plan
    assert {r["_cell"] for r in rows.select("_cell").distinct().collect()} == {3, 5}
    read = [r["f"] for r in rows.select(F.input_file_name().alias("f")).distinct().collect()]
    assert read and all("_cell=3/" in f or "_cell=5/" in f for f in read)
    found = vector_index.search_index(index, df.filter("id = 7"), "id", "v", 5, probes=2)
    assert found.filter("rank = 1").first()["id"] == 7


def test_cells_grow_with_the_table_in_two_levels(spark, tmp_path):
    df = clustered(spark, 8000, 60, seed=2)
    index = vector_index.build_index(df, SPEC, "v", 12, str(tmp_path / "i"), rows_per_cell=10, most_sample=1500)
    assert 500 < len(index.centres) <= 4 * 256
    queries = df.filter("id % 100 = 0")
    exact = answers(vectors.nearest_batch(df, SPEC, "v", queries, "id", "cosine", 5))
    assert len(exact & answers(vector_index.search_index(index, queries, "id", "v", 5))) >= 0.9 * len(exact)


def test_appended_rows_are_found_and_known_keys_refused(spark, tmp_path):
    df = clustered(spark, 2000, 10)
    path = str(tmp_path / "i")
    vector_index.build_index(df.filter("id < 1500"), SPEC, "v", 12, path, rows_per_cell=100)
    index = vector_index.open_index(spark, path)
    vector_index.append_index(index, df.filter("id >= 1500"), "v")
    assert index.rows(spark).count() == 2000
    queries = df.filter("id % 50 = 0")
    exact = answers(vectors.nearest_batch(df, SPEC, "v", queries, "id", "cosine", 10))
    assert len(exact & answers(vector_index.search_index(index, queries, "id", "v", 10))) >= 0.9 * len(exact)
    for again in (df.filter("id between 1990 and 2500"), df.filter("id = 1").selectExpr("id + 5000 as id", "v").unionByName(df.filter("id = 2").selectExpr("5001L as id", "v"))):
        with pytest.raises(ValueError):
            vector_index.append_index(index, again, "v")
    assert index.rows(spark).count() == 2000


def test_tiles_are_bounded_and_change_nothing(spark, tmp_path, monkeypatch):
    df = clustered(spark, 1200, 3)
    index = vector_index.build_index(df, SPEC, "v", 12, str(tmp_path / "i"), rows_per_cell=600)
    queries = df.filter("id % 20 = 0")
    want = sorted(map(tuple, vector_index.search_index(index, queries, "id", "v", 5, refine=40).collect()))
    monkeypatch.setattr(vector_index, "TILE_ROWS", 100)
    monkeypatch.setattr(vector_index, "TILE_QUERIES", 7)
    seen = spark.sparkContext.accumulator(0)
    real = vector_index._meet

    def checked(index, most):
        run = real(index, most)

        def meet(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            if len(held) > 300 or len(asking) > 60:
                seen.add(1)
            return run(asking, held)

        return meet

    monkeypatch.setattr(vector_index, "_meet", checked)
    assert sorted(map(tuple, vector_index.search_index(index, queries, "id", "v", 5, refine=40).collect())) == want
    assert seen.value == 0


def test_odd_rows(spark, tmp_path):
    unit = [1.0] + [0.0] * 11
    rows = [(1, unit), (2, [0.0] * 12), (3, [1.0]), (4, None), (5, [float("nan")] + [1.0] * 11), (6, [None] + [1.0] * 11), (7, [float("inf")] + [0.0] * 11)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    index = vector_index.build_index(df, SPEC, "v", 12, str(tmp_path / "i"))
    found = vector_index.search_index(index, df.filter("id < 5"), "id", "v", 5).collect()
    assert sorted((r["query_id"], r["id"], r["distance"], r["rank"]) for r in found) == [(1, 1, 0.0, 1), (2, 1, 1.0, 1)]
    empty = vector_index.build_index(df.limit(0), SPEC, "v", 12, str(tmp_path / "j"))
    assert vector_index.search_index(empty, df, "id", "v", 5).count() == 0
    again = vector_index.build_index(df, SPEC, "v", 12, str(tmp_path / "j"))
    assert again.rows(spark).count() == 1


def test_given_vectors(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    queries = e.filter("vec_id % 50 = 0")
    index = vector_index.build_index(e, EMBEDDINGS, "embedding", 64, str(tmp_path / "i"))
    exact = answers(vectors.nearest_batch(e, EMBEDDINGS, "embedding", queries, "vec_id", "cosine", 10), "vec_id")
    assert len(exact & answers(vector_index.search_index(index, queries, "vec_id", "embedding", 10), "vec_id")) >= 0.9 * len(exact)


def test_recall_holds_as_the_table_grows(spark, tmp_path):
    """Vectors without clusters in many cells: what the codes of a tile lose does not add up over the table."""
    x = np.random.default_rng(5).normal(size=(24_000, 32))
    spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "v": x.tolist()}), "id long, v array<double>").write.parquet(str(tmp_path / "e"))
    df = spark.read.parquet(str(tmp_path / "e"))
    queries = df.filter("id % 200 = 0")
    index = vector_index.build_index(df, SPEC, "v", 32, str(tmp_path / "i"))
    exact = answers(vectors.nearest_batch(df, SPEC, "v", queries, "id", "cosine", 10))
    for refine in (3, 10):
        assert len(exact & answers(vector_index.search_index(index, queries, "id", "v", 10, refine=refine))) >= 0.9 * len(exact)


def test_copies_leave_room_for_others_and_go_by_key(spark, tmp_path):
    """A thousand copies of a vector that lies near the query's two nearest rows."""
    rng = np.random.default_rng(7)
    rows = [(k, [1.0, 0.1] + [0.0] * 10) for k in range(1000, 2000)] + [(k, [1.0, 0.001 * (k - 5000)] + [0.0] * 10) for k in (5000, 5001)]
    rows += [(k, v.tolist()) for k, v in zip(range(6000, 6400), rng.normal(size=(400, 12)), strict=True)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    index = vector_index.build_index(df, SPEC, "v", 12, str(tmp_path / "i"), rows_per_cell=2000)
    found = vector_index.search_index(index, df.filter("id = 5000"), "id", "v", 5, refine=2).orderBy("rank").collect()
    assert [r["id"] for r in found] == [5000, 5001, 1000, 1001, 1002]
