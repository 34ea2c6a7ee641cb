"""Vector search (V)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vector_index, vectors
from ..storage import fresh_path
from .registry import EMBEDDINGS, load, query

_QUERY = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
_SQL = {
    "cosine": "list_cosine_distance(embedding::DOUBLE[], q::DOUBLE[])",
    "l2": "list_distance(embedding::DOUBLE[], q::DOUBLE[])",
    "inner": "-list_inner_product(embedding::DOUBLE[], q::DOUBLE[])",
}


def _first(spark, d):
    return list(load(spark, d, "embeddings").filter("vec_id = 0").first()["embedding"])


def _metric(name, metric):
    @query(name, f"SELECT vec_id, round({_SQL[metric]}, 6) + 0.0 AS distance FROM (SELECT vec_id, embedding, {_QUERY} AS q FROM embeddings)")
    def run(spark, d):
        q = F.array(*[F.lit(float(x)) for x in _first(spark, d)])
        return load(spark, d, "embeddings").select("vec_id", (F.round(vectors.distance(F.col("embedding"), q, metric), 6) + 0.0).alias("distance"))


_metric("v1_cosine", "cosine")
_metric("v2_l2", "l2")
_metric("v3_inner_product", "inner")


@query("v4_nearest", f"SELECT vec_id, label FROM (SELECT vec_id, label, {_SQL['cosine']} AS d FROM (SELECT *, {_QUERY} AS q FROM embeddings)) ORDER BY d, vec_id LIMIT 20")
def v4(spark, d):
    return vectors.nearest(load(spark, d, "embeddings"), EMBEDDINGS, "embedding", _first(spark, d), "cosine", 20).select("vec_id", "label")


@query("v5_nearest_batch", f"""SELECT query_id, vec_id, rank FROM (
    SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY {_SQL['l2']}, vec_id) AS rank
    FROM (SELECT a.vec_id AS query_id, a.embedding AS q, b.vec_id, b.embedding FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)) WHERE rank <= 10""")
def v5(spark, d):
    e = load(spark, d, "embeddings")
    return vectors.nearest_batch(e, EMBEDDINGS, "embedding", e.filter("vec_id % 50 = 0"), "vec_id", "l2", 10).select("query_id", "vec_id", "rank")


@query("v6_nearest_approx", f"""WITH pairs AS (SELECT query_id, vec_id, {_SQL['cosine']} AS d FROM (SELECT a.vec_id AS query_id, a.embedding AS q, b.vec_id, b.embedding FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)),
    ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM pairs)
    SELECT query_id, true AS recall_is_high, true AS distances_are_right, count(*) AS found FROM ranked WHERE rank <= 20 GROUP BY query_id""")
def v6(spark, d):
    """The answers of the index beside the exact ones: the share found over all queries, and their distances."""
    e = load(spark, d, "embeddings")
    queries = e.filter("vec_id % 50 = 0")
    late = F.col("vec_id") % 7 == 3  # these are appended
    index = vector_index.build_index(e.filter(~late), EMBEDDINGS, "embedding", 64, fresh_path(spark, "vector-index"))
    vector_index.append_index(index, e.filter(late), "embedding")
    found = vector_index.search_index(index, queries, "vec_id", "embedding", 20)
    exact = vectors.nearest_batch(e, EMBEDDINGS, "embedding", queries, "vec_id", "cosine", 20).select("query_id", "vec_id", F.lit(1).alias("hit"))
    mine = found.join(queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id").join(e.select("vec_id", "embedding"), "vec_id")
    mine = mine.join(exact, ["query_id", "vec_id"], "left").withColumn("right", F.abs(F.col("distance") - vectors.distance(F.col("embedding"), F.col("q"), "cosine")) < 1e-6)
    by_query = mine.groupBy("query_id").agg(F.count("hit").alias("hits"), F.bool_and("right").alias("distances_are_right"), F.count(F.lit(1)).alias("found"))
    share = by_query.agg((F.sum("hits") / F.sum("found") >= 0.9).alias("recall_is_high"))  # one row
    return by_query.crossJoin(F.broadcast(share)).select("query_id", "recall_is_high", "distances_are_right", "found")


@query("v7_audit_dimension", "SELECT vec_id FROM embeddings WHERE len(embedding) <> 64")
def v7(spark, d):
    return vectors.audit_dimension(load(spark, d, "embeddings"), "embedding", 64).select("vec_id")
