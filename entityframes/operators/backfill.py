"""Backfill of null fields: in one pass, chunk by chunk, or resumable over key ranges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import scalar
from ..spec import EntitySpec, SpecError
from ..storage import delete
from .aggregates import latest_per_key
from .relations import without

Expression = Callable[[Callable[..., Column], Callable[[str], Column]], Column]
PENDING, DONE, FAILED = "pending", "complete", "failed"


def built(spec: EntitySpec, field: str, expression: Expression) -> Column:
    """The value from ``expression(fn, col)``; it can name the closed list of functions and other existing fields only."""
    spec[field]

    def col(name: str) -> Column:
        if name == field:
            raise SpecError(f"{field} cannot be filled from itself")
        return F.col(spec[name].name)

    return expression(scalar.call, col).cast(spec[field].kind.spark)


def backfill(table: DataFrame, spec: EntitySpec, field: str, expression: Expression) -> DataFrame:
    """Nulls of ``field`` become the expression's value; other values stay. One distributed pass, no shuffle."""
    return table.withColumn(field, F.coalesce(F.col(field), built(spec, field, expression)))


def backfill_chunk(table: DataFrame, spec: EntitySpec, field: str, expression: Expression, last_key=None, size: int = 10_000) -> tuple[DataFrame, object, int]:
    """(table, last key, rows updated): the next ``size`` null rows in key order after ``last_key``; 0 rows: complete."""
    if len(spec.primary_key) != 1:
        raise SpecError("chunks need a key of one column")
    key = spec.primary_key[0]
    todo = table.filter(F.col(field).isNull())
    if last_key is not None:
        todo = todo.filter(F.col(key) > last_key)
    bounds = todo.select(key).orderBy(key).limit(size).agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if not bounds["n"]:
        return table, last_key, 0
    # rows between the chunk's least and greatest key are exactly the chunk: no join back is needed
    inside = F.col(field).isNull() & F.col(key).between(bounds["lo"], bounds["hi"])
    return table.withColumn(field, F.when(inside, built(spec, field, expression)).otherwise(F.col(field))), bounds["hi"], bounds["n"]


def _read_progress(spark: SparkSession, path: str) -> dict[int, str]:
    try:
        rows = spark.read.parquet(f"{path}/progress").groupBy("chunk").agg(F.max_by("status", "at").alias("status")).collect()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return {}
        raise
    return {r["chunk"]: r["status"] for r in rows}


def _counts(spark: SparkSession, path: str, schema: StructType) -> dict[int, int]:
    """Rows of each range below ``path``."""
    try:
        found = spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return {}
    return {r["_chunk"]: r["n"] for r in found.groupBy("_chunk").agg(F.count(F.lit(1)).alias("n")).collect()}


def backfill_resumable(table: DataFrame, spec: EntitySpec, field: str, expression: Expression, path: str, chunks: int = 8, before_chunk: Callable[[int], None] | None = None) -> DataFrame:
    """Fill over key ranges, all open ones in one job, written below ``path``; a second call goes on with the ranges not complete.

    Ranges come from quantiles of the key. The first call stores them and, in one pass over the table, its rows by range, as they are
    at that time, and how many each range holds; they are deleted when all ranges are complete. A task's files are kept when the
    task ends, whether or not the job does, so of a job that is killed those ranges are complete that have all their rows.
    Others are emptied and written again. A range that fails is marked failed and the error is raised. ``before_chunk`` is asked
    before the job about each open range; if it raises, the ranges before that one are still filled. Returns the
    whole table once all are complete.
    """
    spark, key = table.sparkSession, spec.primary_key[0]
    if len(spec.primary_key) != 1:
        raise SpecError("ranges need a key of one column")
    staged = StructType([*table.schema.fields, StructField("_chunk", IntegerType())])
    if not _read_progress(spark, path):
        share = [i / chunks for i in range(1, chunks)]
        bounds = sorted(set(table.select(F.percentile_approx(key, share, 10_000).alias("q")).first()["q"] or []))
        at = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col(key))) if bounds else F.lit(0)
        table.withColumn("_chunk", at.cast("int")).write.mode("overwrite").partitionBy("_chunk").parquet(f"{path}/input")
        sizes = _counts(spark, f"{path}/input", staged)
        spark.createDataFrame(sorted(sizes.items()), "chunk int, n long").write.mode("overwrite").parquet(f"{path}/sizes")
        _note(spark, path, {-1: DONE})
    sizes = {r["chunk"]: r["n"] for r in spark.read.parquet(f"{path}/sizes").collect()}
    written = _counts(spark, f"{path}/rows", staged)
    asked, refused = [], None
    for i in sorted(i for i, n in sizes.items() if written.get(i) != n):
        try:
            if before_chunk:
                before_chunk(i)
        except Exception as error:  # noqa: BLE001
            refused = i, error
            break
        asked.append(i)
    if asked:
        for i in asked:
            delete(spark, f"{path}/rows/_chunk={i}")
        open_ = spark.read.schema(staged).parquet(f"{path}/input").filter(F.col("_chunk").isin(asked))
        filled = backfill(open_.select(*table.columns, "_chunk"), spec, field, expression)
        try:
            filled.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("_chunk").parquet(f"{path}/rows")
        finally:
            written = _counts(spark, f"{path}/rows", staged)
            _note(spark, path, {i: DONE if written.get(i) == sizes[i] else FAILED for i in asked})
    if refused:
        _note(spark, path, {refused[0]: FAILED})
        raise refused[1]
    delete(spark, f"{path}/input")
    return spark.read.schema(staged).parquet(f"{path}/rows").select(*table.columns) if sizes else table.limit(0)


def _note(spark: SparkSession, path: str, status: dict[int, str]) -> None:
    rows = spark.createDataFrame(list(status.items()), "chunk int, status string")
    rows.coalesce(1).withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{path}/progress")


def ready_for_not_null(plans: DataFrame, fields: DataFrame, plan: str = "plan_hash") -> DataFrame:
    """Plans of which every field is complete."""
    return without(plans, fields.filter(F.col("status") != DONE), plan, plan)


def backfill_status(plans: DataFrame, fields: DataFrame, plan_hash: str | None = None, caller: str | None = None) -> DataFrame:
    """The fields, in order, of one plan by hash or of the caller's latest plan."""
    if plan_hash is not None:
        chosen = plans.filter(F.col("plan_hash") == plan_hash)
    else:
        chosen = latest_per_key(plans.filter(F.col("caller") == caller), ["caller"], ["started_at", "plan_hash"])
    found = chosen.select("plan_hash", "caller", F.col("status").alias("plan_status"))
    return found.join(fields, "plan_hash").orderBy("entity_id", "field")
