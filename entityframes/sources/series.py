"""Time series: chunked storage, chunk statistics, pruned range reads and retention."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = "chunk"


def chunk_of(ts: Column | str, interval: str) -> Column:
    """The start of the chunk that holds a time; chunks of a fixed length count from the epoch, in UTC."""
    return F.window(ts, interval)["start"]


def month_chunk(ts: Column | str) -> Column:
    """[first of the month, first of the next month)."""
    start = F.date_trunc("month", ts)
    return F.struct(start.alias("start"), F.add_months(start, 1).cast("timestamp").alias("end"))


def chunk_stats(df: DataFrame, ts: str, interval: str) -> DataFrame:
    """(chunk, rows, first, last) of each chunk."""
    rows = df.withColumn(CHUNK, chunk_of(F.col(ts), interval))
    return rows.groupBy(CHUNK).agg(F.count(F.lit(1)).alias("rows"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def write_chunked(df: DataFrame, ts: str, interval: str, path: str) -> None:
    """Rows stored by chunk. They are dealt by chunk and hash of the row, so a large chunk gets several writers."""
    spread = F.pmod(F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")]), F.lit(4))
    df.withColumn(CHUNK, F.date_format(chunk_of(F.col(ts), interval), "yyyy-MM-dd'T'HH-mm-ss")).repartition(F.col(CHUNK), spread).write.partitionBy(CHUNK).parquet(path)


def _chunk_start() -> Column:
    return F.to_timestamp(F.col(CHUNK), "yyyy-MM-dd'T'HH-mm-ss")


def read_range(spark: SparkSession, path: str, ts: str, interval: str, start: datetime, end: datetime) -> DataFrame:
    """Rows with start <= ts < end. The chunk bounds are partition filters, so other chunks are not opened."""
    df = spark.read.option("inferSchema", "false").parquet(path)
    first = spark.range(1).select(F.date_format(F.window(F.lit(start).cast("timestamp"), interval)["start"], "yyyy-MM-dd'T'HH-mm-ss").alias("c")).first()["c"]
    last = end.strftime("%Y-%m-%dT%H-%M-%S")
    # the names of chunks sort like their starts
    return df.filter((F.col(CHUNK).cast("string") >= first) & (F.col(CHUNK).cast("string") <= last)).filter((F.col(ts) >= start) & (F.col(ts) < end)).drop(CHUNK)


def drop_chunks_before(df: DataFrame, ts: str, interval: str, cutoff: datetime) -> tuple[DataFrame, DataFrame]:
    """(kept rows, dropped chunks): chunks that end at or before the cutoff go; one that reaches past it stays whole."""
    w = F.window(ts, interval)
    rows = df.withColumn("_w", w)
    gone = F.col("_w.end") <= cutoff
    dropped = rows.filter(gone).groupBy(F.col("_w.start").alias(CHUNK)).agg(F.count(F.lit(1)).alias("rows"))
    return rows.filter(~gone).drop("_w"), dropped
