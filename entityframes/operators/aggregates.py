"""Counts, sums over time, latest rows and zero-filled status counts."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise


def count_rows(df: DataFrame, name: str = "rows") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def count_by_time(df: DataFrame, ts: str, unit: str, since: datetime | None = None, name: str = "rows") -> DataFrame:
    """Rows per truncated time unit from ``since`` on, in order of time."""
    if since is not None:
        df = df.filter(F.col(ts) >= since)
    return df.groupBy(F.date_trunc(unit, ts).alias("bucket")).agg(F.count(F.lit(1)).alias(name)).orderBy("bucket")


def sum_by_time(df: DataFrame, ts: str, unit: str, value: str, name: str = "total", filters: Column | None = None) -> DataFrame:
    if filters is not None:
        df = df.filter(filters)
    return df.groupBy(F.date_trunc(unit, ts).alias("bucket")).agg(F.sum(value).alias(name)).orderBy("bucket")


def collect_values(df: DataFrame, keys: list[str], value: str, name: str = "values") -> DataFrame:
    """The values of each group as a sorted array; nulls are left out. A group is one array: use ``collect_chunks`` where groups have no bound."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias(name))


RANGE_ROWS, LEAST_ROWS = 250_000, 10_000  # of a task


def ranges_of(df: DataFrame) -> int:
    """How many tasks ``df`` is dealt to: about ``RANGE_ROWS`` rows each at most, Spark's own number if those have ``LEAST_ROWS`` or more."""
    n = df.count()
    return max(1, -(-n // RANGE_ROWS), min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // LEAST_ROWS)))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "number", ranges: int | None = None) -> DataFrame:
    """``df`` with the place of each row in its group, from 1, by ``order``; ties are numbered in any order.

    Rows are sorted by ranges of (keys, order), so a group of any size is spread over tasks, and there are as many ranges as keep each
    bounded. Each range numbers its own rows of a group. Only the first group of a range can have begun before it, so what is added
    to join the ranges is one row for each range at most.
    """
    spark_keys, n = [F.col(k).asc_nulls_first() for k in keys], ranges or ranges_of(df)
    ranged = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *spark_keys, *order, "_tie").withColumn("_range", F.spark_partition_id())
    ranged = materialise(ranged, "numbered")
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    held = ranged.groupBy(*[F.col(k).alias(names[k]) for k in keys], F.col("_range").alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*names.values()).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.broadcast(held.withColumn("_before", F.sum("_n").over(before)).filter("_before is not null"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()], F.col("_range") == F.col("_r"))
    here = Window.partitionBy(*keys, "_range").orderBy(*order, "_tie")
    placed = ranged.repartition(n, "_range").join(begun, same, "left")
    return placed.withColumn(name, F.row_number().over(here) + F.coalesce("_before", F.lit(0))).select(*df.columns, name)


def collect_chunks(df: DataFrame, keys: list[str], value: str, size: int = 10_000, name: str = "values", chunk: str = "chunk") -> DataFrame:
    """(keys, chunk, values): the values of each group in ascending order, cut into arrays of at most ``size``; nulls are left out.

    Chunks are numbered from 0, and all but a group's last are full. No task holds a group whose values are many.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, value)
    n = ranges_of(rows)
    placed = numbered(rows, keys, [value], "_number", n).withColumn("_cut", F.floor((F.col("_number") - 1) / size).cast("long"))
    found = placed.repartition(n, *keys, "_cut").groupBy(*keys, F.col("_cut").alias(chunk))
    return found.agg(F.sort_array(F.collect_list(value)).alias(name))


def status_counts(df: DataFrame, status: str, known: list[str], name: str = "rows") -> DataFrame:
    """Rows per status; every known status is present, other statuses are not reported."""
    counts = df.filter(F.col(status).isin(known)).groupBy(status).agg(F.count(F.lit(1)).alias(name))
    all_known = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(k) for k in known])).alias(status))
    return all_known.join(counts, status, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def queue_lag(df: DataFrame, enqueued: str, as_of: datetime, name: str = "lag_seconds") -> DataFrame:
    """Seconds since the oldest entry; 0 for an empty queue."""
    oldest = F.unix_timestamp(F.min(enqueued))
    return df.agg(F.coalesce(F.unix_timestamp(F.lit(as_of)) - oldest, F.lit(0)).alias(name))


def latest_per_key(df: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """The newest row of each key: one aggregate of a struct, no sort. Ties go by the later columns of ``newest``."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*newest)).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])
