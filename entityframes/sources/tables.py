"""Scans, descriptions, snapshots and change reads over Parquet tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import EntitySpec, conform, signature

FORMAT = 2  # tables in ranges of their keys, with digests


class SnapshotError(ValueError):
    """A snapshot of another format or schema."""


def scan(spark: SparkSession, spec: EntitySpec, path: str) -> DataFrame:
    """The whole table with the declared columns in the declared order. The schema is given, so no file is read for it."""
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in spec.struct()])
    return conform(spark.read.schema(nullable).parquet(path), spec)


def describe(df: DataFrame, spec: EntitySpec) -> DataFrame:
    """One row per column: entity, field, type, nullable, key, markers and the number of rows."""
    markers = {n: v for n in ("soft_delete", "touch", "tenant", "time", "ttl") if (v := getattr(spec, n))}
    rows = []
    for place, f in enumerate(spec.fields):
        mine = ",".join(sorted(n for n, c in markers.items() if c == f.name))
        rows.append(F.struct(F.lit(spec.name).alias("entity"), F.lit(place).alias("place"), F.lit(f.name).alias("field"), F.lit(f.type).alias("type"),
                             F.lit(f.nullable and f.name not in spec.primary_key).alias("nullable"), F.lit(f.name in spec.primary_key).alias("key"), F.lit(mine).alias("markers")))
    return df.agg(F.count(F.lit(1)).alias("rows")).select(F.explode(F.array(*rows)).alias("x"), "rows").select("x.*", "rows")


_RANGE, _DIGESTS, _ABOUT = "_range", "_digests", "_about_snapshot"


def _cut(df: DataFrame, spec: EntitySpec, ranges: int) -> int:
    """How a table is cut into ranges of its key: the width of a range of whole numbers, or for other keys minus the number of hash ranges."""
    first = spec.primary_key[0]
    if not isinstance(df.schema[first].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return -ranges
    lo, hi = df.agg(F.min(first), F.max(first)).first()
    return 1 if lo is None else max(1, -(-(hi - lo + 1) // ranges))


def _range_of(spec: EntitySpec, cut: int) -> Column:
    return F.floor(F.col(spec.primary_key[0]) / cut).cast("long") if cut > 0 else F.pmod(F.xxhash64(*spec.primary_key), F.lit(-cut)).cast("long")


def _digests(df: DataFrame, columns: list[str]) -> DataFrame:
    """(range, rows, two sums of 64-bit hashes of whole rows): equal for equal rows in any order. Which columns are null counts too."""
    cells = [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    return df.groupBy(_RANGE).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*cells).cast("decimal(38,0)")).alias("sum_a"), F.sum(F.xxhash64(F.lit(1), *cells).cast("decimal(38,0)")).alias("sum_b"))


def save_snapshot(tables: dict[str, DataFrame], specs: list[EntitySpec], path: str, like: str | None = None, ranges: int = 64) -> None:
    """Every table below ``path`` in ranges of its key, with a digest of each range, then the row that says what they are: without it there is no snapshot.

    Two snapshots can be compared range by range if they are cut alike: name the earlier one as ``like``. Whole-number keys are
    cut by value into about ``ranges`` ranges (as many more as the keys grow beyond those of the first snapshot), other keys by hash.
    """
    spark = next(iter(tables.values())).sparkSession
    cuts = dict(_about(spark, like)["cuts"] or {}) if like else {}
    for s in specs:
        df = conform(tables[s.name], s)
        cuts.setdefault(s.name, None)
        cuts[s.name] = cuts[s.name] or _cut(df, s, ranges)
        ranged = df.withColumn(_RANGE, _range_of(s, cuts[s.name]))
        ranged.repartitionByRange(_RANGE, *s.primary_key).write.partitionBy(_RANGE).parquet(f"{path}/{s.name}")
        written = spark.read.schema(ranged.schema).parquet(f"{path}/{s.name}")
        _digests(written, list(s.columns)).write.parquet(f"{path}/{_DIGESTS}/{s.name}")
    about = spark.createDataFrame([(FORMAT, signature(specs), cuts)], "format int, signature string, cuts map<string, long>")
    about.withColumn("saved_at", F.current_timestamp()).write.parquet(f"{path}/{_ABOUT}")


def _about(spark: SparkSession, path: str) -> Row:
    about = spark.read.parquet(f"{path}/{_ABOUT}").first()
    if about["format"] != FORMAT:
        raise SnapshotError(f"format {about['format']}")
    return about


def load_snapshot(spark: SparkSession, path: str, specs: list[EntitySpec]) -> dict[str, DataFrame]:
    """All declared tables; one that the snapshot lacks is empty. Another format or signature is refused."""
    if _about(spark, path)["signature"] != signature(specs):
        raise SnapshotError("the snapshot has another schema")
    out = {}
    for s in specs:
        try:
            out[s.name] = scan(spark, s, f"{path}/{s.name}")
        except AnalysisException:
            out[s.name] = spark.createDataFrame([], s.struct())
    return out


def differing(spark: SparkSession, before: str, after: str, specs: list[EntitySpec]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The tables of two snapshots without the key ranges that are equal in both: their differences are those of the whole tables.

    Digests say which ranges differ, and only their folders are read. A table that is cut in two ways comes whole. Ranges are taken for
    equal by their number of rows and two sums of 64-bit hashes. What is collected is one number for each range that differs.
    """
    cuts = [dict(_about(spark, p)["cuts"]) for p in (before, after)]
    sides: tuple[dict, dict] = {}, {}
    for s in specs:
        if any(_about(spark, p)["signature"] != signature(specs) for p in (before, after)):
            raise SnapshotError("the snapshots have another schema")
        alike = cuts[0].get(s.name) == cuts[1].get(s.name)
        if alike:
            b, a = (spark.read.parquet(f"{p}/{_DIGESTS}/{s.name}").select(_RANGE, F.struct("rows", "sum_a", "sum_b").alias(n)) for p, n in ((before, "b"), (after, "a")))
            ranges = [r[_RANGE] for r in b.join(a, _RANGE, "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select(_RANGE).collect()]
        for side, path in zip(sides, (before, after), strict=True):
            whole = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in s.struct()], T.StructField(_RANGE, T.LongType())])
            df = spark.read.schema(whole).parquet(f"{path}/{s.name}")
            side[s.name] = conform(df.filter(F.col(_RANGE).isin(ranges)) if alike else df, s)
    return sides


def read_changes_since(df: DataFrame, cursor: int, limit: int, seq: str = "id") -> DataFrame:
    """Rows after the cursor in ascending order; of more than ``limit``, the newest."""
    return df.filter(F.col(seq) > cursor).orderBy(F.col(seq).desc()).limit(limit).orderBy(seq)
