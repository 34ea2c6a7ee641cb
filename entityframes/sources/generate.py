"""Repeatable test data for a specification: each value is a hash of (seed, column, row number)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import EntitySpec, Field

STATUSES = ("active", "pending", "archived")


def _hash(seed: int, name: str, modulus: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.col("id")), F.lit(modulus))


def _string(f: Field, seed: int) -> Column:
    k, name = _hash(seed, f.name, 1_000_000).cast("string"), f.name.lower()
    if "email" in name:
        value = F.concat(F.lit("user"), k, F.lit("@example.com"))
    elif "url" in name:
        value = F.concat(F.lit("https://example.com/"), k)
    elif "status" in name:
        value = F.element_at(F.array(*[F.lit(s) for s in STATUSES]), (_hash(seed, f.name, len(STATUSES)) + 1).cast("int"))
    elif "name" in name:
        value = F.concat(F.lit("Name "), k)
    elif f.type == "uuid" or name == "id" or name.endswith("_id"):
        h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(f.name), F.col("id").cast("string")))
        value = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    else:
        value = F.concat(F.lit(f"{f.name} "), k)
    return F.left(value, F.lit(f.kind.length)) if f.kind.length else value


def _value(f: Field, seed: int) -> Column:
    k = f.kind
    if k.kind == "int":
        return _hash(seed, f.name, 32_767 if f.type == "smallint" else 1_000_000)
    if k.kind == "bool":
        return _hash(seed, f.name, 2) == 1
    if k.kind == "timestamp":
        return F.timestamp_seconds(F.col("id") * 60)
    if k.kind == "numeric":
        return _hash(seed, f.name, min(1000 * 10**k.scale, 10**k.precision)).cast("decimal(38,0)") / F.lit(10**k.scale)
    if k.kind == "float":
        return _hash(seed, f.name, 1_000_000) / F.lit(1000.0)
    if k.kind == "json":
        return F.concat(F.lit('{"v":'), _hash(seed, f.name, 1000).cast("string"), F.lit("}"))
    if k.kind == "bytes":
        return F.unhex(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(f.name), F.col("id").cast("string"))))
    if k.kind == "interval":
        return F.make_dt_interval(secs=_hash(seed, f.name, 86_400).cast("decimal(18,6)"))
    if k.kind == "vector":
        raw = F.transform(F.sequence(F.lit(1), F.lit(k.dim)), lambda i: F.pmod(F.xxhash64(F.lit(seed), F.lit(f.name), F.col("id"), i), F.lit(2001)) / 1000.0 - 1.0)
        norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
        return F.transform(raw, lambda x: x / F.greatest(norm, F.lit(1e-12)))
    if k.kind == "array":
        return F.array(_hash(seed, f.name, 100).cast(k.spark.elementType))
    return _string(f, seed)


def generate(spark: SparkSession, spec: EntitySpec, n: int, seed: int = 0, pk_start: int = 1) -> DataFrame:
    """``n`` rows: a counter as key, values by kind and column name, nulls in a tenth of the nullable values.

    The result depends on the seed only, not on the partitioning.
    """
    rows = spark.range(n)
    out = []
    for f in spec.fields:
        if f.name in spec.primary_key and f.kind.kind == "int":
            c: Column = F.col("id") + pk_start
        else:
            c = _value(f, seed)
            if f.nullable and f.name not in spec.primary_key:
                c = F.when(_hash(seed + 1, f.name, 10) > 0, c)
        out.append(c.cast(f.kind.spark).alias(f.name))
    return rows.select(*out)
