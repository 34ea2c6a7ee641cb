"""Exact de-duplication by skew-safe combining.

Texts are equal when they are identical after every run of white space has become one space.
Three combining stages, each of which groups by the digest *and the full normalised content*:

1. local: the partial aggregate in every map task leaves one row per text and task;
2. salted: rows of one digest are merged in ``salts`` groups, so that copies that make up a third
   of the input still arrive in many tasks;
3. global: the salt winners of a digest are merged; there are at most ``salts`` of them.

A fixed-size row (smallest id, count) travels with each content, never a list of members. The
winners are handed back to the members by digest. Where stage 3 has proved that a digest has one
content only, the digest decides; digests with several contents (collisions of the digest
function) are joined on the content as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, materialise


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def sha256(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def combine(docs: DataFrame, id_col: str, text_col: str, salts: int, digest: Callable[[Column], Column]) -> DataFrame:
    """One row per distinct content: _digest, _content, _keep, _copies."""
    rows = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_content"))
    rows = rows.select("_id", "_content", digest(F.col("_content")).alias("_digest"), F.pmod(F.xxhash64("_id"), F.lit(salts)).alias("_salt"))
    salted = rows.groupBy("_digest", "_salt", "_content").agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_copies"))
    return salted.groupBy("_digest", "_content").agg(F.min("_keep").alias("_keep"), F.sum("_copies").alias("_copies"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, salts: int, digest: Callable[[Column], Column]) -> DataFrame:
    """``docs`` with __digest, __keep and __copies."""
    contents = combine(docs, id_col, text_col, salts, digest)
    # a digest's contents differ only where the digest function collides
    per_digest = contents.groupBy("_digest").agg(F.count(F.lit(1)).alias("contents"), F.min("_keep").alias("__keep"), F.sum("_copies").alias("__copies"))
    groups = materialise(per_digest.withColumnRenamed("_digest", "__digest"), "exact-groups")
    rows = docs.withColumn("__digest", digest(normalised(F.col(text_col))))
    found = rows.join(groups.filter("contents = 1").drop("contents"), "__digest")
    collided = groups.filter("contents > 1").select("__digest")
    if not collided.isEmpty():
        again = rows.join(collided, "__digest", "left_semi")
        several = combine(again, id_col, text_col, salts, digest).toDF("__digest", "__content", "__keep", "__copies")
        both = again.withColumn("__content", normalised(F.col(text_col))).join(several, ["__digest", "__content"])
        found = found.unionByName(both.drop("__content"))
    return found


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256; every input row and column stays.

    ``id_col`` identifies a row. Null and empty texts are one group (the empty content). A row with
    a null id never wins against one with an id; a group of null ids only has keep_id null, and its
    rows count as kept. Rows that repeat an id and text get the same answer each. Input columns
    named like an output column are replaced. An empty table gives an empty result.
    """
    added = ("keep_id", "group_size", "kept", "text_sha256")
    hexed = F.lower(F.hex("__digest")) if digest is sha256 else F.sha2(normalised(F.col(text_col)), 256)
    return _grouped(docs, id_col, text_col, salts, digest).select(
        *[c for c in docs.columns if c not in added],
        F.col("__keep").alias("keep_id"),
        F.col("__copies").alias("group_size"),
        F.col(id_col).eqNullSafe(F.col("__keep")).alias("kept"),
        hexed.alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``."""
    return _grouped(docs, id_col, text_col, salts, sha256).filter(F.col(id_col).eqNullSafe(F.col("__keep"))).select(*docs.columns)
