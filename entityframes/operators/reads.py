"""Point reads, projections, order, paging and totals."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import EntitySpec, SpecError
from ..storage import materialise
from .filters import scoped

ASC, DESC = "asc", "desc"
DEFAULT_LIMIT, MAX_LIMIT = 100, 1000


def project(df: DataFrame, spec: EntitySpec, names: list[str]) -> DataFrame:
    """The named columns; an unknown name is an error before any work."""
    spec.check_columns(names)
    return df.select(*names)


def get(df: DataFrame, spec: EntitySpec, key: dict[str, Any], tenant: Any = None) -> DataFrame:
    """The row with this primary key, or no row; soft-deleted rows are absent."""
    if set(key) != set(spec.primary_key):
        raise SpecError(f"{spec.name} is read by {spec.primary_key}")
    return scoped(df, spec, tenant).filter(reduce(lambda a, b: a & b, [F.col(c) == v for c, v in key.items()]))


def batch_get(df: DataFrame, spec: EntitySpec, keys: DataFrame, tenant: Any = None) -> DataFrame:
    """Rows whose key is in ``keys``; missing keys are skipped. Spark picks broadcast or shuffle by size."""
    return scoped(df, spec, tenant).join(keys.select(*spec.primary_key), list(spec.primary_key), "left_semi")


OrderKey = tuple[str | Column, str] | tuple[str | Column, str, str]


def sort_columns(keys: list[OrderKey]) -> list[Column]:
    """(column, asc or desc[, first or last]); nulls come last ascending and first descending."""
    out = []
    for name, direction, *nulls in keys:
        c = F.col(name) if isinstance(name, str) else name
        first = nulls[0] == "first" if nulls else direction == DESC
        out.append((c.asc_nulls_first() if first else c.asc_nulls_last()) if direction == ASC else (c.desc_nulls_first() if first else c.desc_nulls_last()))
    return out


def order(df: DataFrame, keys: list[OrderKey]) -> DataFrame:
    return df.orderBy(*sort_columns(keys))


def clamp(limit: int) -> int:
    return DEFAULT_LIMIT if limit <= 0 else min(limit, MAX_LIMIT)


def with_tiebreak(spec: EntitySpec, keys: list[OrderKey]) -> list[OrderKey]:
    """The order made total: the primary key columns that are missing, ascending."""
    named = {k[0] for k in keys if isinstance(k[0], str)}
    return [*keys, *((c, ASC) for c in spec.primary_key if c not in named)]


def after(keys: list[OrderKey], cursor: list[Any]) -> Column:
    """Rows strictly after the cursor: an OR over the left prefixes of the order.

    A column that can be null is given with the place of its nulls ("first" or "last"): then they are paged like any
    value. Other columns must not be null in a cursor, and their null rows lie on no page after the first.
    """
    if len(cursor) != len(keys) or any(v is None and len(k) < 3 for v, k in zip(cursor, keys, strict=True)):
        raise SpecError("a cursor has one value for each column of the order, null only where the order places nulls")

    def beyond(key: OrderKey, v: Any) -> Column:
        c, nulls = F.col(key[0]), key[2] if len(key) > 2 else None
        if v is None:
            return c.isNotNull() if nulls == "first" else F.lit(False)
        more = c > v if key[1] == ASC else c < v
        return more | c.isNull() if nulls == "last" else more

    terms = []
    for i, key in enumerate(keys):
        same = [F.col(k[0]).eqNullSafe(F.lit(v)) if len(k) > 2 else F.col(k[0]) == v for k, v in zip(keys[:i], cursor[:i], strict=True)]
        terms.append(reduce(lambda a, b: a & b, [*same, beyond(key, cursor[i])]))
    return reduce(lambda a, b: a | b, terms)


def page(df: DataFrame, spec: EntitySpec, keys: list[OrderKey], cursor: list[Any] | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The next ``limit`` rows in (order, key). The plan is a filter and a top-k, never a full sort."""
    keys = with_tiebreak(spec, keys)
    if cursor is not None:
        df = df.filter(after(keys, cursor))
    return order(df, keys).limit(clamp(limit))


def page_with_cursor(df: DataFrame, spec: EntitySpec, keys: list[OrderKey], cursor: list[Any] | None = None, limit: int = DEFAULT_LIMIT) -> tuple[list, list[Any] | None]:
    """(rows, cursor of the next page or None): one row more than the page tells whether there is a next."""
    limit, keys = clamp(limit), with_tiebreak(spec, keys)
    if cursor is not None:
        df = df.filter(after(keys, cursor))
    rows = order(df, keys).limit(limit + 1).collect()
    following = [rows[limit - 1][k[0]] for k in keys] if len(rows) > limit else None
    if following and any(v is None and len(k) < 3 for v, k in zip(following, keys, strict=True)):
        raise SpecError("an order over a column with nulls must place them: (column, direction, 'first' or 'last')")
    return rows[:limit], following


def numbered(df: DataFrame, columns: list[Column], name: str) -> DataFrame:
    """Global row numbers (from 0) in this order without one task that sees all rows.

    Rows are range-partitioned and numbered within partitions; only one count per partition is added up.
    """
    ranged = df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("_row", F.monotonically_increasing_id())
    ranged = ranged.withColumns({"_part": F.shiftright("_row", 33), "_at": F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_row")
    ranged = materialise(ranged, "ranged")  # ranges are drawn by sampling: both uses below must see the same ones
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    so_far = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias("_start"))
    # one row per partition: as many as spark.sql.shuffle.partitions
    return ranged.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def page_index(df: DataFrame, spec: EntitySpec, keys: list[OrderKey], limit: int) -> DataFrame:
    """All page boundaries at once: (page, the order columns of the page's last row, rows on the page)."""
    keys = with_tiebreak(spec, keys)
    names = [k[0] for k in keys]
    rows = numbered(df.select(*names), sort_columns(keys), "_n").withColumn("page", F.expr(f"_n div {int(limit)}"))
    last = F.max_by(F.struct(*names), "_n").alias("last")
    return rows.groupBy("page").agg(last, F.count(F.lit(1)).alias("rows")).select("page", *[F.col(f"last.{n}").alias(n) for n in names], "rows")


def with_total(df: DataFrame, name: str = "total") -> DataFrame:
    """The number of all rows beside each row, as a joined one-row count, not a one-partition window."""
    return df.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias(name))))


def history_page(df: DataFrame, version: str, before: int | None = None, caller: tuple[str, Any] | None = None, limit: int = 25) -> DataFrame:
    """Newest versions first, below ``before``; one row more than ``limit`` if there are more."""
    if not 1 <= limit <= 100:
        limit = 25
    if before is not None:
        df = df.filter(F.col(version) < before)
    if caller is not None:
        df = df.filter(F.col(caller[0]) == caller[1])
    return df.orderBy(F.col(version).desc()).limit(limit + 1)


def recent_with_lookup(log: DataFrame, dimension: DataFrame, on: tuple[str, str], newest: list[OrderKey], limit: int) -> DataFrame:
    """Log rows with their owner, newest first; rows without an owner do not count towards the limit."""
    return order(log.join(dimension, log[on[0]] == dimension[on[1]]), newest).limit(limit)


def sample_rows(df: DataFrame, spec: EntitySpec, n: int) -> DataFrame:
    """The first n rows in key order; none for n <= 0."""
    return df.orderBy(*[F.col(c).asc() for c in spec.primary_key]).limit(max(0, n))


def hash_sample(df: DataFrame, spec: EntitySpec, percent: float, seed: int = 0) -> DataFrame:
    """A repeatable sample by the MD5 of seed and key as text, the same for any partitioning and in any engine."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in spec.primary_key]))
    return df.filter(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % 1_000_000 < int(percent * 10_000))
