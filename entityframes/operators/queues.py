"""Queue tables: retries, dead letters, leases, expiry."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import EntitySpec, SpecError

BASE_DELAY_MS, MOST_DELAY_MS = 100, 3_600_000
LEASE_GRACE = "5 minutes"
DEFAULT_SWEEP, DEFAULT_DEAD = 1000, 50


def eligible(queue: DataFrame, as_of: datetime, limit: int = 100, id_col: str = "id") -> DataFrame:
    """Entries to try now, oldest first: never failed, or later than their back-off of 2**attempts * 100 ms, 1 h at most."""
    delay = F.least(F.pow(F.lit(2.0), F.least("attempts", F.lit(40))) * BASE_DELAY_MS, F.lit(float(MOST_DELAY_MS)))
    due = F.unix_millis(F.lit(as_of)) > F.unix_millis("last_error_at") + delay
    return queue.filter(F.col("last_error_at").isNull() | due).orderBy("enqueued_at", id_col).limit(limit)


def split_failures(failed: DataFrame, max_attempts: int, as_of: datetime) -> tuple[DataFrame, DataFrame]:
    """(to try again, dead letters): one attempt more; dead when that reaches ``max_attempts``."""
    tried = failed.withColumns({"attempts": F.col("attempts") + 1, "last_error_at": F.lit(as_of)})
    dead = tried.filter(F.col("attempts") >= max_attempts).withColumns({"reason": F.concat_ws(" ", F.lit("failed"), F.col("attempts").cast("string"), F.lit("times")), "moved_at": F.lit(as_of)})
    return tried.filter(F.col("attempts") < max_attempts), dead


def _tries(retries: str = "max_retries"):
    return F.greatest(F.col(retries), F.lit(1))


def exhausted(queue: DataFrame, as_of: datetime) -> DataFrame:
    """No attempt is left, and the entry is pending, or running on a lease that ended over five minutes ago."""
    stale = (F.col("status") == "running") & (F.col("claimed_until") < F.lit(as_of) - F.expr(f"interval {LEASE_GRACE}"))
    return queue.filter((F.col("attempts") >= _tries()) & ((F.col("status") == "pending") | stale))


def ready(queue: DataFrame, as_of: datetime, names: list[str] | None = None, limit: int = 100, id_col: str = "id") -> DataFrame:
    """Entries to claim in order of schedule: due, with attempts left, and pending or without a live lease."""
    free = (F.col("status") == "pending") | ((F.col("status") == "running") & (F.col("claimed_until").isNull() | (F.col("claimed_until") < as_of)))
    rows = queue.filter((F.col("scheduled_for") <= as_of) & (F.col("attempts") < _tries()) & free)
    if names:
        rows = rows.filter(F.col("job_name").isin(names))
    return rows.orderBy("scheduled_for", id_col).limit(limit)


def requeue(queue: DataFrame, dead: DataFrame, ids: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(queue, dead) after the given dead entries are pending again, with the same id and no attempts."""
    back = dead.join(ids.select(id_col), id_col, "left_semi").withColumns({"status": F.lit("pending"), "attempts": F.lit(0).cast(queue.schema["attempts"].dataType)})
    return queue.unionByName(back.select(*queue.columns)), dead.join(ids.select(id_col), id_col, "left_anti")


def dead_list(dead: DataFrame, name: str | None = None, limit: int = DEFAULT_DEAD, id_col: str = "id") -> DataFrame:
    rows = dead if name is None else dead.filter(F.col("job_name") == name)
    return rows.orderBy(F.col("moved_at").desc(), F.col(id_col).desc()).limit(limit if limit > 0 else DEFAULT_DEAD)


def purge_settled(queue: DataFrame, as_of: datetime, age_seconds: int) -> DataFrame:
    """The queue without entries older than ``age_seconds``, processed or not; under a minute is refused."""
    if age_seconds < 60:
        raise SpecError("an age under one minute would drop live entries")
    return queue.filter(F.col("enqueued_at") >= F.lit(as_of) - F.expr(f"interval {int(age_seconds)} seconds"))


def sweep_expired(table: DataFrame, spec: EntitySpec, as_of: datetime, limit: int | None = DEFAULT_SWEEP) -> tuple[DataFrame, DataFrame]:
    """(table, removed keys): rows whose expiry is before ``as_of``, oldest first, at most ``limit`` (None: all)."""
    if not spec.ttl:
        raise SpecError(f"{spec.name} has no expiry field")
    expired = F.col(spec.ttl) < as_of
    if limit is None:
        return table.filter(~F.coalesce(expired, F.lit(False))), table.filter(expired).select(*spec.primary_key)
    gone = table.filter(expired).orderBy(spec.ttl, *spec.primary_key).limit(limit).select(*spec.primary_key)
    return table.join(gone, list(spec.primary_key), "left_anti"), gone


def live_rows(table: DataFrame, spec: EntitySpec, as_of: datetime) -> DataFrame:
    """Rows that expire later than ``as_of``."""
    return table.filter(F.col(spec.ttl) > as_of)
