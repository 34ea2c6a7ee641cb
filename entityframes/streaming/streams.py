"""Streams of change events: ordered sources, idempotent application, debounce, expiry, counters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.changes import latest_version
from ..storage import delete, materialise, scope
from .ordered_log import append_log, read_log

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def change_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """An append-only folder of change events as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def merge_versions(target: DataFrame, events: DataFrame) -> DataFrame:
    """The highest version of each row over both; applying a batch twice changes nothing."""
    return latest_version(target.unionByName(events.select(*target.columns)))


def ordered_stream(spark: SparkSession, rows: DataFrame, path: str, order: list, batches: int) -> DataFrame:
    """``rows`` written once to an ordered log at ``path``, as a stream of about ``batches`` batches in that order; nulls come first."""
    length = append_log(rows, path, order, batches)
    return read_log(spark, path, rows.schema, -(-length // batches) if length else 0)


_PART = "_part"


def _settled(spark: SparkSession, target: str, parts: int | None) -> int:
    """The number of parts of a target, which its first batch decides."""
    fs, path = _folder(spark, target)
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    known = next((int(n[len(_PARTS) + 1 :]) for n in names if n.startswith(f"{_PARTS}=")), None)
    if known is None:
        known = parts or 16
        fs.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(path, f"{_PARTS}={known}"))
    elif parts not in (None, known):
        raise ValueError(f"{target} has {known} parts, not {parts}")
    return known


def apply_batch(batch: DataFrame, batch_id: int, target: str, parts: int | None = None) -> None:
    """Add the runs of one batch to ``target``; see ``apply_stream``."""
    spark = batch.sparkSession
    with scope(spark):
        new = materialise(latest_version(batch), "batch")
        n_parts = _settled(spark, target, parts)
        placed = lambda df: df.withColumn(_PART, F.pmod(F.xxhash64("entity", "row_id"), F.lit(n_parts)).cast("int"))
        touched = {r[_PART]: r["n"] for r in placed(new).groupBy(_PART).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``n_parts``
        runs, replaced = _runs(spark, target, batch_id)
        since, taken = {}, []
        for p, n in touched.items():
            size, since[p] = max(LEAST_BYTES, n * ROW_BYTES), batch_id
            for run in runs.get(p, []):
                if run.size > 2 * size:
                    break
                size, since[p] = size + run.size, run.first
                taken.append(run.path)
        merged = merge_versions(spark.read.schema(new.schema).parquet(*taken), new) if taken else new
        first = F.create_map(*[F.lit(x) for pair in since.items() for x in pair])[F.col(_PART)] if since else F.lit(batch_id)
        out = placed(merged.select(*new.columns)).withColumn(_FROM, first)
        out.repartition(_PART).write.mode("overwrite").partitionBy(_PART, _FROM).parquet(f"{target}/v={batch_id}")
    for old in replaced:
        delete(spark, old)


def apply_stream(events: DataFrame, target: str, checkpoint: str, parts: int | None = None) -> StreamingQuery:
    """Apply the stream to ``target``, which is cut into ``parts`` (16 unless it says otherwise already) by the hash of the row.

    A batch adds a *run* of the rows it touches to each part it meets: ``target/v=<batch>/_part=<n>/_from=<first batch>``. The run
    takes in the newest older runs of the part as long as those are at most twice its size, so a part has runs of
    growing sizes, few of them, and what a batch writes grows with the batch and not with the target. A run replaces
    those of its part since ``_from``. A batch that is replayed writes the same folder again from the same older runs: what a
    run replaces is deleted only by a later batch. Read the target with ``read_target``; to stop at the end, ``drain`` the query.
    """
    return events.writeStream.foreachBatch(lambda batch, batch_id: apply_batch(batch, batch_id, target, parts)).option("checkpointLocation", checkpoint).start()


_PARTS, _FROM, ROW_BYTES, LEAST_BYTES = "parts", "_from", 64, 4096


@dataclass(frozen=True)
class _Run:
    """Rows of one part that batches ``first`` to ``last`` have touched."""

    first: int
    last: int
    path: str
    size: int


def _folder(spark: SparkSession, target: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def _runs(spark: SparkSession, target: str, batch_id: int) -> tuple[dict[int, list[_Run]], list[str]]:
    """The runs of every part that count before a batch, newest first, and the folders that nothing needs any more."""
    (fs, path), inside = _folder(spark, target), spark._jvm.org.apache.hadoop.fs.Path
    found: dict[int, list[_Run]] = {}
    folders: dict[str, set[str]] = {}
    for version in fs.listStatus(path) if fs.exists(path) else ():
        name, where = version.getPath().getName(), version.getPath().toString()
        if name.startswith("v=") and int(name[2:]) < batch_id and fs.exists(inside(version.getPath(), "_SUCCESS")):
            folders[where] = set()
            for part in fs.listStatus(version.getPath()):
                if part.getPath().getName().startswith(f"{_PART}="):
                    for run in fs.listStatus(part.getPath()):
                        of = int(part.getPath().getName()[len(_PART) + 1 :])
                        found.setdefault(of, []).append(_Run(int(run.getPath().getName()[len(_FROM) + 1 :]), int(name[2:]), run.getPath().toString(), max(LEAST_BYTES, fs.getContentSummary(run.getPath()).getLength())))
                        folders[where].add(run.getPath().toString())
    valid: dict[int, list[_Run]] = {}
    for p, runs in found.items():
        least = 1 << 62
        for run in sorted(runs, key=lambda r: -r.last):
            if run.last < least:
                valid.setdefault(p, []).append(run)
                least = run.first
    kept = {r.path for runs in valid.values() for r in runs}
    stale = []  # whole versions, or runs of them
    for where, runs in folders.items():
        stale += sorted(runs - kept) if runs & kept else [where]
    return valid, stale


def read_target(spark: SparkSession, target: str, schema: str = "entity string, row_id string, new_version long") -> DataFrame:
    """The newest version of every row of the target."""
    paths = [run.path for runs in _runs(spark, target, 1 << 62)[0].values() for run in runs]
    return latest_version(spark.read.schema(schema).parquet(*paths)) if paths else spark.createDataFrame([], schema)


def debounce(events: DataFrame, entity: str, at: str, gap_ms: int, id_col: str, block_gaps: int = 256) -> DataFrame:
    """Events kept: per entity, those at least ``gap_ms`` after the last one kept (the first is kept).

    The rule is sequential within an entity, but a task never sees an entity whole. Time is cut into blocks
    of ``block_gaps`` gaps. Each block works out its last kept time as a step function of the time kept
    before it (chains from different starts soon meet, so it has few steps); one pass over an entity's
    step functions gives every block the time it starts from; then the blocks mark their events. Of events of
    one millisecond the least id counts.
    """
    if gap_ms <= 0:
        return events
    first = events.groupBy(F.col(entity).alias("_entity"), F.unix_millis(at).alias("_ms")).agg(F.min(id_col).alias("_id"))
    first = materialise(first.withColumn("_block", F.floor(F.col("_ms") / (gap_ms * block_gaps)).cast("long")), "debounce")
    kinds = dict(first.dtypes)

    def steps(rows: pd.DataFrame) -> pd.DataFrame:
        ms = np.sort(rows["_ms"].to_numpy())
        following = np.searchsorted(ms, ms + gap_ms)
        last = np.where(following < len(ms), following, np.arange(len(ms)))
        for _ in range(int(block_gaps).bit_length() + 1):
            last = last[last]
        # whatever was kept before the block, its first event to keep starts in the block's first gap or is the next one
        n = min(len(ms), int(np.searchsorted(ms, rows["_block"].iloc[0] * gap_ms * block_gaps + gap_ms)) + 1)
        ends = np.append(np.flatnonzero(np.diff(last[:n])), n - 1)
        return pd.DataFrame({"_entity": rows["_entity"].iloc[0], "_block": rows["_block"].iloc[0], "upto": ms[ends], "kept": ms[last[ends]]})

    def starts(rows: pd.DataFrame) -> pd.DataFrame:
        rows, out, before = rows.sort_values(["_block", "upto"]), [], None
        for block, part in rows.groupby("_block", sort=True):
            out.append((block, before))
            k = 0 if before is None else int(np.searchsorted(part["upto"].to_numpy(), before + gap_ms))
            before = int(part["kept"].iloc[k]) if k < len(part) else before
        return pd.DataFrame({"_entity": rows["_entity"].iloc[0], "_block": [b for b, _ in out], "before": pd.array([x for _, x in out], dtype="Int64")})

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_ms")
        ms, before, kept = rows["_ms"].to_numpy(), rows["before"].iloc[0], []
        k = 0 if pd.isna(before) else int(np.searchsorted(ms, int(before) + gap_ms))
        while k < len(ms):
            kept.append(k)
            k = int(np.searchsorted(ms, ms[k] + gap_ms))
        return rows.iloc[kept][["_id"]]

    key = f"_entity {kinds['_entity']}, _block long"
    functions = first.groupBy("_entity", "_block").applyInPandas(steps, f"{key}, upto long, kept long")
    entering = functions.groupBy("_entity").applyInPandas(starts, f"{key}, before long")
    placed = first.join(entering.withColumnsRenamed({"_entity": "_e", "_block": "_b"}), F.col("_entity").eqNullSafe(F.col("_e")) & (F.col("_block") == F.col("_b")))
    chosen = placed.select(*first.columns, "before").groupBy("_entity", "_block").applyInPandas(keep, f"_id {kinds['_id']}")
    return events.join(chosen, events[id_col] == chosen["_id"], "left_semi")


_BLOCK = T.StructType([T.StructField("block", T.LongType()), T.StructField("part", T.LongType())])
_EVENTS = T.StructType([T.StructField("events", T.BinaryType())])
BLOCK_MS, HELD_ROWS = 3_600_000, 100_000


def _firsts(events: np.ndarray) -> np.ndarray:
    """Rows (ms, id, until) in order of time, the least id of each millisecond."""
    events = events[np.lexsort((events[:, 1], events[:, 0]))]
    return events[np.append(True, np.diff(events[:, 0]) > 0)] if len(events) else events


class _Live(StatefulProcessor):
    """Lets an event through if the last one let through before it is over by then.

    State of a key: until when its last event holds, and the events that wait. An event waits until the watermark has passed it, so
    whatever order events arrive in, they are judged in order of time; of one millisecond the least id counts. An event that is over when
    it happens holds nothing and is not let through. Events wait in blocks of ``BLOCK_MS``, each in parts as they came, and are judged block
    by block: a task holds the firsts of a block's milliseconds (86 MB at most) and ``HELD_ROWS`` new rows, however many wait.
    One timer a key: at the first waiting event, or, if none waits, at the end of what holds, when the state goes.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", T.StructType([T.StructField("ms", T.LongType())]))
        self.waiting = handle.getMapState("waiting", _BLOCK, _EVENTS)

    def _wake(self, ms: int) -> None:
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(ms)

    def _blocks(self) -> dict[int, list[int]]:
        """The parts of each block, in order of time."""
        found: dict[int, list[int]] = {}
        for block, part in sorted(map(tuple, self.waiting.keys())):
            found.setdefault(block, []).append(part)
        return found

    def _take(self, block: int, parts: list[int]) -> np.ndarray:
        events = np.empty((0, 3), np.int64)
        for part in parts:
            more = np.frombuffer(self.waiting.getValue((block, part))[0], np.int64).reshape(-1, 3)
            events = _firsts(np.concatenate([events, more]))
            self.waiting.removeKey((block, part))
        return events

    def _put(self, block: int, part: int, events: np.ndarray) -> None:
        self.waiting.updateValue((block, part), (events.tobytes(),))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = {block: parts[-1] for block, parts in self._blocks().items()}
        # with events that wait already, the timer is that of the first of them
        wakes = list(self.handle.listTimers()) if known else []
        held: list[np.ndarray] = []

        def store() -> None:
            events = _firsts(np.concatenate(held))
            held.clear()
            blocks = events[:, 0] // BLOCK_MS
            for some in np.split(events, np.flatnonzero(np.diff(blocks)) + 1):
                block = int(some[0, 0] // BLOCK_MS)
                known[block] = known.get(block, -1) + 1
                self._put(block, known[block], some)
            wakes.append(int(events[0, 0]) + 1)

        for part in rows:
            events = part[["ms", "id", "until"]].to_numpy(np.int64)
            events = events[events[:, 2] > events[:, 0]]
            if len(events):
                held.append(events)
            if sum(map(len, held)) >= HELD_ROWS:
                store()
        if held:
            store()
        if wakes:
            self._wake(min(wakes))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        until = self.until.get()[0] if self.until.exists() else None
        wake = None
        for block, parts in self._blocks().items():
            first = block * BLOCK_MS
            if first >= now:
                events = self._take(block, parts)
                self._put(block, 0, events)
                wake = int(events[0, 0]) + 1
                break
            if until is not None and until >= first + BLOCK_MS and now >= first + BLOCK_MS:
                for part in parts:
                    self.waiting.removeKey((block, part))
                continue
            events = self._take(block, parts)
            n, kept = int(np.searchsorted(events[:, 0], now)), []  # events of the watermark's own millisecond may still come
            k = 0 if until is None else int(np.searchsorted(events[:n, 0], until))
            while k < n:
                kept.append(k)
                until = int(events[k, 2])
                k = max(k + 1, int(np.searchsorted(events[:n, 0], until)))
            if kept:
                yield pd.DataFrame({"entity": key[0], "id": events[kept, 1], "ms": events[kept, 0]})
            if n < len(events):
                self._put(block, 0, events[n:])
                wake = int(events[n, 0]) + 1
                break
        if until is None or until <= now:
            self.until.clear()
        else:
            self.until.update((until,))
        if wake is not None:
            self._wake(wake)
        elif until is not None and until > now:
            self._wake(until)

    def close(self) -> None:
        pass


def _live(events: DataFrame, entity: Column, at: str, until: Column, id_col: str, late: str) -> DataFrame:
    marked = events.withWatermark(at, late)
    rows = marked.select(entity.cast("string").alias("entity"), F.col(id_col).cast("long").alias("id"), F.unix_millis(at).alias("ms"), until.alias("until"), F.col(at).alias("_at"))
    return rows.groupBy("entity").transformWithStateInPandas(_Live(), "entity string, id long, ms long", "Append", "EventTime")


def debounce_stream(events: DataFrame, entity: str, at: str, gap_ms: int, id_col: str, late: str = "0 seconds") -> DataFrame:
    """(entity, id, ms) of the events that ``debounce`` keeps, whatever order they arrive in within ``late`` of event time.

    An event is decided when the watermark has passed it; events that come later than that are dropped. To close a finite stream, end
    it with an event that is ``late`` past all others: that one itself stays undecided. Rows without a time are ignored. The session
    needs the RocksDB state store (``ROCKSDB``). The events of one entity are decided in one task; those that wait are its state.
    """
    return _live(events.filter(F.col(at).isNotNull()), F.col(entity), at, F.unix_millis(at) + max(1, gap_ms), id_col, late)


def live_stream(events: DataFrame, keys: list[str], at: str, expires: str, id_col: str, late: str = "0 seconds") -> DataFrame:
    """(entity, id, ms) of the events that find their key free: each event let through holds it until its own ``expires``.

    Rows of any mix of lifetimes may share a stream. A row without an expiry holds its key for ever, a row that is over when it happens is
    not let through. A key's state goes when the watermark passes the expiry of its last event. Order, lateness and the end
    of a finite stream are as in ``debounce_stream``; ``entity`` is the key as JSON.
    """
    until = F.coalesce(F.unix_millis(expires), F.lit((1 << 62) - 1))
    return _live(events.filter(F.col(at).isNotNull()), F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), at, until, id_col, late)


def unexpired_stream(events: DataFrame, at: str, ttl: str, keys: list[str]) -> DataFrame:
    """The first event of each key within ``ttl`` of event time; rows later than the watermark are expired and dropped.

    The state of a key goes when the watermark passes its time by ``ttl``.
    """
    return events.withWatermark(at, ttl).dropDuplicatesWithinWatermark(keys)


def counted(events: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The rows as they are, and a count that is there once an action on them is done."""
    seen = Observation(name)
    return events.observe(seen, F.count(F.lit(1)).alias("processed")), seen
