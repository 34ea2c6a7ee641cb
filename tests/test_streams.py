"""Streams: the ordered log, events that come late, lifetimes of their own, a target in runs."""

import datetime
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from entityframes.streaming import ordered_log, streams

EVENTS = "id long, e string, at timestamp, expires timestamp"
CHANGES = "entity string, row_id string, new_version long"
T0 = datetime.datetime(2024, 1, 1)


def second(n):
    return T0 + datetime.timedelta(seconds=n)


@pytest.fixture(scope="module")
def own(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    session.conf.set("spark.sql.shuffle.partitions", "2")
    return session


def logged(session, path, batches):
    """Batches of rows as a log, one append each, and the stream that reads one append after the other."""
    sizes = {len(b) for b in batches}
    for b in batches:
        ordered_log.append_log(session.createDataFrame(b, EVENTS).withColumn("n", F.monotonically_increasing_id()).coalesce(1).drop("n"), path, [F.lit(1)], 1)
    return ordered_log.read_log(session, path, session.createDataFrame([], EVENTS).schema, max(sizes))


def run(stream, folder):
    """The output of a stream and the state rows after each of its batches."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").start()
    ordered_log.drain(query)
    rows = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out"), rows


def shuffled(rows, late, size, seed):
    """``rows`` (second first) in an order in which none comes more than ``late`` seconds after a later one, in batches, and a last one that closes them."""
    rng = random.Random(seed)
    out = sorted(rows, key=lambda r: r[0] + rng.random() * late)
    events = [(i, e, second(at), None if ttl is None else second(at + ttl)) for at, i, e, ttl in out]
    events += [(-1, None, second(10**6), None)] * (size - len(events) % size)
    return [events[k : k + size] for k in range(0, len(events), size)]


def test_late_events_are_debounced_in_their_place(spark, own, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randrange(2000), k, rng.choice("xy"), 0) for k in range(240)]
    stream = logged(own, str(tmp_path / "log"), shuffled(rows, 300, 100, 2))
    out, _ = run(streams.debounce_stream(stream, "e", "at", 40_000, "id", "400 seconds"), tmp_path)
    batch = spark.createDataFrame([(i, e, second(at), None) for at, i, e, _ in rows], EVENTS)
    assert {r["id"] for r in out.collect()} == {r["id"] for r in streams.debounce(batch, "e", "at", 40_000, "id").collect()}


def test_every_row_lives_as_long_as_it_says(own, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(1500), k, rng.choice("xyz"), rng.choice([0, 5, 60, 300])) for k in range(260)]
    stream = logged(own, str(tmp_path / "log"), shuffled(rows, 200, 90, 4))
    out, state = run(streams.live_stream(stream, ["e"], "at", "expires", "id", "300 seconds"), tmp_path)
    want, until = set(), {}
    for at, i, e, ttl in sorted(rows):
        if ttl and at >= until.get(e, -1):
            want.add(i)
            until[e] = at + ttl
    assert {r["id"] for r in out.collect()} == want
    assert max(state) > 3 and state[-1] <= 4  # what waited and what held has gone; the closing event waits


def test_an_event_without_end_holds_its_key_and_late_ones_are_dropped(own, tmp_path):
    far = second(10**6)
    batches = [[(1, "x", second(10), None), (2, "y", second(50), second(60))], [(3, "x", second(5000), second(5001)), (4, "y", second(6000), second(6001))],
               [(5, "y", second(55), second(9999)), (6, "y", second(7000), second(7001))], [(-1, None, far, None), (-2, None, far, None)]]
    out, _ = run(streams.live_stream(logged(own, str(tmp_path / "log"), batches), ["e"], "at", "expires", "id"), tmp_path)
    assert {r["id"] for r in out.collect()} == {1, 2, 4, 6}


def test_a_hot_key_is_judged_in_bounded_blocks(own, tmp_path, monkeypatch):
    """All rows have one key, many of them one millisecond; what waits is stored in blocks, never as one list of rows."""
    monkeypatch.setattr(streams, "BLOCK_MS", 60_000)
    monkeypatch.setattr(streams, "HELD_ROWS", 50)
    rng = random.Random(5)
    rows = [(rng.randrange(1200), k, "x", rng.choice([0, 5, 400])) for k in range(600)]
    out, state = run(streams.live_stream(logged(own, str(tmp_path / "log"), shuffled(rows, 300, 250, 6)), ["e"], "at", "expires", "id", "400 seconds"), tmp_path)
    want, until = set(), -1
    for at, i, _, ttl in sorted(rows):
        if ttl and at >= until:
            want.add(i)
            until = at + ttl
    assert {r["id"] for r in out.collect()} == want
    assert max(state) < 120 and state[-1] <= 4  # 250 rows a batch, a twentieth of a block's rows in each part


def test_no_key_waits_as_rows_of_its_own(own, tmp_path):
    """Thousands of waiting events of one key and hour are one row of state, in order of time and the first id of each millisecond."""
    first = streams._firsts(np.array([[5, 9, 6], [3, 2, 4], [5, 1, 8], [3, 7, 9]]))
    assert first.tolist() == [[3, 2, 4], [5, 1, 8]]
    rows = [(k % 900, k, "x", 7) for k in range(3000)]
    _, state = run(streams.live_stream(logged(own, str(tmp_path / "log"), shuffled(rows, 900, 1010, 8)), ["e"], "at", "expires", "id", "1000 seconds"), tmp_path)
    assert max(state) <= 10


def test_log_is_read_in_order_and_goes_on_at_its_offset(spark, tmp_path, sf):
    events, path = spark.read.parquet(f"{sf}/events.parquet"), str(tmp_path / "log")
    assert ordered_log.append_log(events, path, ["ts", "event_id"], 3) == 1000
    seen = []

    def note(batch, batch_id):
        seen.append([r["event_id"] for r in batch.collect()])

    def go(rows):
        stream = ordered_log.read_log(spark, path, events.schema, rows)
        ordered_log.drain(stream.writeStream.foreachBatch(note).option("checkpointLocation", str(tmp_path / "state")).start())

    go(300)
    order = [r["event_id"] for r in events.orderBy("ts", "event_id").collect()]
    assert [x for b in seen for x in b] == order and [len(b) for b in seen] == [300, 300, 300, 100]
    # what is not published is not there; what is appended comes next, from the very next row on
    events.write.parquet(f"{path}/data/torn")
    (tmp_path / "log" / "log" / "99").mkdir()
    seen.clear()
    go(300)
    assert [x for b in seen for x in b] == []
    assert ordered_log.append_log(events.filter("event_id < 70"), path, [F.desc("event_id")], 2) == 1070
    go(50)
    assert [x for b in seen for x in b] == list(range(69, -1, -1)) and [len(b) for b in seen] == [50, 20]


def test_split_files_lose_no_row(spark, tmp_path, sf, monkeypatch):
    monkeypatch.setattr(ordered_log, "SPLIT_ROWS", 7)
    events, path = spark.read.parquet(f"{sf}/events.parquet").limit(100), str(tmp_path / "log")
    ordered_log.append_log(events, path, ["event_id"], 2)
    reader = ordered_log._Reader(path, events.schema, 0)
    rows = [x for part in reader.partitions({"next": 13}, {"next": 88}) for b in reader.read(part) for x in b.column("event_id").to_pylist()]
    assert rows == [r["event_id"] for r in events.orderBy("event_id").collect()][13:88]
    assert reader.partitions({"next": 5}, {"next": 5}) == []


def changes(spark, rows):
    return spark.createDataFrame(rows, CHANGES)


def files(folder):
    return sum(1 for _ in Path(folder).rglob("*.parquet"))


def test_target_keeps_its_parts(spark, tmp_path):
    target = str(tmp_path / "t")
    streams.apply_batch(changes(spark, [("a", str(k), 1) for k in range(50)]), 0, target, 8)
    streams.apply_batch(changes(spark, [("a", str(k), 2) for k in range(10)]), 1, target)
    with pytest.raises(ValueError):
        streams.apply_batch(changes(spark, [("a", "1", 3)]), 2, target, 4)
    assert sorted((int(r["row_id"]), r["new_version"]) for r in streams.read_target(spark, target).collect()) == [(k, 2 if k < 10 else 1) for k in range(50)]


def test_many_batches_leave_few_folders_and_write_little(spark, tmp_path):
    target, rng, want = str(tmp_path / "t"), random.Random(5), {}
    first = [("e", str(k), 0) for k in range(20_000)]
    want |= {(e, r): v for e, r, v in first}
    streams.apply_batch(changes(spark, first).coalesce(1), 0, target, 2)
    base = sum(p.stat().st_size for p in Path(target).rglob("*.parquet"))
    written = []
    for b in range(1, 51):
        rows = [("e", str(rng.randrange(25_000)), b) for _ in range(20)]
        want |= {(e, r): v for e, r, v in rows}
        streams.apply_batch(changes(spark, rows).coalesce(1), b, target)
        written.append(sum(p.stat().st_size for p in Path(f"{target}/v={b}").rglob("*.parquet")))
        assert files(target) <= 2 * 8
    assert sum(written) < 50 * base / 10 and sorted(written)[25] < base / 8  # rewriting what a batch touches would be 50 times the base
    assert {(r["entity"], r["row_id"]): r["new_version"] for r in streams.read_target(spark, target).collect()} == want
    assert len(list(Path(target).glob("v=*"))) <= 10


def test_replayed_batch_changes_nothing(spark, tmp_path):
    target = str(tmp_path / "t")
    batches = [[("a", str(k % 7), b * 10 + k) for k in range(5)] for b in range(6)]
    for b, rows in enumerate(batches):
        for _ in range(2 if b in (2, 5) else 1):  # as after a failure between the write and the commit
            streams.apply_batch(changes(spark, rows), b, target, 3)
    streams.apply_batch(changes(spark, []), 6, target)
    want = {}
    for e, r, v in (x for rows in batches for x in rows):
        want[r] = max(v, want.get(r, 0))
    assert {r["row_id"]: r["new_version"] for r in streams.read_target(spark, target).collect()} == want
