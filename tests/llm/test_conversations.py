"""Conversation repair: the integers against a plain search, the spread form against the local one, odd rows."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from entityframes.llm import conversations, queries

ROWS = "conv_id long, turn long, role string, text string"
NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def searched(rows, most):
    """The least (cost, audit) of all edits of (initial, fault) rows that cost ``most`` or less."""
    found = []

    def go(i, cost, audit, roles, inserts):
        if cost > most or not re.fullmatch("s?(ua)*u?", roles):
            return
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", roles):
                found.append((cost, audit))
        else:
            initial, fault = rows[i]
            go(i + 1, cost + 4, audit + "D", roles, 0)
            if fault not in ("blank", "duplicate"):
                more = 3 if fault else 0
                go(i + 1, cost + more, audit + "K", roles + initial, 0)
                for role in "ua":
                    go(i + 1, cost + 3 + more, audit + "R", roles + role, 0)
        if inserts < 3:
            for role in "ua":
                go(i, cost + 3, audit + "I", roles + role, inserts + 1)

    go(0, 0, "", "", 0)
    return min(found)


def test_least_integer_is_the_cheapest_least_audit():
    rng = random.Random(1)
    for _ in range(250):
        rows = [(rng.choice("suuaax"), rng.choice([None, None, None, "blank", "duplicate", "truncated"])) for _ in range(rng.randrange(6))]
        cost, audit = conversations.best(rows)
        assert (cost, audit) == searched(rows, cost), rows


def expected(rows):
    """The contract over (conv_id, turn, role, text) rows, damage included."""
    out = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        held = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    for conv, held in out.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        out[conv] = conversations.repair(held)
    return out


def results(df):
    rows = df.collect()
    assert len(rows) == len({r["conv_id"] for r in rows})
    return {r["conv_id"]: {name: r[name] for name in NAMES} for r in rows}


def made(n_rows, conv, seed):
    rng = random.Random(seed)
    texts = ["A whole sentence.", "Cut off", "Why? ", "", " \n", "Said again.", "Long! " * 40]
    return [(conv, None if rng.random() < 0.02 else rng.randrange(n_rows), rng.choice(["user", "assistant", "system", "tool", None, ""]), rng.choice([*texts, None, f"Number {rng.random()}."])) for _ in range(n_rows)]


def test_whole_conversations_and_those_over_many_tasks(spark):
    rows = made(3000, 7, 1) + made(900, None, 2) + [r for c in range(100, 160) for r in made(c % 9, c, c)]
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    want = expected(rows)
    assert want[7]["cost"] > 0 and len(want[7]["audit"]) > 2000
    assert results(conversations.repaired(df)) == want


def test_long_ones_inside_a_task_are_spread(spark, monkeypatch):
    rows = [r for c in range(40) for r in made(30, c, c)]
    want = expected(rows)
    monkeypatch.setattr(conversations, "MOST_ROWS", 10)
    monkeypatch.setattr(conversations, "SEGMENT_BITS", 2)
    assert results(conversations.repaired(spark.createDataFrame(rows, ROWS))) == want


def test_odd_rows(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    rows = [(1, None, None, None), (2, 1, "user", "Same."), (2, 1, "user", "Same."), (2, 1, "user", "Same."), (3, 4, "assistant", "x" * 200_000), (4, 0, "user", "é́ \U0001f600!"), (5, gone, "user", "Lost.")]
    df = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit("mine") for c in ("conv", "ord", "cost", "audit", "copy", "c0", "lost")})
    got = results(conversations.repaired(df))
    assert got == expected(rows)
    assert got[5] == dict.fromkeys(NAMES[:6], 0) | {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    assert conversations.repaired(df.limit(0)).count() == 0
    as_given = conversations.repaired(df.filter("conv_id = 2"), damage=conversations.as_they_are).first()
    assert (as_given["duplicate"], as_given["audit"], as_given["cost"]) == (2, "KDDI", 11)


def test_sql_and_operator_agree_on_odd_rows(spark, tmp_path):
    rows = made(60, 1, 5) + made(40, None, 6) + [r for c in range(20, 60) for r in made(c % 7, c, c)] + [(9, 0, "user", None)]
    spark.createDataFrame(rows, ROWS).write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    found = db.execute(queries.ORACLE["op11_conversation_repair"])
    names = [c[0] for c in found.description]
    want = {r["conv_id"]: {name: r[name] for name in NAMES} for r in (dict(zip(names, row, strict=True)) for row in found.fetchall())}
    assert results(queries.QUERIES["op11_conversation_repair"](spark, str(tmp_path))) == want == expected(rows)


@pytest.mark.parametrize("audit, want", [("KIK", ["system:", "user:", "assistant:x"]), ("DRI", ["user:x", "assistant:"])])
def test_lines(audit, want):
    assert conversations.lines([("system", ""), ("assistant", "x")], audit)[0] == want
