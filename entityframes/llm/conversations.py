"""Repair of the turn structure of conversations by cheapest edits.

The roles of a repaired conversation, by their initials, are ``(s?(ua)+)?``. Edits: Keep (0), Rerole to user or assistant
(3), Delete (4; required for blank rows and repeats), Insert an empty user or assistant row (3); a truncated row that is
not deleted costs 3 more. Of the cheapest edits the one with the ASCII-least audit (D, I, K, R in order) counts.

Weights. The nodes of the graph are (rows consumed, letters written, state of the pattern). An edge that writes letter c
as the p-th one at a cost of w weighs ``w << 3 * width | code(c) << 3 * (width - 1 - p)``: the high digits of a path's
sum are its cost, the low octal digits its audit from the left, with zeros after the end, which sort before every letter.
The least integer is therefore the cheapest path with the least audit; nothing else is compared. Of the nodes that differ
only in the letters written one is enough: of two paths of equal cost over the same rows neither audit begins the
other (the longer would have paid for its inserts), so what follows changes neither's place.

Scale. Rows are sorted by ranges of (conversation, turn, ...), so a conversation of any length is spread over tasks. One
that lies inside a task is repaired there. What crosses a border, or has more than ``MOST_ROWS`` rows or
``MOST_BYTES`` of text, is cut into segments of at most ``SEGMENT`` rows: each is solved from every state to every state,
the segments of a conversation are joined by the same integers, and the texts are hashed in order as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..storage import scope
from .common import materialise

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LETTERS = " DIKR"  # the code of a letter is its place
SEGMENT_BITS, MOST_ROWS, MOST_BYTES = 9, 4096, 16 << 20
SEGMENT = 1 << SEGMENT_BITS
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
ENDS = (START, ASSISTANT)
LEGAL = ("su", "ua", "au")
FAULTS = ("blank", "duplicate", "truncated")
_WHITE = " \t\n\v\f\r"
_EMPTY_HASH = hashlib.sha256(b"").hexdigest()

Row = tuple[str, str | None]  # (initial of the role, first fault)
Paths = dict[int, tuple[int, int]]  # state: (weight, letters written)


def add(path: tuple[int, int], cost: int, letters: str, width: int) -> tuple[int, int]:
    """``path`` with the weight of an edge that writes ``letters``."""
    weight, p = path
    digits = int("".join(str(LETTERS.index(c)) for c in letters) or "0", 8)
    return weight + (cost << 3 * width) + (digits << 3 * (width - p - len(letters))), p + len(letters)


def _edges(width: int):
    """The single-letter edges; their low digits are looked up."""

    def edge(paths: Paths, state: int, path: tuple[int, int], cost: int, code: int) -> None:
        weight = path[0] + (cost << 3 * width) + (code << 3 * (width - 1 - path[1]))
        if state not in paths or weight < paths[state][0]:
            paths[state] = weight, path[1] + 1

    return edge


def solve(rows: list[Row], entry: int = START) -> tuple[Paths, int]:
    """The least path from ``entry`` over all rows to every state, inserts after the last row left out; and the width."""
    width = 3 * len(rows) + 2
    edge = _edges(width)
    at: Paths = {entry: (0, 0)}
    for initial, fault in rows:
        at = inserted(at, width)
        after: Paths = {}
        for state, path in at.items():
            edge(after, state, path, DELETE, 1)
            if fault in ("blank", "duplicate"):
                continue
            more = TRUNCATED if fault else 0
            if (to := NEXT.get((initial, state))) is not None:
                edge(after, to, path, more, 3)
            for role in "ua":
                if (to := NEXT.get((role, state))) is not None:
                    edge(after, to, path, REROLE + more, 4)
        at = after
    return at, width


def inserted(at: Paths, width: int) -> Paths:
    """``at`` and what inserts lead to; a third insert in one place returns to a state that was there already."""
    edge, out = _edges(width), dict(at)
    for _ in range(2):
        for state, path in list(out.items()):
            for role in "ua":
                if (to := NEXT.get((role, state))) is not None:
                    edge(out, to, path, INSERT, 2)
    return out


def read(path: tuple[int, int], width: int) -> tuple[int, str]:
    """(cost, audit) of a weight."""
    weight, p = path
    digits = (weight & ((1 << 3 * width) - 1)) >> 3 * (width - p)
    return weight >> 3 * width, "".join(LETTERS[int(c)] for c in f"{digits:o}") if p else ""


def best(rows: list[Row]) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair."""
    at, width = solve(rows)
    at = inserted(at, width)
    weight = min(at[state] for state in ENDS if state in at)
    return read(weight, width)


def lines(rows: list[tuple[str, str]], audit: str, state: int = START) -> tuple[list[str], int]:
    """The repaired ``role:text`` lines of (role, text) rows, and the state after them."""
    out, place = [], iter(rows)
    for letter in audit:
        role, text = (None, "") if letter == "I" else next(place)
        if letter == "D":
            continue
        if letter == "K":
            state = NEXT[role[:1], state]
        else:
            state = ASSISTANT if state == USER else USER
            role = "assistant" if state == ASSISTANT else "user"
        out.append(f"{role}:{text}")
    return out, state


def fault_of(role: str, text: str, seen: set | None) -> str | None:
    """The first fault of a row; ``seen`` holds the digests of the rows before (None: another step looks for repeats)."""
    bare = text.strip(_WHITE)
    key = hashlib.sha256(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")).digest()
    again = seen is not None and key in seen
    if seen is not None:
        seen.add(key)
    return "blank" if not bare else "duplicate" if again else None if bare[-1] in ".!?" else "truncated"


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def repair(rows: list[tuple[int | None, str, str]]) -> dict:
    """The results of one conversation of (turn, role, text) rows in order."""
    seen: set = set()
    marked = [(role[:1], fault_of(role, text, seen)) for _, role, text in rows]
    cost, audit = best(marked)
    out, _ = lines([(role, text) for _, role, text in rows], audit)
    turns = {turn for turn, _, _ in rows if turn is not None}
    faults = [fault for _, fault in marked]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        **{name: faults.count(name) for name in FAULTS},
        "illegal": illegal_pairs([initial for initial, _ in marked]),
        "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(out).encode("utf-8", "surrogatepass")).hexdigest(),
    }


_RESULT = {"gaps": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(), "cost": pa.int64(), "audit": pa.string(), "repaired_sha256": pa.string()}


def _folded(schema: pa.Schema):
    """Sorted rows of a task: results of the conversations that lie inside it, the rows of the others in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        held: list[tuple] = []
        key, started, spills, size, place = None, False, True, 0, TaskContext.get().partitionId() << 40

        def pass_on() -> None:
            nonlocal place, size
            for k, row in enumerate(held):
                out.append(dict(zip(("conv", "turn", "role", "text", "lost"), row, strict=True)) | {"ord": place + k})
            place, size = place + len(held), 0
            held.clear()

        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if started and row[0] != key:
                    if spills:
                        pass_on()
                    else:
                        out.append({"conv": key} | repair([r[1:4] for r in held if not r[4]]))
                        held.clear()
                    spills, size = False, 0
                key, started = row[0], True
                held.append(row)
                size += len(row[3])
                if spills or len(held) > MOST_ROWS or size > MOST_BYTES:
                    spills = True  # the first conversation may have begun in the task before
                    pass_on()
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out.clear()
        pass_on()  # the last one may go on in the next task
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _solved(rows: pd.DataFrame) -> pd.DataFrame:
    """One segment: its faults, and the least path between every two states."""
    rows = rows.sort_values("ord")
    faults = [fault_of(role, text, None) for role, text in zip(rows["role"], rows["text"], strict=True)]
    faults = ["duplicate" if again and fault != "blank" else fault for again, fault in zip(rows["again"], faults, strict=True)]
    initials, paths = [role[:1] for role in rows["role"]], []
    for entry in range(4):
        at, width = solve(list(zip(initials, faults, strict=True)), entry)
        for state, path in at.items():
            cost, audit = read(path, width)
            paths.append({"entry": entry, "state": state, "cost": cost, "audit": audit})
    head = rows[["conv", "segment"]].iloc[:1].reset_index(drop=True)
    return head.assign(**{f: faults.count(f) for f in FAULTS}, illegal=illegal_pairs(initials), first=initials[0], last=initials[-1], paths=[paths])


def _joined(segments: pd.DataFrame) -> pd.DataFrame:
    """The segments of a conversation, each with the state it is entered in and its part of the least path; sums on the last one."""
    segments = segments.sort_values("segment").reset_index(drop=True)
    width = sum(max(len(p["audit"]) for p in paths) for paths in segments["paths"]) + 2
    at: dict[int, tuple] = {START: ((0, 0), None)}  # state: (path, chain of (entry, audit))
    for paths in segments["paths"]:
        after: dict[int, tuple] = {}
        for p in paths:
            if p["entry"] in at:
                before, chain = at[p["entry"]]
                path = add(before, p["cost"], p["audit"], width)
                if p["state"] not in after or path[0] < after[p["state"]][0][0]:
                    after[p["state"]] = path, (chain, p["entry"], p["audit"])
        at = after
    # every way to end: a state after the last row, and the inserts that lead from there to an accepted one
    ends = [(closed[end], chain) for state, (path, chain) in at.items() for closed in (inserted({state: path}, width),) for end in ENDS if end in closed]
    weight, chain = min(ends, key=lambda x: x[0])
    cost, audit = read(weight, width)
    parts: list[tuple[int, str]] = []
    while chain:
        chain, entry, part = chain
        parts.append((entry, part))
    parts.reverse()
    entries, pieces = [e for e, _ in parts], [p for _, p in parts]
    pieces[-1] += audit[sum(map(len, pieces)) :]
    initials = zip(segments["last"], segments["first"].iloc[1:], strict=False)
    last = segments.index == len(segments) - 1
    sums = {f: segments[f].sum() for f in FAULTS} | {"illegal": segments["illegal"].sum() + sum(a + b not in LEGAL for a, b in initials), "cost": cost}
    out = segments[["conv", "segment"]].assign(entry=entries, piece=pieces, audit=[audit if x else None for x in last])
    return out.assign(**{name: [int(n) if x else 0 for x in last] for name, n in sums.items()})


def _lined(rows: pd.DataFrame) -> pd.DataFrame:
    """The repaired lines of one segment, each ended by a line feed."""
    rows = rows.sort_values("ord")
    out, _ = lines(list(zip(rows["role"], rows["text"], strict=True)), rows["piece"].iloc[0], int(rows["entry"].iloc[0]))
    data = "".join(f"{line}\n" for line in out).encode("utf-8", "surrogatepass")
    return rows[["conv", "segment"]].iloc[:1].reset_index(drop=True).assign(data=[data])


def _hashed(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(conv, repaired_sha256) of parts sorted by conversation and segment; one part is held at a time."""
        key, started, digest, held = None, False, hashlib.sha256(), b""
        for batch in batches:
            out = []
            for conv, _, data in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if started and conv != key:
                    digest.update(held[:-1])
                    out.append({"conv": key, "repaired_sha256": digest.hexdigest()})
                    digest, held = hashlib.sha256(), b""
                key, started = conv, True
                if data:
                    digest.update(held)
                    held = data
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if started:
            digest.update(held[:-1])
            yield pa.RecordBatch.from_pylist([{"conv": key, "repaired_sha256": digest.hexdigest()}], schema=schema)

    return run


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv, turn, role, text) after the damage that crc32(conv:turn) % 20 names; dropped rows stay with lost = true.

    A null role or text becomes one space, and so does a null conversation or turn in the checksum.
    """
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(part("conv"), F.lit(":"), part("turn")).cast("binary")), F.lit(20))
    rows = rows.select("conv", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("kind"), F.monotonically_increasing_id().alias("uid"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("lost"), "uid", F.explode(copies).alias("copy"))


def as_they_are(rows: DataFrame) -> DataFrame:
    """``rows`` without any damage; null roles and texts become one space."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return rows.select("conv", "turn", *filled, F.lit(False).alias("lost"), F.monotonically_increasing_id().alias("uid"), F.lit(0).alias("copy"))


def _spread(rows: DataFrame, conv_type: str) -> DataFrame:
    """Results of conversations whose rows (conv, ord, turn, role, text) may be in any number of tasks."""
    rows = rows.withColumn("segment", F.shiftright("ord", SEGMENT_BITS))
    here = rows.filter("not lost").withColumn("digest", F.sha2("text", 256))
    met = here.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min("ord").alias("met"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    seen = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    marked = here.join(met, seen, "left").select("conv", "ord", "segment", "role", "text", F.coalesce(F.col("ord") > F.col("met"), F.lit(False)).alias("again"))
    counts = ", ".join(f"{name} long" for name in (*FAULTS, "illegal"))
    solved = marked.groupBy("conv", "segment").applyInPandas(
        _solved, f"conv {conv_type}, segment long, {counts}, first string, last string, paths array<struct<entry: int, state: int, cost: long, audit: string>>")
    joined = materialise(solved.groupBy("conv").applyInPandas(_joined, f"conv {conv_type}, segment long, entry int, piece string, audit string, {counts}, cost long"), "segments")
    chosen = joined.select(F.col("conv").alias("c"), F.col("segment").alias("s"), "entry", "piece")
    placed = marked.join(chosen, F.col("conv").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("s")))
    parts = placed.groupBy("conv", "segment").applyInPandas(_lined, f"conv {conv_type}, segment long, data binary")
    shape = pa.schema([("conv", _arrow(parts, "conv")), ("repaired_sha256", pa.string())])
    hashes = parts.repartition("conv").sortWithinPartitions("conv", "segment").mapInArrow(_hashed(shape), f"conv {conv_type}, repaired_sha256 string")
    turns = here.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    sums = joined.groupBy("conv").agg(*[F.sum(n).alias(n) for n in (*FAULTS, "illegal", "cost")], F.max("audit").alias("audit"))
    found = rows.groupBy("conv").agg(F.lit(1).alias("_"))
    for k, part in enumerate((turns, sums, hashes)):
        found = found.join(part.withColumnRenamed("conv", f"c{k}"), F.col("conv").eqNullSafe(F.col(f"c{k}")), "left")
    return found


def repaired(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", damage=damaged) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows of a conversation go by turn (nulls first); rows of one turn by role, then by the SHA-256 of their text. ``damage`` makes
    (conv, turn, role, text, lost, uid, copy) of the rows first (``damaged``, or ``as_they_are`` to repair them as given). Faults:
    blank (no character that is not white), else duplicate (role and text seen earlier), else truncated (the last such
    character is not ``.``, ``!`` or ``?``). A null conversation is one like any other. A conversation all of whose rows are lost has
    zeros, an empty audit and the hash of nothing; an empty table gives an empty result. Other columns are not read.
    """
    conv_type = conversations.schema[conv_col].dataType.simpleString()
    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    order: list[Column | str] = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", F.sha2("text", 256), "uid", "copy"]
    ranged = damage(rows).repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "role", "text", "lost")
    schema = pa.schema([("conv", _arrow(rows, "conv")), ("ord", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("lost", pa.bool_()), *_RESULT.items()])
    names = {pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean"}
    ddl = f"conv {conv_type}, " + ", ".join(f"{f.name} {names[f.type]}" for f in list(schema)[1:])
    with scope(conversations.sparkSession, keep=("conversations", "segments")):
        folded = materialise(ranged.mapInArrow(_folded(schema), ddl), "conversations")
        spread = _spread(folded.filter("ord is not null"), conv_type)
    results = [F.coalesce(F.col(c), F.lit({"audit": "", "repaired_sha256": _EMPTY_HASH}.get(c, 0))).alias(c) for c in _RESULT]
    own = F.col("conv").alias("conv_id")
    return folded.filter("ord is null").select(own, *results).unionByName(spread.select(own, *results))


def _arrow(df: DataFrame, name: str) -> pa.DataType:
    return to_arrow_type(df.schema[name].dataType)
