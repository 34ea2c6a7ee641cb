"""Best-fit packing of tokenised documents into sequences by a grouping genetic algorithm.

Shape of the job
  1. ``token_pieces`` tokenises every text where it lies and keeps (start, length, checksum) of each
     piece; the ids themselves are never shuffled.
  2. Pieces are dealt by hash into *cells* of about ``cell_rows`` pieces. A full piece is a sequence
     of its own. For each cell several *islands* (one task each) evolve a population of groupings.
  3. Elites migrate: every island receives the best grouping of its neighbour and evolves again.
  4. Of each cell the best grouping counts. Its well-filled sequences are final; the pieces of the
     others go to the next level, where fewer cells remain, until one cell is left or a level gains nothing.

Grouping genetic algorithm (Falkenauer): the genes are whole bins. Crossover injects well-filled bins
of one parent into the other and removes the bins that now hold duplicates; displaced pieces are exchanged for smaller
ones where that fills a bin better, and what is left goes back by best fit, longest first. A cell stops early when it has
reached the lower bound ceil(tokens / capacity).
"""

from __future__ import annotations

import random
import re
import sys
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

# Texts made of these characters only take the fast path below; it gives the same ids as the
# tokenizer's own pipeline, which handles everything else (other scripts, combining marks, controls).
_PLAIN = re.compile("[^\t-\r -ȶ‐-‧‰-›€]")
_PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\w\s]|_)+")
_KEPT_WORDS, _LONGEST_KEPT = 250_000, 64


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE uses for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class TokenBytes:
    """Token ids of texts as little-endian 32-bit bytes, with a bounded cache of words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.words: dict[str, bytes] = {}  # the ids of words seen of late
        self.older: dict[str, bytes] = {}  # those of the generation before
        # the fast path is for word-level caching of this kind of tokenizer: lower case, white space dropped
        probe = "It's  A_b 42 naïve—x, re'd\tOK?!"
        self.fast = self._plain(probe) == self._own(probe)

    def _own(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        ids = array("I", [t.id for t in self.model.tokenize(letters)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _learn(self, word: str) -> bytes:
        """The ids of a word that is not among ``words``; a word of letters is a piece itself, others are cut."""
        found = self.older.get(word)
        if found is None:
            pieces = [word] if word.isalpha() else _PRETOKEN.findall(word)
            if len(pieces) == 1:
                found = self._piece(pieces[0])
            else:
                found = b"".join([self.words.get(p) or self._learn(p) for p in pieces])
        if len(word) <= _LONGEST_KEPT:
            self.words[word] = found
        return found

    def _plain(self, text: str) -> bytes:
        words, parts = self.words, text.lower().split()
        try:
            return b"".join([words[w] for w in parts])
        except KeyError:
            if len(words) > _KEPT_WORDS:
                self.older, self.words = words, {}
            learn, get = self._learn, self.words.get
            return b"".join([get(w) or learn(w) for w in parts])

    def __call__(self, text: str) -> bytes:
        if self.fast and "<|" not in text and not _PLAIN.search(text):
            return self._plain(text)
        return self._own(text)


_loaded: dict[str, TokenBytes] = {}


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """One row per piece: the document's ids followed by ``end_id``, cut every ``capacity`` ids.

    A null or empty text is the single id ``end_id``. Rows with the same id are documents of their own.
    """
    step, end = capacity * 4, int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if tokenizer_path not in _loaded:
            _loaded[tokenizer_path] = TokenBytes(tokenizer_path)
        encode = _loaded[tokenizer_path]
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = (encode(text) if text else b"") + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, PIECES)


class _Bins:
    """Open bins indexed by free room; the tightest fit is the lowest set bit at or above the length."""

    def __init__(self, capacity: int):
        self.capacity, self.room, self.mask = capacity, [[] for _ in range(capacity + 1)], 0

    def add(self, free: int, items: list[int]) -> None:
        self.room[free].append(items)
        self.mask |= 1 << free

    def put(self, item: int, length: int) -> None:
        fits = self.mask >> length
        if not fits:
            return self.add(self.capacity - length, [item])
        free = length + (fits & -fits).bit_length() - 1
        items = self.room[free].pop()
        if not self.room[free]:
            self.mask &= ~(1 << free)
        items.append(item)
        self.add(free - length, items)

    def all(self) -> list[list[int]]:
        return [items for room in self.room for items in room]


def best_fit(order: list[int], lengths: list[int], capacity: int, bins: list[list[int]] = ()) -> list[list[int]]:
    """Place items in this order, each into the bin it fills best; ``bins`` are there already."""
    open_bins = _Bins(capacity)
    for items in bins:
        open_bins.add(capacity - sum(lengths[i] for i in items), list(items))
    for i in order:
        open_bins.put(i, lengths[i])
    return open_bins.all()


Bins = list[tuple[int, tuple[int, ...]]]  # (tokens, items) of each bin


def filled(bins: list[list[int]], lengths: list[int]) -> Bins:
    return [(sum(lengths[i] for i in items), tuple(items)) for items in bins]


def fitness(bins: Bins) -> tuple[int, int]:
    """Fewer bins first; of equal numbers, the fuller the full ones the better (lower is better)."""
    return len(bins), -sum(n * n for n, _ in bins)


def swap_in(bins: Bins, loose: list[int], lengths: list[int], capacity: int) -> tuple[Bins, list[int]]:
    """Exchange one or two items of a bin for one or two larger loose ones wherever that fills the bin better.

    Returns the bins and the loose items, which have become smaller ones and so are easier to place.
    """
    free = sorted((lengths[i], i) for i in loose)
    pairs: list[tuple[int, int, int]] | None = None
    out = []
    for n, items in bins:
        room = capacity - n
        best = (n, None, None)
        if room and len(items) <= 16:
            if pairs is None:
                pairs = sorted((x + y, i, j) for k, (x, i) in enumerate(free) for y, j in free[:k])
            taken = [(lengths[i], (i,)) for i in items] + [(lengths[i] + lengths[j], (i, j)) for k, i in enumerate(items) for j in items[:k]]
            for size, gone in taken:
                for known in (free, pairs):
                    at = bisect_right(known, (size + room, len(lengths))) - 1
                    if at >= 0 and known[at][0] > size and n - size + known[at][0] > best[0]:
                        best = (n - size + known[at][0], gone, known[at][1:])
        if best[1] is None:
            out.append((n, items))
            continue
        n, gone, came = best
        out.append((n, (*(i for i in items if i not in gone), *came)))
        free = sorted([x for x in free if x[1] not in came] + [(lengths[i], i) for i in gone])
        pairs = None
    return out, [i for _, i in free]


def crossover(a: Bins, b: Bins, lengths: list[int], capacity: int, rng: random.Random, most: int = 40) -> Bins:
    """Inject well-filled bins of ``b`` into ``a``, drop the bins of ``a`` that hold duplicates, and place what they displaced.

    About ``most`` items are displaced: those of the dropped bins and, as mutation, of the least filled bins of ``a``.
    """
    ranked = sorted(b, key=lambda x: -x[0])
    here = set(a)
    fresh = [x for x in ranked[: max(1, (3 * len(ranked)) // 4)] if x not in here]
    well, moved = [], set()
    each = max(1, len(lengths) // max(1, len(a)))
    for x in rng.sample(fresh, min(len(fresh), max(1, rng.randrange(1, 2 + most // (2 * each))))):
        well.append(x)
        moved.update(x[1])
    stay, loose = [], []
    for x in a:
        if moved.isdisjoint(x[1]):
            stay.append(x)
        else:
            loose += [i for i in x[1] if i not in moved]
    stay.sort(key=lambda x: -x[0])
    while stay and len(loose) < most and (len(loose) < most // 2 or rng.random() < 0.7):
        # one of the worst tenth
        loose += stay.pop(len(stay) - 1 - rng.randrange(max(1, len(stay) // 10)))[1]
    mixed = [*well, *stay]
    if len(loose) <= 3 * most:
        mixed, loose = swap_in(mixed, loose, lengths, capacity)
    loose.sort(key=lambda i: (-lengths[i], i))
    return filled(best_fit(loose, lengths, capacity, [list(items) for _, items in mixed]), lengths)


def evolve(lengths: list[int], capacity: int, seed: int, starts: list[list[list[int]]], generations: int, population: int) -> list[list[int]]:
    """The best grouping found; ``starts`` are migrated elites.

    Bins that best fit fills to a thousandth are left as they are; the others' items evolve until the lower bound
    is reached or ``generations`` pass without a gain.
    """
    rng = random.Random(seed)
    descending = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    plain = filled(best_fit(descending, lengths, capacity), lengths)
    done = [items for n, items in plain if 1000 * (capacity - n) <= capacity]
    settled = {i for items in done for i in items}
    rest = [i for i in descending if i not in settled]
    least = -(-sum(lengths[i] for i in rest) // capacity)
    people = [[x for x in filled(p, lengths) if settled.isdisjoint(x[1])] for p in starts] or [[x for x in plain if settled.isdisjoint(x[1])]]
    ranked = sorted(((fitness(p), p) for p in people), key=lambda x: x[0])
    while ranked[0][0][0] > least and len(ranked) < population:
        noise = {i: lengths[i] * (0.8 + 0.4 * rng.random()) for i in rest}
        one = filled(best_fit(sorted(rest, key=lambda i: -noise[i]), lengths, capacity), lengths)
        ranked = sorted([*ranked, (fitness(one), one)], key=lambda x: x[0])
    idle = 0
    while ranked[0][0][0] > least and idle < generations:
        (_, a), (_, b) = rng.sample(ranked[: max(2, population - population // 3)], 2)
        child = crossover(a, b, lengths, capacity, rng)
        score = fitness(child)
        idle = 0 if score[0] < ranked[0][0][0] else idle + 1
        if all(score != s for s, _ in ranked):  # twins would take over
            ranked = sorted([*ranked, (score, child)], key=lambda x: x[0])[:population]
    return [list(items) for items in (*done, *(items for _, items in ranked[0][1]))]


_CELL = "cell long, island int, doc_id long, piece int, length long, ids_crc32 long, deal long"


def _islands(capacity: int, seed: int, generations: int, population: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """One cell on one island. ``origin`` tells the groupings that were brought along apart."""
        cell, island = int(rows["cell"].iloc[0]), int(rows["island"].iloc[0])
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", na_position="last")
        parts = [p.reset_index(drop=True) for _, p in rows.groupby("origin", sort=True)]
        lengths, starts = parts[0]["length"].tolist(), []
        for part in parts:
            number = part["bin"].to_numpy()
            if number[0] >= 0:
                order = np.argsort(number, kind="stable")
                starts.append([items.tolist() for items in np.split(order, np.flatnonzero(np.diff(number[order])) + 1)])
        bins = evolve(lengths, capacity, hash((seed, cell, island, len(starts))), starts, generations, population)
        number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for k, items in enumerate(sorted(sorted(items) for items in bins)):
            at = 0
            for i in items:
                number[i], offset[i] = k, at
                at += lengths[i]
        count, loss = fitness(filled(bins, lengths))
        out = parts[0].drop(columns=["origin"])
        return out.assign(bin=number, offset=offset, n_bins=count, loss=float(loss))

    return run


def pack(pieces: DataFrame, capacity: int = 4096, cell_rows: int = 8192, islands: int = 3, seed: int = 7, generations: int = 40, population: int = 8, well_filled: float = 0.995) -> DataFrame:
    """``pieces`` with sequence_id and offset; pieces of a sequence lie without gaps from offset 0.

    ``pieces`` has the columns of ``token_pieces`` with 1 <= length <= capacity. Rows that repeat a
    (doc_id, piece) are pieces of their own; null ids are packed as any other, and a mass of them is dealt out by
    their place in the table. No rows give no sequences. Cells are dealt by hash, so a cell stays near ``cell_rows``
    whatever the ids are. Levels end when one cell holds what is left, or when dealing it anew has saved less
    than a hundredth of its sequences.
    """
    pieces = pieces.select("doc_id", "piece", "length", "ids_crc32", "start")
    pieces = materialise(pieces.withColumn("deal", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())), "pieces")
    key = F.xxhash64("doc_id", "piece", "ids_crc32", "length", "deal")
    whole = pieces.filter(F.col("length") == capacity)
    cells = max(1, -(-whole.count() // cell_rows))
    # xxhash64 again, so that cells of the two kinds are dealt alike but numbered apart
    full = whole.withColumn("cell", F.pmod(key, F.lit(cells))).select(
        "doc_id", "piece", "length", "ids_crc32",
        (F.lit(1 << 61) + F.shiftleft("cell", 24) + F.row_number().over(Window.partitionBy("cell").orderBy("doc_id", "piece", "ids_crc32"))).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    rest, done = pieces.filter(F.col("length") < capacity).select("doc_id", "piece", "length", "ids_crc32", "deal"), [full]
    n_rest = rest.count()
    step = f"{_CELL}, bin long, offset long, n_bins long, loss double"
    evolved = _islands(capacity, seed, generations, population)
    level, used_before = 0, None
    while n_rest or not level:
        cells = max(1, -(-n_rest // cell_rows))
        dealt = rest.withColumn("cell", F.pmod(F.xxhash64(key, F.lit(level)), F.lit(cells)))
        first = (
            dealt.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))
            .withColumns({"bin": F.lit(-1).cast("long"), "origin": F.lit(0)})
            .groupBy("cell", "island").applyInPandas(evolved, step)
        )
        # migration: the neighbour's elite comes along, and the island evolves again from both
        elites = first.withColumn("origin", F.col("island")).withColumn("island", F.explode(F.array(F.col("origin"), F.pmod(F.col("origin") + 1, F.lit(islands)))))
        second = elites.drop("offset", "n_bins", "loss").groupBy("cell", "island").applyInPandas(evolved, step)
        second = materialise(second, f"cells-{level}")
        best = second.groupBy("cell").agg(F.min(F.struct("n_bins", "loss", "island")).alias("best")).select("cell", F.col("best.island").alias("island"), F.col("best.n_bins").alias("used"))
        chosen = second.join(best.drop("used"), ["cell", "island"])
        filled_bins = chosen.groupBy("cell", "bin").agg(F.sum("length").alias("filled"))
        used = best.agg(F.coalesce(F.sum("used"), F.lit(0))).first()[0]
        last = cells == 1 or (used_before is not None and used > 0.99 * used_before)
        final = filled_bins if last else filled_bins.filter(F.col("filled") >= well_filled * capacity)
        placed = chosen.join(final.select("cell", "bin"), ["cell", "bin"])
        done.append(placed.select("doc_id", "piece", "length", "ids_crc32", (F.lit((level + 1) << 54) + F.shiftleft("cell", 24) + F.col("bin")).alias("sequence_id"), "offset"))
        if last:
            break
        rest = materialise(chosen.join(final, ["cell", "bin"], "left_anti").select("doc_id", "piece", "length", "ids_crc32", "deal"), f"rest-{level}")
        n_rest = rest.count()
        used_before = used - final.count()
        level += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("start"), "length", "ids_crc32", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, **options) -> DataFrame:
    """Tokenise the texts of ``docs`` and pack them; see ``token_pieces`` and ``pack``."""
    return pack(token_pieces(docs, tokenizer_path, capacity=capacity), capacity, **options)
