"""Cross-entropy difference scoring with matched n-gram models.

A target model (texts of the wanted kind) and a background model (all texts) are bigram models of one
form: interpolated Witten-Bell bigrams over add-one unigrams, with one shared vocabulary. A token's loss
difference is -log p_target + log p_background; a document's score is its mean over the tokens, so lower is
more like the target.

Every lower-cased word of the corpus is in the vocabulary and every pair of neighbours is counted, so the model
grows with the corpus. It is never held whole: words are 64-bit hashes, and what is known of them lies in
parts whose number grows with the characters of the texts.

1. ``word_parts``: each task adds up the words of a block of texts; a word's part adds up its unigram counts and sends
   them to the parts of the histories that it follows (in the order of the words, which those parts know).
2. ``text_sums``: each task groups the tokens of a block of texts by history and word, with the texts they are in.
   A history's part counts its bigrams, meets the unigrams of 1, and adds up the loss differences by text.
3. The sums of the texts of all parts go back to their block, are added up there and then by the hash of the text,
   and meet the rows: equal texts have equal scores. Between the steps numbers travel in packed rows, at most one
   number a token; a text is named by its place in its block.

Histories that are common in a sample (at most ``MOST_HOT``) are dealt out by history and word, and their commonest
pairs by text; the totals of both come from the parts of 1. The sample decides only where counts are made.

A target text is scored by a model that has learned from it, so targets score lower than their like; compare texts
with texts that are no targets.

With ``words`` given, the vocabulary is the ``words`` commonest words plus ``classes`` classes of rarer words (by
hash of their last three letters) instead.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, materialise, mix64, plain, sized, word_hashes

BLOCK = 1_000_000  # tokens that a task groups at once
MOST_HOT = 1000
MOST_TARGETS = 1_000_000


@dataclass
class Vocabulary:
    """Ids 0..classes-1 are classes of rare words, then come the words; the last id begins a text."""

    words: list[str]
    classes: int

    def __post_init__(self):
        self.ids = {w: self.classes + i for i, w in enumerate(self.words)}
        self.start = self.classes + len(self.words)
        self.size = self.start + 1

        if self.size > 1 << 16:
            raise ValueError("ids have 16 bits")

    def encode(self, text: str | None) -> np.ndarray:
        """An id for each lower-cased word of the whole text."""
        tokens = text.lower().split() if text else []
        get = self.ids.get
        return np.array([i if (i := get(t)) is not None else zlib.crc32(t[-3:].encode("utf-8", "surrogatepass")) % self.classes for t in tokens], "<u2")

    def encode_all(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        return (self.encode(t).astype(np.uint64) for t in texts)


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over all texts; counted within tasks first, in a table that is passed on when it is large."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                if text:
                    counts.update(text.lower().split())
                if len(counts) > 200_000:
                    yield plain(pd.DataFrame({"word": list(counts), "n": list(counts.values())}), "word")
                    counts.clear()
        yield plain(pd.DataFrame({"word": list(counts), "n": list(counts.values())}), "word")

    return docs.select(F.col(text_col).alias("text")).mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, text_col: str, words: int, classes: int) -> Vocabulary:
    top = word_counts(docs, text_col).orderBy(F.desc("n"), "word").limit(words).collect()
    return Vocabulary(sorted(r["word"] for r in top), classes)


class Words:
    """The open vocabulary: a word's id is a 64-bit hash of it; 0 begins a text."""

    start = 0

    def encode_all(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        for k in range(0, len(texts), 100):
            plain_texts = [" ".join(t.lower().split()) if t else "" for t in texts[k : k + 100]]
            for _, raws in blocks(plain_texts, 1 << 19):
                ids, counts = word_hashes(raws)
                yield from np.split(ids, np.cumsum(counts)[:-1])


def _spread(ids: np.ndarray, parts: int, seed: int) -> np.ndarray:
    return (mix64(ids ^ np.uint64(seed)) % np.uint64(parts)).astype(np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one byte string: their types and lengths, then their bytes."""
    head = b"".join(struct.pack("<2sq", a.dtype.str[1:].encode(), len(a)) for a in arrays)
    return head + b"".join(a.tobytes() for a in arrays)


def _unpack(raw: bytes, n: int) -> list[np.ndarray]:
    out, at = [], 10 * n
    for k in range(n):
        kind, length = struct.unpack_from("<2sq", raw, 10 * k)
        out.append(np.frombuffer(raw, "<" + kind.decode(), length, at))
        at += out[-1].nbytes
    return out


def _small(a: np.ndarray) -> np.ndarray:
    """Numbers of least width."""
    most = int(a.max()) if len(a) else 0
    return a.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8")


def _edges(a: np.ndarray) -> np.ndarray:
    """Where the runs of equal values of a sorted array begin."""
    return np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.empty(0, np.int64)


def _runs(a: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, first, end) of each run of a sorted array."""
    at = _edges(a)
    return zip(a[at].tolist(), at.tolist(), [*at[1:].tolist(), len(a)], strict=True)


def _places(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Where each value lies in the sorted array ``known``; -1 if it does not."""
    if not len(known):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


def _pair_hash(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix64(mix64(h) ^ w)


@dataclass
class Hot:
    """What is common in a sample: words (sorted ids) and, of their followers, pairs (sorted hashes)."""

    histories: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    pairs: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))


class _Block:
    """The tokens of a block of texts, grouped by part, history and word."""

    def __init__(self, texts: list[np.ndarray], keys: np.ndarray, targets: list[bool], start: int, parts: int, hot: Hot):
        n = np.array([len(t) for t in texts])
        self.ids, lw = np.unique(np.concatenate([*texts, np.array([start], np.uint64)]), return_inverse=True)
        lh = np.concatenate((lw[-1:], lw[:-2]))
        lh[np.cumsum(n)[:-1]] = lw[-1]
        lw = lw[:-1]
        self.hot_of = _places(self.ids, hot.histories)
        part = _spread(self.ids, parts, 1)[lh]
        heads = np.flatnonzero(self.hot_of[lh] >= 0)
        pair = _pair_hash(self.ids[lh[heads]], self.ids[lw[heads]])
        part[heads] = _spread(pair, parts, 2)
        often = heads[_places(pair, hot.pairs) >= 0]
        part[often] = _spread(keys.view(np.uint64), parts, 4)[np.repeat(np.arange(len(n), dtype=np.int32), n)[often]]
        bits = int(len(self.ids)).bit_length()
        key = part
        for x in (lh, lw):
            key <<= bits
            key |= x
        del lh, lw, part, heads
        order = np.argsort(key)
        key, self.text = key[order], np.repeat(np.arange(len(n), dtype=np.int32), n)[order]
        self.first = _edges(key)
        key = key[self.first]
        self.n = np.diff(np.append(self.first, len(order)))
        self.n_target = np.add.reduceat(np.array(targets, np.int32)[self.text], self.first)
        mask = (1 << bits) - 1
        self.part, self.h, self.w = key >> (2 * bits), (key >> bits) & mask, key & mask


def _blocks_of(batches: Iterator[pd.DataFrame], vocab, parts: int, hot: Hot) -> Iterator[tuple[_Block, np.ndarray, np.ndarray]]:
    """(block, keys of its texts, whether they are targets) of about BLOCK tokens or one long text."""
    held: tuple[list, list, list] = ([], [], [])
    n = 0

    def made():
        texts, keys, targets = held
        block = _Block(texts, np.array(keys, "<i8"), targets, vocab.start, parts, hot)
        texts.clear()
        return block, np.array(keys, "<i8"), np.array(targets, "<u1")

    for batch in batches:
        for ids, key, target in zip(vocab.encode_all(list(batch["text"])), batch["key"], batch["target"], strict=True):
            if not len(ids):
                continue
            for column, value in zip(held, (ids, key, bool(target)), strict=True):
                column.append(value)
            n += len(ids)
            if n >= BLOCK:
                yield made()
                held, n = ([], [], []), 0
    if n:
        yield made()


def hot_parts(rows: DataFrame, vocab, parts: int) -> Hot:
    """The words that are common in a sample of the texts, and the commonest pairs that begin with one."""
    shared = rows.sparkSession.sparkContext.broadcast(vocab)
    sample = rows.filter("pmod(key, 64) = 0").select("text")
    top = lambda df: df.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(MOST_HOT).collect()
    ids_of = lambda found, least: np.sort(np.array([r["word"] for r in found if r["n"] >= least], np.int64).view(np.uint64))

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t for t in shared.value.encode_all(list(batch["text"])) if len(t)]
            if texts:
                ids, n = np.unique(np.concatenate([*texts, np.full(len(texts), shared.value.start, np.uint64)]), return_counts=True)
                yield pd.DataFrame({"word": ids.view(np.int64), "n": n})

    found = top(sample.mapInPandas(words, "word long, n long"))
    least = sum(r["n"] for r in found) / (8 * parts)
    histories = ids_of(found, least)

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [np.concatenate((np.array([shared.value.start], np.uint64), t)) for t in shared.value.encode_all(list(batch["text"])) if len(t)]
            if texts:
                h, w = np.concatenate([t[:-1] for t in texts]), np.concatenate([t[1:] for t in texts])
                inside = _places(h, histories) >= 0
                ids, n = np.unique(_pair_hash(h[inside], w[inside]), return_counts=True)
                yield pd.DataFrame({"word": ids.view(np.int64), "n": n})

    return Hot(histories, ids_of(top(sample.mapInPandas(pairs, "word long, n long")), least) if len(histories) else histories)


def _total_shapes(hot: Hot) -> tuple[tuple[int, int], tuple[int, int]]:
    """Of the totals: words and tokens, then (tokens, of targets, kinds, of targets) of a history; (tokens, of targets) of a pair."""
    return (len(hot.histories) + 1, 4), (len(hot.pairs), 2)


def word_parts(rows: DataFrame, vocab, parts: int, hot: Hot) -> DataFrame:
    """(part, source, kind, data): kind 1 has the unigram counts that a part needs from the word part ``source``; 2 the totals."""
    shared = rows.sparkSession.sparkContext.broadcast((vocab, hot))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab, hot = shared.value
        for b, _, _ in _blocks_of(batches, vocab, parts, hot):
            b.text = None
            of_word = _spread(b.ids, parts, 3)
            bits = parts.bit_length()
            code, inverse = np.unique((of_word[b.w] << 40 | b.w) << bits | b.part, return_inverse=True)
            n, n_target = (np.bincount(inverse, x).astype(np.int64) for x in (b.n, b.n_target))
            word, to = (code >> bits) & ((1 << 40) - 1), code & ((1 << bits) - 1)
            heads = np.flatnonzero(b.hot_of[b.h] >= 0)
            heads = heads[np.argsort(of_word[b.w[heads]])]
            hot_part = of_word[b.w[heads]]
            out = []
            for part, i, j in _runs(of_word[word]):
                k = heads[np.searchsorted(hot_part, part) : np.searchsorted(hot_part, part, "right")]
                first = _edges(word[i:j])
                data = _pack(
                    b.ids[word[i:j][first]], _small(np.diff(np.append(first, j - i))), _small(to[i:j]), _small(n[i:j]), _small(n_target[i:j]),
                    b.ids[b.w[k]], _small(b.hot_of[b.h[k]]), _small(b.n[k]), _small(b.n_target[k]),
                )
                out.append((part, data))
            yield pd.DataFrame(out, columns=["part", "data"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        hot, source = shared.value[1], int(group["part"].iloc[0])
        columns = list(zip(*[_unpack(d, 9) for d in group["data"]], strict=True))
        ids, repeats, to, n, n_target, hot_word, hot_at, hot_n, hot_target = (np.concatenate(c) for c in columns)
        words, at = np.unique(ids, return_inverse=True)
        at = np.repeat(at, repeats)
        n, n_target = np.bincount(at, n, len(words)), np.bincount(at, n_target, len(words))
        code = np.unique(to.astype(np.int64) * len(words) + at)
        # the words themselves need not travel: the part knows them, in this order
        out = [(part, source, 1, _pack(_small(n[w := code[i:j] % len(words)]), _small(n_target[w]))) for part, i, j in _runs(code // len(words))]
        histories, pairs = (np.zeros(shape) for shape in _total_shapes(hot))
        histories[-1] = len(words), n.sum(), n_target.sum(), 0
        if len(hot_word):
            code, at = np.unique(np.searchsorted(words, hot_word) * len(hot.histories) + hot_at.astype(np.int64), return_inverse=True)
            found = _places(_pair_hash(hot.histories[code % len(hot.histories)], words[code // len(hot.histories)]), hot.pairs)
            for k, x in enumerate((np.bincount(at, hot_n), np.bincount(at, hot_target))):
                histories[:-1, k] = np.bincount(code % len(hot.histories), x, len(hot.histories))
                histories[:-1, 2 + k] = np.bincount(code % len(hot.histories), x > 0, len(hot.histories))
                pairs[found[found >= 0], k] = x[found >= 0]
        out.append((-1, source, 2, histories.tobytes() + pairs.tobytes()))
        return pd.DataFrame(out, columns=["part", "source", "kind", "data"])

    added = rows.mapInPandas(split, "part int, data binary").groupBy("part").applyInPandas(add, "part int, source int, kind int, data binary")
    return materialise(added, "words")


def text_sums(rows: DataFrame, vocab, parts: int, hot: Hot) -> DataFrame:
    """(key, s, n, copies): the sum of loss differences, the tokens and the number of the texts with a key.

    A text is known by its block and its place there; the keys of a block go with its first row only.
    """
    words = word_parts(rows, vocab, parts, hot)
    shapes = _total_shapes(hot)
    totals = np.zeros(sum(a * b for a, b in shapes))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros(len(totals))
        for batch in batches:
            for data in batch["data"]:
                found += np.frombuffer(data)
        yield pd.DataFrame({"data": [found.tobytes()]})

    # every part has a row of some MOST_HOT numbers: tasks add up about as many as the driver gets
    folded = words.filter("kind = 2").select("source", "data").repartition(math.isqrt(parts) + 1, "source").mapInPandas(fold, "data binary")
    for row in folded.toLocalIterator():
        totals += np.frombuffer(row["data"])
    histories, pairs_total = (x.reshape(shape) for x, shape in zip(np.split(totals, [shapes[0][0] * shapes[0][1]]), shapes, strict=True))
    kinds, *tokens = histories[-1, :3]
    size = float(vocab.size if isinstance(vocab, Vocabulary) else kinds + 1)
    shared = rows.sparkSession.sparkContext.broadcast((vocab, hot, histories[:-1], pairs_total))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab, hot, *_ = shared.value
        task = TaskContext.get().partitionId()
        for at, (b, keys, _) in enumerate(_blocks_of(batches, vocab, parts, hot)):
            out = []
            ends, runs = np.append(b.first, len(b.text)), list(_runs(b.part))
            # block, digest of its keys in their order, rows of the block
            mark = np.array([task << 32 | at, zlib.crc32(keys.tobytes()), len(runs)], "<i8")
            for k, (part, i, j) in enumerate(runs):
                first = _edges(b.h[i:j])
                data = _pack(
                    b.ids[b.h[i:j][first]], _small(np.diff(np.append(first, j - i))), b.ids[b.w[i:j]], _small(b.n[i:j]), _small(b.n_target[i:j]),
                    _small(b.text[ends[i] : ends[j]]), keys if k == 0 else keys[:0], mark,
                )
                out.append((part, -1, 0, data))
            yield pd.DataFrame(out, columns=["part", "source", "kind", "data"])

    def score_part(group: pd.DataFrame) -> pd.DataFrame:
        vocab, hot, of_history, of_pair = shared.value
        columns = list(zip(*[_unpack(d, 8) for d in group["data"][group["kind"] == 0]], strict=True))
        ids, repeats, w, n, n_target = (np.concatenate(c) for c in columns[:5])
        known, w = np.unique(w, return_inverse=True)
        # each source has sent the counts of its words in their order
        source, u = _spread(known, parts, 3), np.zeros((2, len(known)))
        order = np.argsort(source, kind="stable")
        answers = group[group["kind"] == 1].sort_values("source")
        for k, x in enumerate(zip(*[_unpack(d, 2) for d in answers["data"]], strict=True)):
            u[k, order] = (np.concatenate(x) + 1.0) / (tokens[k] + size)
        heads, h = np.unique(ids, return_inverse=True)
        code, pair = np.unique(np.repeat(h, repeats) * len(known) + w, return_inverse=True)
        del ids, repeats, order, source
        h, w = code // len(known), code % len(known)
        at_hot = _places(heads, hot.histories)
        is_hot = at_hot >= 0
        at_pair = np.full(len(code), -1)
        inside = np.flatnonzero(is_hot[h])
        at_pair[inside] = _places(_pair_hash(heads[h[inside]], known[w[inside]]), hot.pairs)
        is_often = at_pair >= 0
        logs = []
        for k, x in enumerate((n, n_target)):
            x = np.bincount(pair, x, len(code))
            total, kinds = np.bincount(h, x, len(heads)), np.bincount(h, x > 0, len(heads))
            total[is_hot], kinds[is_hot] = of_history[at_hot[is_hot], k], of_history[at_hot[is_hot], 2 + k]
            x[is_often] = of_pair[at_pair[is_often], k]
            p = u[k][w]
            seen = total[h] > 0
            logs.append(np.log(np.where(seen, (x + kinds[h] * p) / np.where(seen, total[h] + kinds[h], 1), p)))
        diff, begins = logs[0] - logs[1], heads[h] == np.uint64(vocab.start)
        out, at_pair = [], 0
        for counts, text, keys, mark in zip(columns[3], *columns[5:], strict=True):  # tokens of one block at a time
            of_pair = np.repeat(pair[at_pair : at_pair + len(counts)], counts)
            at_pair += len(counts)
            used, text = np.unique(text, return_inverse=True)
            sums, begun = (np.bincount(text, x[of_pair], len(used)) for x in (diff, begins))
            out.append((int(mark[0]), _pack(_small(used), sums, _small(np.bincount(text)), _small(begun.astype(np.int64)), keys, mark)))
        return pd.DataFrame(out, columns=["block", "data"])

    def add_texts(group: pd.DataFrame) -> pd.DataFrame:
        answers = [_unpack(d, 6) for d in group["data"]]
        keys, mark = np.concatenate([a[4] for a in answers]), answers[0][5]
        if len(answers) != mark[2] or zlib.crc32(keys.tobytes()) != mark[1] or any((a[5] != mark).any() for a in answers):
            raise RuntimeError("a task that ran again has read its rows in another order")
        found = np.zeros((3, len(keys)))
        for used, *sums, _, _ in answers:
            for total, x in zip(found, sums, strict=True):
                total[used] += x
        s, n, begun = found
        return pd.DataFrame({"key": keys, "s": s, "n": n.astype(np.int64), "copies": begun.astype(np.int64)})

    pairs = rows.mapInPandas(split, "part int, source int, kind int, data binary").unionByName(words.filter("kind = 1"))
    found = pairs.groupBy("part").applyInPandas(score_part, "block long, data binary")
    texts = found.groupBy("block").applyInPandas(add_texts, "key long, s double, n long, copies long")
    # a table, so that adaptive execution can split the join of the rows of a text with many copies
    return materialise(texts.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("s", "n", "copies"))), "sums")


def cross_entropy_difference(
    docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int | None = None, classes: int = 500, part_chars: int = 10 << 20
) -> DataFrame:
    """Score ``docs`` against the target texts, those whose id is in ``targets`` (one column, ``id_col``).

    Null, empty and white texts have no tokens and a null score. Rows that repeat an id are scored
    each; a null id is never a target. Extra columns are not carried. An empty table gives an empty result.
    With no target text the target model is the uniform one over the vocabulary. ``words`` bounds the
    vocabulary, by default it is open; ``part_chars`` is the size of a part of the model in characters of text.

    A text is known by its place in its task, so ``docs`` must be read in the same order when a lost task runs again, as
    a table is; if not, the query fails instead of giving wrong sums. Materialise the result of a shuffle first.
    """
    vocab = Words() if words is None else vocabulary(docs, text_col, words, classes)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("text"))
    wanted = targets.select(F.col(id_col).alias("_id")).filter("_id is not null").distinct().withColumn("_target", F.lit(True))
    # broadcast as long as the ids are few: the other way shuffles the texts
    wanted = materialise(wanted, "targets")
    few = sized(wanted, MOST_TARGETS)
    marked = rows.join(few, rows["doc_id"] == few["_id"], "left").select("text", "key", F.coalesce("_target", F.lit(False)).alias("target"))
    if few is wanted:  # shuffled rows come in any order; blocks need one
        marked = marked.sortWithinPartitions("key", "target")
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    parts = int(chars // part_chars) + 1
    hot = hot_parts(rows, vocab, parts) if parts > 1 else Hot()
    sums = text_sums(marked, vocab, parts, hot)
    n = F.coalesce(F.expr("n div copies"), F.lit(0)).alias("n_tokens")
    return rows.select("doc_id", "key").join(sums, "key", "left").select("doc_id", n, (F.col("s") / F.col("n")).alias("score"))
