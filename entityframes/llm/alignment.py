"""Alignment of two tokenizers over a corpus.

Tokenizer A is a byte-level BPE read from its ``tokenizers`` JSON, B a piece BPE with byte fallback read by ``sentencepiece``.
Both write down the bytes of one space and the text; where tokens of A and B end at the same byte, a group ends. Tokens
of A and B are linked where their bytes overlap.

1. Rows are shuffled by their full text, so each distinct text is tokenised and aligned once, with the number of its rows.
2. Texts are aligned in numpy by marks on bytes: with an end of A and an end of B marked, every stretch between two
   marks is one link. A task packs about ``BLOCK_BYTES`` of text into a block: the distinct pairs of each text
   as places in the sorted pairs of the block, and for every pair of the block the number of rows that hold it linked.
3. Blocks, not texts, send their pairs: counts are summed over blocks, the highest of each A id is found, and every block gets
   the counts of its own pairs back. What travels is the pairs of a block, far fewer than those of its texts.
4. Texts' measures go to the documents by the SHA-256 of the text.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import scope
from .common import materialise

BLOCK_BYTES, STEP_BYTES = 16 << 20, 1 << 20
#: fixed: how a byte-level tokenizer cuts a text into words before merging
BYTE_LEVEL_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Side:
    """One tokenizer: ids of texts, and the bytes, lengths and digits of every id."""

    def __init__(self, encode, token_bytes: list[bytes], marks: str):
        self.encode, self.bytes = encode, token_bytes
        self.lengths = np.array([len(b) for b in token_bytes], np.int64)
        # an id as it is written inside a group and at the end of one
        self.written = [f"{i}{mark}" for i in range(len(token_bytes)) for mark in ("," + marks)]


@lru_cache(maxsize=4)
def byte_level(path: str) -> Side:
    """Tokenizer A. The vocabulary is in the order of its merges, so ids are the ranks of a byte-pair encoder; special tokens are left out, so their strings are plain text."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = {t["content"] for t in spec["added_tokens"] if t["special"]}
    alphabet = byte_alphabet()
    ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    found = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        found[i] = token
    encoding = tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Side(lambda texts: [encoding.encode_ordinary(f" {t}") for t in texts], found, "|")


@lru_cache(maxsize=4)
def pieces(path: str) -> Side:
    """Tokenizer B, which puts the space before the text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = [bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size())]
    return Side(lambda texts: model.encode(texts, num_threads=1), found, ";")


def align(texts: list[str], a: Side, b: Side) -> tuple[np.ndarray, pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of the texts that both tokenizers write down, their measures, text of each pair, pair, occurrences).

    Pairs are ``a << 32 | b``, sorted and distinct within each text.
    """
    raws = [f" {t}".encode("utf-8", "surrogatepass") for t in texts]
    both = list(zip(a.encode(texts), b.encode(texts), strict=True))
    good = [k for k, (x, y) in enumerate(both) if x and y and b"".join(map(a.bytes.__getitem__, x)) == raws[k] and b"".join(map(b.bytes.__getitem__, y)) == raws[k]]
    n_a, n_b = (np.array([len(both[k][side]) for k in good], np.int64) for side in (0, 1))
    if not good:
        empty = np.empty(0, np.int64)
        return empty, pd.DataFrame({"n_a": n_a, "n_b": n_b, "n_groups": empty, "n_links": empty, "groups_sha256": []}), empty, empty, empty
    ids_a, ids_b = (np.concatenate([np.array(both[k][side], np.int64) for k in good]) for side in (0, 1))
    ends_a, ends_b = np.cumsum(a.lengths[ids_a]), np.cumsum(b.lengths[ids_b])
    text_ends = np.cumsum([len(raws[k]) for k in good])
    at_a, at_b = np.zeros(text_ends[-1] + 1, bool), np.zeros(text_ends[-1] + 1, bool)
    at_a[ends_a], at_b[ends_b] = True, True
    meet = at_a & at_b
    # links: the tokens that a stretch which ends at a mark belongs to
    marks = np.flatnonzero(at_a | at_b)
    before_a, before_b, group = (np.cumsum(x, dtype=np.int64) - x for x in (at_a, at_b, meet))
    link = ids_a[before_a[marks]] << 32 | ids_b[before_b[marks]]
    text_of = np.searchsorted(text_ends, marks)
    values, place = np.unique(link, return_inverse=True)
    keys, times = np.unique(text_of << 32 | place, return_counts=True)
    # groups as text: A's tokens of a group, then B's
    group_a, group_b = group[ends_a], group[ends_b]
    till_a, till_b = np.cumsum(np.bincount(group_a)), np.cumsum(np.bincount(group_b))
    order = np.empty(len(ids_a) + len(ids_b), np.int64)
    order[np.arange(len(ids_a)) + np.concatenate(([0], till_b))[group_a]] = ids_a * 2 + meet[ends_a]
    order[np.arange(len(ids_b)) + till_a[group_b]] = 2 * len(a.bytes) + ids_b * 2 + meet[ends_b]
    written, digests = [*a.written, *b.written], []
    for lo, hi in zip(np.concatenate(([0], np.cumsum(n_a + n_b)))[:-1], np.cumsum(n_a + n_b), strict=True):
        digests.append(hashlib.sha256("".join(map(written.__getitem__, order[lo:hi].tolist()))[:-1].encode()).hexdigest())
    n_groups = np.bincount(np.searchsorted(text_ends, np.flatnonzero(meet)), minlength=len(good))
    measures = pd.DataFrame({"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": np.bincount(text_of, minlength=len(good)), "groups_sha256": digests})
    return np.array(good), measures, keys >> 32, values[keys & 0xFFFFFFFF], times


def _planes(x: np.ndarray) -> bytes:
    """Four-byte numbers with their first bytes together, their second bytes together, ...: small ones compress well."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


_BLOCK = (
    "block long, digests array<binary>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
    "n_pairs array<long>, places binary, times binary, pairs array<long>, held array<long>"
)


def _packed(block: int, done: list[tuple]) -> pd.DataFrame:
    """One block of aligned steps (digests, copies, measures, text of each pair, pair, occurrences) as one row."""
    pairs = np.unique(np.concatenate([x[4] for x in done]))
    held, n_pairs, steps = np.zeros(len(pairs), np.int64), [], []
    for _, copies, measures, text_of, pair, _ in done:
        place = np.searchsorted(pairs, pair)
        np.add.at(held, place, copies[text_of])
        n_pairs.append(np.bincount(text_of, minlength=len(measures)))
        # within a text places ascend, so their steps are small; a text begins anew
        first = np.ones(len(place), bool)
        first[1:] = text_of[1:] != text_of[:-1]
        steps.append(np.where(first, place, np.diff(place, prepend=0)))
    measures = pd.concat([x[2] for x in done])
    row = {"block": block, "digests": [d for x in done for d in x[0]], **{c: measures[c].tolist() for c in measures}}
    row |= {"n_pairs": np.concatenate(n_pairs), "places": _planes(np.concatenate(steps)), "times": _planes(np.concatenate([x[5] for x in done])), "pairs": pairs, "held": held}
    return pd.DataFrame([row])


def aligned_blocks(texts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Blocks (see ``_BLOCK``) of the distinct texts (text, digest, copies)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        a, b = byte_level(a_path), pieces(b_path)
        number, done, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            texts, digests, copies = batch["text"].tolist(), batch["digest"].tolist(), batch["copies"].to_numpy(np.int64)
            start = 0
            while start < len(texts):
                end, taken = start, 0
                while end < len(texts) and (end == start or taken + len(texts[end]) <= STEP_BYTES):
                    taken += len(texts[end])
                    end += 1
                good, *rest = align(texts[start:end], a, b)
                if len(good):
                    done.append(([digests[start + k] for k in good], copies[start + good], *rest))
                    size += taken
                start = end
                if size >= BLOCK_BYTES:
                    yield _packed(number, done)
                    number, done, size = number + 1, [], 0
        if done:
            yield _packed(number, done)

    return texts.mapInPandas(run, _BLOCK)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, pair, n, highest): rows of the corpus that hold the ids linked, and whether no other id is linked with a more often."""
    held = blocks.select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.held").alias("held"))
    counts = held.groupBy("pair").agg(F.sum("held").alias("n")).withColumn("a", F.shiftright("pair", 32))
    counts = materialise(counts, "pair-counts")
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    return counts.join(top, "a").select("a", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"), "pair", "n", (F.col("n") == F.col("top")).alias("highest"))


def _measured(blocks: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """The measures of the texts of one block, from the counts of its pairs."""
    block, counts = blocks.iloc[0], counts.sort_values("pair")
    n_pairs = np.asarray(block["n_pairs"], np.int64)
    begins = np.concatenate(([0], np.cumsum(n_pairs)))[:-1]
    steps, times = _numbers(block["places"]), _numbers(block["times"]).astype(np.int64)
    total = np.cumsum(steps)
    place = total - np.repeat(total[begins] - steps[begins], n_pairs)
    n, highest = counts["n"].to_numpy(np.int64)[place], counts["highest"].to_numpy(bool)[place]
    out = {c: block[c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
    return pd.DataFrame({"digest": block["digests"], **out, "n_best": np.add.reduceat(times * highest, begins), "count_sum": np.add.reduceat(times * n, begins)})


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_a and n_b count tokens, n_groups the stretches between shared ends, n_links the linked pairs of tokens. A pair of ids counts
    once for each row of ``docs`` that holds it linked; count_sum adds the counts over a document's links, n_best counts the links
    whose count is the highest of their A id. A text that is null, empty or not written down in full by both tokenizers has
    no tokens: zeros and an empty string. Ids may repeat or be null; an empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    texts = rows.filter("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    with scope(docs.sparkSession, keep=("aligned", "pair-counts")):
        blocks = materialise(aligned_blocks(texts.select("text", digest, "copies"), a_path, b_path), "aligned")
        counts = pair_counts(blocks).select("pair", "n", "highest")
    asked = blocks.select(F.col("block").alias("of"), F.explode("pairs").alias("pair")).join(counts, "pair")
    found = blocks.drop("pairs", "held").groupBy("block").cogroup(asked.groupBy("of")).applyInPandas(
        _measured, "digest binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    out = rows.select("doc_id", digest).join(found, "digest", "left")
    return out.select("doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in MEASURES], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
