"""Helpers that several operators of this subpackage share.

* ``materialise`` (of the library) cuts lineage by writing a Parquet table into the shared folder that
  ``spark.checkpoint.dir`` names, so that a lost executor costs the rereading of files only.
* ``sized`` broadcasts a table behind a check of its row count; larger ones are shuffled.
* the ``Words`` block functions turn a batch of texts into word and shingle hashes with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise

__all__ = ["WHITE", "blocks", "materialise", "mix64", "plain", "shingles", "sized", "word_hashes"]

WHITE = r"[\x20\x09-\x0D]+"


def sized(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most_rows`` rows, else as it is.

    Counting makes a job, so ``df`` should be materialised. Without the hint Spark shuffles
    both sides, and adaptive execution splits the hot keys of such a join.
    """
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def blocks(texts: list[str | None], most_bytes: int = 1 << 21) -> Iterator[tuple[int, list[bytes]]]:
    """(first index, UTF-8 texts) of runs of at most ``most_bytes``; a longer text is a run of its own."""
    start, size, run = 0, 0, []
    for k, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        if run and size + len(raw) > most_bytes:
            yield start, run
            start, size, run = k, 0, []
        run.append(raw)
        size += len(raw) + 1
    if run:
        yield start, run


def plain(rows: pd.DataFrame, *names: str) -> pd.DataFrame:
    """``rows`` with the named text columns as Python objects: Arrow-backed ones can come in several chunks, which Spark refuses."""
    return rows.astype(dict.fromkeys(names, object))


_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        for k, base in enumerate((_BASE, inverse)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of each text); A-Z lower-cased, words split at white space."""
    joined = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    white = _IS_WHITE[joined]
    edge = np.diff(np.concatenate(([True], white)).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    bounds = np.cumsum([len(r) + 1 for r in raws])
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, bounds))))
    if not len(starts):
        return np.empty(0, np.uint64), counts
    power, inverse = _power_tables(len(joined) + 1)
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum((_LOWER[joined].astype(np.uint64) + np.uint64(1)) * power[: len(joined)], out=sums[1:])
    words = (sums[ends] - sums[starts]) * inverse[starts]
    return mix64(words ^ ((ends - starts).astype(np.uint64) * _MULT)), counts


def shingles(raws: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every shingle occurrence, number of them for each text).

    A text with fewer words than ``width`` has its whole sequence as one shingle; one without
    words has none.
    """
    words, counts = word_hashes(raws)
    n_out = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    if not len(words):
        return np.empty(0, np.uint64), n_out
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    offset = np.concatenate(([0], np.cumsum(n_out)))[:-1]
    at = np.repeat(first - offset, n_out) + np.arange(int(n_out.sum()))
    length = np.repeat(np.minimum(counts, width), n_out)
    out = mix64(length.astype(np.uint64) + _MULT)
    for k in range(width):
        inside = length > k
        step = mix64((out ^ words[np.minimum(at + k, len(words) - 1)]) * _MULT + np.uint64(k + 1))
        out = np.where(inside, step, out)
    return out, n_out
