"""Quality of documents by a linear-chain conditional random field over their lines.

Every line is good or bad. Its state depends on features of the line itself and of the lines before and
after it, and on the state of the line before. Forward-backward gives each line's marginal; a
document's score is the mean marginal of *good*, weighted by line length.

Labels exist for documents only. In training, each line of the sample carries its document's label, and
the weights (features and transitions) maximise the regularised conditional likelihood. The sample is
bounded by ``most_rows`` and, of each of its texts, by ``most_lines`` lines that follow one another: their features are
computed where the text lies, so the driver gets at most 4 * N_FEATURES * most_lines * 2 * most_rows bytes. Scoring
reads every line of every text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, word_hashes

OWN = ("symbols", "pipes", "capitals", "digits", "repeated words", "repeated line", "log length", "short", "ends a sentence", "capital start", "long words", "no words")
N_FEATURES = 3 * len(OWN) + 1
_CELLS = 1 << 18  # of a padded batch


def _byte_class(members: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(members.encode())] = 1
    return out


_SYMBOLS, _PIPES, _DIGITS = _byte_class("*&%#$@^~<>=_{}[]\\"), _byte_class("|"), _byte_class("0123456789")
_CAPITALS = _byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTERS = _byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_ENDS = _byte_class(".!?\"'):;")
_LEAD = np.array([0 if 0x80 <= b < 0xC0 else 1 for b in range(256)], np.int64)  # a byte that begins a character


def line_features(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line, its length in characters, number of lines of each text); lines end at \\n."""
    lines = [raw.split(b"\n") for raw in raws]
    n_lines = np.array([len(x) for x in lines])
    flat = [line for text in lines for line in text]
    sizes = np.array([len(x) + 1 for x in flat])
    data = np.frombuffer(b"\n".join(flat) + b"\n", np.uint8)
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    count = lambda table: np.add.reduceat(table[data], starts)
    chars = count(_LEAD) - 1
    letters, size = count(_LETTERS) + (sizes - 1 - count(_LEAD) + 1), np.maximum(chars, 1)
    words, n_words = word_hashes(flat)
    twice = np.zeros(len(words), np.int64)
    line_of = np.repeat(np.arange(len(flat)), n_words)
    if len(words) > 1:
        twice[1:] = (words[1:] == words[:-1]) & (line_of[1:] == line_of[:-1])
    repeated_words = np.bincount(line_of, weights=twice, minlength=len(flat)) / np.maximum(n_words, 1)
    repeated_line = np.empty(len(flat))
    at = 0
    for text in lines:
        seen: dict[bytes, int] = {}
        for line in text:
            seen[line] = seen.get(line, 0) + 1
        repeated_line[at : at + len(text)] = [seen[line] > 1 and len(line) > 0 for line in text]
        at += len(text)
    first = data[starts]
    last = np.where(sizes > 1, data[starts + sizes - 2], 0)
    own = np.stack([
        np.minimum(count(_SYMBOLS) / np.maximum(n_words, 1), 4), np.minimum(count(_PIPES) / np.maximum(n_words, 1), 2) * 2,
        count(_CAPITALS) / np.maximum(letters, 1) * 2, count(_DIGITS) / size * 2, repeated_words * 3, repeated_line,
        np.log1p(chars) / 5, chars < 30, _ENDS[last], _CAPITALS[first], np.minimum(chars / np.maximum(n_words, 1) / 12, 2), n_words == 0,
    ], axis=1).astype(np.float64)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    heads = np.concatenate(([0], np.cumsum(n_lines)))
    before[heads[:-1]] = 0
    after[heads[1:] - 1] = 0
    return np.hstack((own, before, after, np.ones((len(own), 1)))), np.maximum(chars, 1), n_lines


def _padded(values: np.ndarray, n_lines: np.ndarray, of: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents of ``of`` x ``width`` values, mask, flat positions)."""
    heads = np.concatenate(([0], np.cumsum(n_lines)))[:-1][of]
    mask = np.arange(width)[None, :] < n_lines[of][:, None]
    at = np.minimum(heads[:, None] + np.arange(width)[None, :], len(values) - 1)
    return values[at], mask, at


def _batches(n_lines: np.ndarray) -> Iterator[np.ndarray]:
    """Documents of like numbers of lines together, so that padding stays small and memory bounded."""
    order, start = np.argsort(n_lines, kind="stable"), 0
    while start < len(order):
        end = start + 1
        while end < len(order) and (end + 1 - start) * n_lines[order[end]] <= _CELLS:
            end += 1
        yield order[start:end]
        start = end


def forward_backward(emit: np.ndarray, mask: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log forward, log backward and log partition of two-state chains.

    ``emit`` (documents, lines) is the score of *good* over *bad*; ``trans`` (2, 2) the transition scores.
    """
    d, t = emit.shape
    e = np.stack((np.zeros((d, t)), emit), axis=2)
    alpha, beta = np.empty((d, t, 2)), np.zeros((d, t, 2))
    alpha[:, 0] = e[:, 0]
    for k in range(1, t):
        a = np.stack([np.logaddexp(alpha[:, k - 1, 0] + trans[0, j], alpha[:, k - 1, 1] + trans[1, j]) for j in (0, 1)], axis=1) + e[:, k]
        alpha[:, k] = np.where(mask[:, k, None], a, alpha[:, k - 1])
    for k in range(t - 2, -1, -1):
        nxt = beta[:, k + 1] + e[:, k + 1]
        b = np.stack([np.logaddexp(trans[i, 0] + nxt[:, 0], trans[i, 1] + nxt[:, 1]) for i in (0, 1)], axis=1)
        beta[:, k] = np.where(mask[:, k + 1, None], b, 0.0)
    return alpha, beta, np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])


@dataclass
class Field:
    weights: np.ndarray
    trans: np.ndarray

    def marginals(self, features: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
        """The probability of *good* of every line."""
        emit, out = features @ self.weights, np.empty(len(features))
        for of in _batches(n_lines):
            width = int(n_lines[of].max())
            e, mask, at = _padded(emit, n_lines, of, width)
            alpha, beta, z = forward_backward(e, mask, self.trans)
            p = np.exp(np.minimum(alpha[:, :, 1] + beta[:, :, 1] - z[:, None], 0.0))
            out[at[mask]] = p[mask]
        return out

    def scores(self, raws: list[bytes]) -> np.ndarray:
        features, length, n_lines = line_features(raws)
        heads = np.concatenate(([0], np.cumsum(n_lines)))[:-1]
        good = self.marginals(features, n_lines)
        return np.clip(np.add.reduceat(good * length, heads) / np.add.reduceat(length, heads), 0.0, 1.0)


def train(features: np.ndarray, n_lines: np.ndarray, labels: np.ndarray, steps: int, rate: float, l2: float) -> Field:
    """Adam on the mean regularised log-likelihood a line; both labels weigh the same in total."""
    truth = np.repeat(labels, n_lines).astype(np.float64)
    share = {v: max(1, int((labels == v).sum())) for v in (0, 1)}
    weight = np.array([len(labels) / (2 * share[int(v)]) for v in labels]) / n_lines
    groups = list(_batches(n_lines))
    theta = np.zeros(N_FEATURES + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        emit, trans, grad = features @ theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2), np.zeros_like(theta)
        g_emit, g_trans = np.zeros(len(features)), np.zeros((2, 2))
        for of in groups:
            e, mask, at = _padded(emit, n_lines, of, int(n_lines[of].max()))
            alpha, beta, z = forward_backward(e, mask, trans)
            w = weight[of][:, None]
            p = np.exp(np.minimum(alpha[:, :, 1] + beta[:, :, 1] - z[:, None], 0.0))
            y = truth[at]
            g_emit[at[mask]] = ((y - p) * w)[mask]
            es = np.stack((np.zeros_like(e), e), axis=2)
            link = mask[:, 1:]
            for i in (0, 1):
                for j in (0, 1):
                    joint = np.exp(np.minimum(alpha[:, :-1, i] + trans[i, j] + es[:, 1:, j] + beta[:, 1:, j] - z[:, None], 0.0))
                    actual = (y[:, :-1] == i) & (y[:, 1:] == j)
                    g_trans[i, j] += (((actual - joint) * w) * link).sum()
        grad[:N_FEATURES] = features.T @ g_emit
        grad[N_FEATURES:] = g_trans.ravel()
        grad = grad / len(labels) - l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2))


def fit(docs: DataFrame, labels: DataFrame, eligible: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = 3000, most_lines: int = 400, steps: int = 150, rate: float = 0.1, l2: float = 1e-3, seed: int = 5) -> Field:
    """Fit on ``eligible`` rows of ``labels`` (id, label 0 or 1), about ``most_rows`` of them drawn by hash.

    Rows whose label is null or another number, or whose text is null, are not learned from, and neither are ids that
    have both labels. Of several texts with one id the first in order counts. Without any row every score is 0.5.
    """
    blank = Field(np.zeros(N_FEATURES), np.zeros((2, 2)))
    known = labels.filter(eligible & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"), F.max(label_col).cast("int").alias("other"))
    known = known.filter("label = other").drop("other")
    total = known.count()
    if not total:
        return blank
    limit = int(min(1.0, most_rows / total) * (1 << 20))
    drawn = known.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < limit).limit(2 * most_rows)
    # the drawn labels are at most 2 * most_rows rows, a proven bound for the broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null").join(F.broadcast(drawn), "id")
    rows = rows.groupBy("id", "label").agg(F.min("text").alias("text"))

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for start, raws in blocks(batch["text"].tolist()):
                features, _, n_lines = line_features(raws)
                head = 0
                for raw, n in zip(raws, n_lines.tolist(), strict=True):
                    first = head + (zlib.crc32(raw) % (n - most_lines + 1) if n > most_lines else 0)
                    out.append(features[first : first + min(n, most_lines)].astype("<f4").tobytes())
                    head += n
            yield pd.DataFrame({"id": batch["id"].to_numpy(), "label": batch["label"].to_numpy(), "features": out})

    kind = docs.schema[id_col].dataType.simpleString()
    sample = rows.mapInPandas(windows, f"id {kind}, label int, features binary").toPandas().sort_values("id").reset_index(drop=True)
    if not len(sample):
        return blank
    found = [np.frombuffer(x, "<f4").reshape(-1, N_FEATURES) for x in sample["features"]]
    return train(np.concatenate(found).astype(np.float64), np.array([len(x) for x in found]), sample["label"].to_numpy(), steps, rate, l2)


def score(docs: DataFrame, field: Field, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= ``threshold``).

    Null and empty texts are one empty line. Whole texts are read; columns named score or predicted are
    replaced, all others stay.
    """

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        out = np.empty(len(texts))
        for start, raws in blocks(texts.tolist()):
            out[start : start + len(raws)] = field.scores(raws)
        return pd.Series(out)

    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    return docs.select(*kept, scored(F.col(text_col)).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
