"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

* Features: hashed character bigrams and trigrams of the lower-cased letters of the whole text, every
  other character counting as a word boundary; (1 + log tf) * idf, scaled to unit length.
* Document frequencies cover every eligible text of the table (a distributed count).
* Training: follow-the-regularised-leader (proximal) with an elastic-net penalty, on a bounded sample of
  labelled rows: about ``per_language`` rows of each label, and ``most_rows`` in all, drawn by hash. Every label of
  at least ``least_rows`` rows is learned. What the driver gets of a row is at most 4 * BUCKETS bytes.
* Calibration: one temperature, fitted on a part of the sample that the weights did not see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain

BUCKETS = 1 << 14
UNDETERMINED = "und"
_letters: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, 0 for everything else, with a 0 at both ends."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(len(raw) + 2, np.uint32)
    out[1:-1] = np.where(is_letter()[raw], raw, 0)
    return out


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, count) of the character n-grams of the whole text; empty without letters."""
    codes = _codes(text) if text else np.zeros(2, np.uint32)
    if not codes.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = codes[:-1], codes[1:]
    two = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77))
    three = (two[:-1] * np.uint32(0xC2B2AE3D)) ^ (codes[2:] * np.uint32(0x27D4EB2F)) ^ np.uint32(0x165667B1)
    seen_two, seen_three = (a | b) != 0, (codes[1:-1] != 0)
    h = np.concatenate((two[seen_two], three[seen_three]))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    counts = np.bincount(h >> np.uint32(18), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def vector(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1.0 + np.log(counts)) * idf[at]
    norm = np.sqrt((x * x).sum())
    return x / norm if norm > 0 else x


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (BUCKETS, languages)
    idf: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        at, counts = gram_counts(text)
        if not len(at) or not self.languages:
            return UNDETERMINED, 0.0
        logits = vector(at, counts, self.idf) @ self.weights[at]
        p = softmax(logits / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(samples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_labels: int, epochs: int, alpha: float, beta: float, l1: float, l2: float, seed: int) -> np.ndarray:
    """Weights of a multinomial logistic regression; most stay exactly 0 under ``l1``."""
    z, n = np.zeros((BUCKETS, n_labels)), np.zeros((BUCKETS, n_labels))
    rng = np.random.default_rng(seed)

    def weights(at):
        za, na = z[at], n[at]
        return np.where(np.abs(za) <= l1, 0.0, -(za - np.sign(za) * l1) / ((beta + np.sqrt(na)) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(samples)):
            at, x = samples[i]
            w = weights(at)
            p = softmax(x @ w)
            p[labels[i]] -= 1.0
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(BUCKETS))


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least cross-entropy, by golden-section search over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t):
        p = softmax(logits / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean()

    lo, hi, g = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(
    docs: DataFrame, eligible: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = 1000,
    most_rows: int = 8000, least_rows: int = 5, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.01, l2: float = 0.01, seed: int = 11,
) -> Model:
    """Fit on the rows with ``eligible``, a text and a label. Without any, the model knows no language.

    A label of fewer than ``least_rows`` rows is learned only where no label has as many.
    """
    rows = docs.filter(eligible & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    )
    # a label is a language, so the labels are few; stray values do not reach the least number
    counts = rows.groupBy("lang").count()
    sizes = counts.filter(F.col("count") >= least_rows).collect() or counts.filter(F.col("count") < least_rows).limit(1000).collect()
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0)), np.ones(BUCKETS), 1.0)
    languages = sorted(r["lang"] for r in sizes)

    def presence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, total = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                at, _ = gram_counts(text)
                seen[at] += 1
                total += 1
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(seen[at], total)})

    frequency = rows.select("text").mapInPandas(presence, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    found = np.zeros(BUCKETS)
    inside = frequency["bucket"] >= 0
    found[frequency.loc[inside, "bucket"]] = frequency.loc[inside, "n"]
    total = int(frequency.loc[~inside, "n"].sum())
    idf = np.log((1 + total) / (1 + found)) + 1

    # a hash below a language's rate: as many rows as wanted in expectation, whatever the table's size; equal rows count once
    wanted = min(per_language, most_rows / len(languages))
    rate = F.lit(0.0)
    for r in sizes:
        rate = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, wanted / r["count"]))).otherwise(rate)
    drawn = rows.withColumn("mark", F.xxhash64("id", "text", F.lit(seed))).filter(F.pmod("mark", F.lit(1 << 20)) < rate * (1 << 20)).dropDuplicates(["id", "lang", "mark"])

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            grams = [gram_counts(t) for t in batch["text"]]
            out = pd.DataFrame({"id": batch["id"], "lang": batch["lang"], "at": [g[0].astype("<u2").tobytes() for g in grams], "counts": [np.minimum(g[1], 65535).astype("<u2").tobytes() for g in grams]})
            yield plain(out, "id", "lang")

    sample = drawn.select("id", "text", "lang").mapInPandas(counted, "id string, lang string, at binary, counts binary").toPandas()
    sample = sample[[len(a) > 0 for a in sample["at"]]].sort_values(["id", "lang", "at"], na_position="last").reset_index(drop=True)
    if not len(sample):
        return Model([], np.zeros((BUCKETS, 0)), idf, 1.0)
    labels = sample["lang"].map({k: i for i, k in enumerate(languages)}).to_numpy()
    grams = [(np.frombuffer(a, "<u2").astype(np.int64), np.frombuffer(c, "<u2")) for a, c in zip(sample["at"], sample["counts"], strict=True)]
    xs = [(a, vector(a, c, idf)) for a, c in grams]
    held = np.arange(len(xs)) % 5 == 4
    weights = train_ftrl([x for x, h in zip(xs, held, strict=True) if not h], labels[~held], len(languages), epochs, alpha, beta, l1, l2, seed)
    logits = np.array([x @ weights[a] for (a, x), h in zip(xs, held, strict=True) if h])
    return Model(languages, weights, idf, fit_temperature(logits, labels[held]))


def identify(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its calibrated probability, under ``names``.

    A null text, a text without letters, or a model without languages gives ``und`` with score 0. Whole texts
    are read; columns named like ``names`` are replaced, all others stay.
    """
    model = Model(model.languages, model.weights.astype(np.float32), model.idf.astype(np.float32), model.temperature)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return plain(pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"]), "lang_pred")

    kept = [c for c in docs.columns if c not in names]
    found = docs.select(*kept, predict(F.col(text_col)).alias("__found"))
    return found.select(*kept, F.col("__found.lang_pred").alias(names[0]), F.col("__found.score").alias(names[1]))


def held_out(id_col: str = "doc_id", modulus: int = 4, remainder: int = 2) -> Column:
    """Rows that a model may not learn from: by the CRC-32 of the id as text. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))
