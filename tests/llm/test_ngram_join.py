"""The n-gram join against brute force, its bounds, and groups that are built to be hard."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from entityframes.llm import ngram_join, queries
from entityframes.llm.near_dedup import _unique_sets
from tests.llm.test_small_cases import brute_components

LONG = "lorem ipsum dolor " * 20_000


def groups(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def hard_rows(seed):
    """Copies at every distance around the threshold, shared passages, sizes at the edge of a band, chains."""
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts, passage = [], fresh(60)
    for size in (6, 9, 20, 60, 100):
        base = fresh(size)
        texts += [edited(base, rng, k) for k in range(7) for _ in range(3)]
        texts += [base + fresh(k) for k in range(0, size // 2, max(1, size // 12))]
    texts += [fresh(rng.randrange(10, 80)) + passage + fresh(rng.randrange(40)) for _ in range(40)]
    chain = fresh(80)
    for _ in range(15):
        chain = chain[3:] + fresh(3)
        texts.append(chain)
    return [(k, " ".join(t)) for k, t in enumerate(texts)]


def test_query_equals_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert groups(queries.QUERIES["op13_ngram_jaccard_join"](spark, sf)) == brute_components(rows, 5, 80)


@pytest.mark.parametrize("block, rounds, frequent", [(2048, (4, 256, None), 8), (3, (1, 2, None), 2)])
def test_hard_groups(spark, monkeypatch, block, rounds, frequent):
    """Small blocks and few partners at a time, so that every tile is cut and every round is needed."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    monkeypatch.setattr(ngram_join, "LOCALLY_FREQUENT", frequent)
    rows = hard_rows(block)
    want = brute_components(rows, 5, 80)
    assert len({c for _, c in want.values()}) > 60
    assert groups(ngram_join.jaccard_groups(frame(spark, rows))) == want


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b c"), (5, "A  b\tc"), (6, LONG), (7, LONG), (7, LONG), (8, "é́ ß \U0001f600"), (9, "x" * 70_000), (None, "a b c"), (None, "alone here"), (None, None)]
    df = frame(spark, rows).withColumns({c: F.lit("mine") for c in ("rep", "key", "n", "signature", "component", "prefix", "n_shingles")})
    out = ngram_join.jaccard_groups(df)
    assert out.count() == len(rows)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.filter("doc_id is not null").collect()}
    assert found == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (3, 6), 7: (3, 6), 8: (1, 8), 9: (1, 9)}
    assert {(r["n_shingles"], r["component_id"]) for r in out.filter("doc_id is null").collect()} == {(1, 4), (1, None), (0, None)}
    assert ngram_join.jaccard_groups(df.limit(0)).count() == 0


def test_bits_bound_the_overlap_from_above():
    rng = random.Random(3)
    for size in (1, 5, 40, 700, 6000):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size + 4)]
        raws = [" ".join(base).encode(), " ".join(edited(base, rng, max(1, size // 20))).encode(), " ".join(base[: size // 2 + 5]).encode()]
        hashes, counts, some = _unique_sets(raws, 5)
        sets = [set(x.tolist()) for x in np.split(hashes, np.cumsum(counts)[:-1])]
        bits = ngram_join.parities(hashes, counts[some])
        for x in range(3):
            for y in range(3):
                width = min(len(bits[x]), len(bits[y]))
                most = ngram_join.overlap_bound(ngram_join.folded([bits[x]], width), ngram_join.folded([bits[y]], width), np.array([counts[x] + counts[y]]))[0]
                assert most >= len(sets[x] & sets[y]) and (x != y or most == counts[x])


def test_rows_grow_with_the_group(spark):
    """A group of near copies hands out a number of pairs in proportion to its size, not to its square."""
    rng, n_pairs = random.Random(4), []
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    for n in (100, 200):
        seen = []
        real = ngram_join.confirmed

        def counted(pairs, *rest, real=real, seen=seen):
            seen.append(pairs.count())
            return real(pairs, *rest)

        ngram_join.confirmed = counted
        try:
            out = groups(ngram_join.jaccard_groups(frame(spark, [(k, " ".join(edited(base, rng, 1))) for k in range(n)])))
        finally:
            ngram_join.confirmed = real
        assert {c for _, c in out.values()} == {0}
        n_pairs.append(sum(seen))
    assert n_pairs[1] < 2.6 * n_pairs[0] and n_pairs[1] < 200 * 5
