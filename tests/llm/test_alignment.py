"""Tokenizer alignment against a plain version that uses the named files with the named libraries, token by token."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from entityframes.llm import alignment, queries
from entityframes.llm.queries import tokenizer_path

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
ODD = [(1, None), (2, ""), (3, " "), (4, "a b c"), (4, "a b c"), (5, "a b c"), (6, "lorem ipsum dolor " * 6000), (None, "a b c"), (7, "é́ ß \U0001f600 中文\n\n\tx"),
       (8, "<|endoftext|> and <s> </s> <0x41> <unk>"), (9, "lower ▁ one eighth block"), (10, "x" * 30_000), (11, "  two  spaces "), (12, "\x00\x01 control"), (13, "don't 1234 !?"), (14, "Ünïcödé ﬁ ligature")]


def tokens(texts):
    """(ids, bytes of each) of both tokenizers for every text."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(tokenizer_path(A)), sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(B))
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
    for text in texts:
        one = a.encode(" " + text, add_special_tokens=False).ids
        two = b.encode(text)
        yield [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in one], [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, b.id_to_piece(i)) for i in two)]


def brute(rows):
    """The contract, row by row."""
    found, pairs = [], Counter()
    for (i, text), (one, two) in zip(rows, tokens([t or "" for _, t in rows]), strict=True):
        whole = f" {text or ''}".encode()
        if not text or b"".join(x for _, x in one) != whole or b"".join(x for _, x in two) != whole:
            found.append((i, 0, 0, None, []))
            continue
        spans = [[], []]
        for side, own in enumerate((one, two)):
            at = 0
            for token, raw in own:
                spans[side].append((at, at + len(raw), token))
                at += len(raw)
        links, groups, k = [], [([], [])], 0
        for lo, hi, token in spans[0]:
            while spans[1][k][1] <= lo:
                k += 1
            j = k
            while j < len(spans[1]) and spans[1][j][0] < hi:
                links.append((token, spans[1][j][2]))
                j += 1
        ends = {hi for _, hi, _ in spans[0]} & {hi for _, hi, _ in spans[1]}
        merged = sorted([(hi, 0, n, t) for n, (_, hi, t) in enumerate(spans[0])] + [(hi, 1, n, t) for n, (_, hi, t) in enumerate(spans[1])])
        open_ = None
        for hi, side, _, token in merged:
            if open_ is not None and hi > open_:
                groups.append(([], []))
                open_ = None
            groups[-1][side].append(str(token))
            if hi in ends:
                open_ = hi
        pairs.update(set(links))
        found.append((i, len(one), len(two), ";".join(f"{','.join(x)}|{','.join(y)}" for x, y in groups), links))
    best = {}
    for (a, _), n in pairs.items():
        best[a] = max(best.get(a, 0), n)
    return sorted(
        (str(i), n_a, n_b, groups.count(";") + 1 if groups else 0, len(links), sum(pairs[x] == best[x[0]] for x in links), sum(pairs[x] for x in links), hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        for i, n_a, n_b, groups, links in found
    )


def results(df):
    return sorted((str(r["doc_id"]), *(r[c] for c in (*alignment.MEASURES, "groups_sha256"))) for r in df.collect())


def test_query_equals_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert results(queries.QUERIES["op12_tokenizer_alignment"](spark, sf)) == brute(rows)


@pytest.mark.parametrize("block_bytes", [1, 16 << 20])
def test_odd_rows(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block_bytes)
    df = spark.createDataFrame(ODD, "doc_id long, text string").repartition(3).withColumns({c: F.lit("mine") for c in ("digest", "copies", "n_a", "pair", "block")})
    paths = tokenizer_path(A), tokenizer_path(B)
    got = results(alignment.align_tokenizers(df, *paths))
    assert got == brute(ODD)
    assert alignment.align_tokenizers(df.limit(0), *paths).count() == 0
    assert alignment.align_tokenizers(df.filter("text is null"), *paths).first()["groups_sha256"] == ""


def test_ids_are_those_of_the_named_file():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path(A))
    plain.encode_special_tokens = True
    texts = [t for _, t in ODD if t] + ["".join(map(chr, range(0x20, 0x3000, 7))), "a\n\n  b \t c" * 50, "I'LL we're  it's 'twas"]
    assert alignment.byte_level(tokenizer_path(A)).encode(texts) == [plain.encode(" " + t, add_special_tokens=False).ids for t in texts]
