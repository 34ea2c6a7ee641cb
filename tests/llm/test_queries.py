"""The registered queries on test tables, and the pipeline against a brute-force version."""

import hashlib
import re
import struct
import zlib
from html import unescape

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from entityframes.llm import language, mixing, near_dedup, queries, secrets
from tests.llm.test_small_cases import brute_components, check_packing, lm_brute, mix_brute, secret_forms

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def same(rows, other):
    key = lambda r: tuple(str(v) for _, v in sorted(r.items()))
    return sorted(map(key, rows)) == sorted(map(key, other))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, sf, name):
    got = [r.asDict() for r in queries.QUERIES[name](spark, sf).collect()]
    db = duckdb.connect()
    for table in ("documents", "conversations"):
        db.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    found = db.execute(queries.ORACLE[name])
    columns = [c[0] for c in found.description]
    assert same(got, [dict(zip(columns, r, strict=True)) for r in found.fetchall()])


def test_one_query_for_each_operator():
    assert sorted(int(n.split("_")[0][2:]) for n in queries.QUERIES) == list(range(1, 14))


def plain_spans(text):
    """The contract of the base kinds, written anew."""
    rules = [("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
             ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16)]
    found = [(m.start(), k, m.end(), name) for k, (name, rule, group, least) in enumerate(rules) for m in re.finditer(rule, text) if len(m[group]) >= least]
    return [f"{name}:{start}:{end}" for start, _, end, name in sorted(found)]


def test_secrets_of_documents(spark, sf, tmp_path):
    """The given documents with every form of a key planted into some of them."""
    rows = [list(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    planted = {}
    for r, (_, text, kind, own) in zip(rows, secret_forms(), strict=False):
        at = len(r[1] or "") // 2
        r[1] = f"{(r[1] or '')[:at]}\n{text}\n{(r[1] or '')[at:]}"
        begin = at + 1 + text.index(own)
        planted[r[0]] = f"{kind}:{begin}:{begin + len(own)}"
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.QUERIES["op3_secret_scans"](spark, str(tmp_path)).collect()
    texts = dict(rows)
    assert len(out) == len(texts) and len(planted) > 15
    for r in out:
        base = plain_spans(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(spans) == {*base, *([planted[r["doc_id"]]] if r["doc_id"] in planted else [])}, r["doc_id"]
        assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), secrets._RANK[s.split(":")[0]], int(s.split(":")[2])))
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")]


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_near_documents_equal_brute_force(spark, sf, size):
    sf = sf.replace("sf0.001", size)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = queries.QUERIES["op2_minhash_near_dedup"](spark, sf).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute_components(rows, 4, 80)


def test_held_out_quality(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")  # more held-out labels
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = queries.QUERIES["op8_quality_classifier"](spark, sf).join(labels, "doc_id").filter("held_out")
    assert out.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.97  # of label 1 alone: 0.85


def test_pages_equal_their_articles(spark, sf):
    out = queries.QUERIES["op4_html_extraction"](spark, sf)
    assert out.count() == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert out.filter("n_chars <> length(text)").count() == 0
    got = {r["page_id"]: r["text"] for r in out.collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inside = r["html"].partition("<article>")[2].partition("</article>")[0].replace("<br>", " ")
        blocks = [" ".join(unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inside)]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


def test_scores_of_documents_equal_brute_force(spark, sf):
    """Words of the given documents hold no white space but spaces and line ends, so ``split`` tells them."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    wanted = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
    want = {i: (n, score) for i, n, score in lm_brute(rows, wanted)}
    out = queries.QUERIES["op6_lm_scoring"](spark, sf).collect()
    assert len(out) == len(rows)
    for r in out:
        n, score = want[str(r["doc_id"])]
        assert r["n_tokens"] == n and (not n or r["score"] == pytest.approx(score, abs=1e-6))


def test_packing_of_documents(spark, sf):
    """Every piece against the tokenizer, and no more sequences than plain best fit over the whole table needs."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = queries.QUERIES["op9_best_fit_packing"](spark, sf).collect()
    by_doc, by_seq = check_packing(rows, out, 4096)
    ids = {i: [*t.encode(text or "", add_special_tokens=False).ids, 1] for i, text in rows}
    for r in out:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == 4096 * r["piece"] and len(piece) == r["length"] and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(piece)}I", *piece))
    assert {i: len(parts) for i, parts in by_doc.items()} == {i: -(-len(x) // 4096) for i, x in ids.items()}
    space: list[int] = []
    for n in sorted((r["length"] for r in out), reverse=True):
        fits = [k for k, left in enumerate(space) if left >= n]
        if fits:
            space[min(fits, key=lambda k: space[k])] -= n
        else:
            space.append(4096 - n)
    assert -(-sum(r["length"] for r in out) // 4096) <= len(by_seq) <= len(space)


def test_media_of_documents(spark, sf):
    out = {r["doc_id"]: r for r in queries.QUERIES["op10_media_columns"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        raw = (r["text"] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        got = out.pop(r["doc_id"])
        assert got["ok"] and (got["n_bytes"], got["payload_bytes"]) == (len(raw), len(payload))
        assert (got["payload_sha256"], got["tail_crc32"]) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert got["duration_us"] == len(payload) * 125
    assert not out


def documents(spark, sf, path):
    base = spark.read.parquet(f"{sf}/documents.parquet").limit(120).collect()
    rows = [tuple(r) for r in base]
    n = 10_000
    for r in base[:30]:
        words = r["text"].split()
        rows.append((n, r["text"].replace(" ", "  "), r["lang"], "src0", 0))
        rows.append((n + 1, " ".join([*words, "tail"]), r["lang"], "src2", 0))
        n += 2
    rows += [(n, None, "en", "src0", 0), (n + 1, "", "en", "src1", 0), (n + 2, "1234 ---", None, None, None)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    return rows


def test_pipeline_equals_brute_force(spark, sf, tmp_path):
    rows = documents(spark, sf, str(tmp_path))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = language.fit(docs, ~language.held_out("doc_id", 4, 2))
    known = []
    for r in rows:
        lang, score = model.predict(r[1])
        if lang != "und" and score >= corpus_pipeline.LEAST_LANGUAGE_SCORE:
            known.append(r)
    assert len(known) == len(rows) - 3
    first = {}
    for r in sorted(known):
        first.setdefault(" ".join(f" {r[1]} ".split()), r)
    distinct = list(first.values())
    components = brute_components([(r[0], r[1]) for r in distinct], 5, 80)
    kept = [r for r in distinct if components[r[0]][1] == r[0]]
    domain = lambda s: "crawl" if s == "src0" else "sites" if s in {f"src{k}" for k in range(1, 10)} else "other"
    chosen = mix_brute([(r[0], domain(r[3]), r[2], r[3], len(r[1].split())) for r in kept], queries.MIX_WEIGHTS, (4, 5), 1, "corpus")
    want = {i for i, (_, copies) in chosen.items() if copies}
    assert {r["doc_id"] for r in out} == want and 0 < len(want) < len(kept) < len(known)
    by_doc, by_seq = check_packing(rows, out, 4096)
    assert sum(r["length"] for r in out) > 0 and len(by_seq) <= -(-sum(r["length"] for r in out) // 4096) + 1


def test_stages_keep_columns_and_take_odd_rows(spark, sf, tmp_path):
    rows = [(1, None, "en", "src0", 0), (1, None, "en", "src0", 0), (None, "the plain words of a text", "en", None, 5), (3, "the plain words of a text", None, "src1", 5), (4, "words " * 50_000, "en", "src2", 5), (5, "", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("kept", "score", "copies", "n_tokens", "rep", "key", "domain")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert out.count() <= len(rows) and stage(spark, docs.limit(0), sf).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= len(rows)


def test_held_out_rows_are_those_of_the_checksum(spark):
    df = spark.range(100).select(F.col("id").alias("doc_id"))
    got = {r["doc_id"] for r in df.filter(language.held_out("doc_id", 4, 2)).collect()}
    assert got == {i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2}


def test_signature_distance_guarantee():
    """Signatures that differ in at most r values share a bucket."""
    import numpy as np

    rng = np.random.default_rng(1)
    n = near_dedup.CHUNKS * near_dedup.WIDTH
    r = near_dedup.CHUNKS * (near_dedup.ERRORS + 1) - 1
    for _ in range(200):
        a = rng.integers(0, 1 << 16, (1, n)).astype(np.uint64)
        b = a.copy()
        b[0, rng.permutation(n)[:r]] ^= np.uint64(1)
        keys = [near_dedup.bucket_keys(x, near_dedup.CHUNKS, near_dedup.WIDTH, near_dedup.ERRORS)[0] for x in (a, b)]
        assert (keys[0] == keys[1]).any()


def test_mix_weights_name_paths():
    assert all(len(k) <= len(mixing.LEVELS) and v > 0 for k, v in queries.MIX_WEIGHTS.items())
