"""The registered queries of the ten operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, conversations, exact_dedup, html, language, lm_scoring, media, mixing, near_dedup, ngram_join, packing, quality, secrets


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def mix_domain() -> Column:
    """The domain of a source: the crawl, ten hand-picked sites, and the other sources."""
    return F.when(F.col("source") == "src0", "crawl").when(F.col("source").rlike("^src[1-9]$"), "sites").otherwise("other")


MIX_WEIGHTS: mixing.Weights = {("crawl",): 2, ("sites",): 5, ("other",): 3} | {
    (domain, lang): weight for domain in ("crawl", "sites", "other") for lang, weight in (("en", 6), ("de", 2), ("fr", 2), ("es", 2))
}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), mix_domain(), MIX_WEIGHTS, share_of_tokens=(4, 5), max_epochs=2, seed="mix")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_table(spark, sf_dir, "documents"), width=4, percent=80)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.with_media(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "media")
    found = media.media_features(stored)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "ok", "duration_us")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.span_digest(secrets.find_secrets(_table(spark, sf_dir, "documents")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.fit(docs, ~language.held_out("doc_id", 4, 2))
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", language.held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held = language.held_out("doc_id", 5, 0)
    field = quality.fit(docs, labels, ~held)
    return quality.score(docs.select("doc_id", "text"), field, threshold=0.3).select("doc_id", held.alias("held_out"), "score", "predicted")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.main_text(_table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return lm_scoring.cross_entropy_difference(_table(spark, sf_dir, "documents").select("doc_id", "text"), good)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(_table(spark, sf_dir, "conversations"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(_table(spark, sf_dir, "documents"), width=5, percent=80)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_secret_scans": op3_secret_scans,
    "op4_html_extraction": op4_html_extraction,
    "op5_language_id": op5_language_id,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_media_columns": op10_media_columns,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_ngram_jaccard_join": op13_ngram_jaccard_join,
}


def _fill_sql(nodes: str, parents: list[str], child: str) -> str:
    """Water-filling of one level: ``nodes`` has the parents, child, capacity, weight and budget."""
    by = ", ".join(parents) or "0"
    order = f"PARTITION BY {by} ORDER BY weight = 0, capacity / greatest(weight, 1), {child} NULLS FIRST"
    return f"""
        SELECT *, CASE WHEN is_full THEN capacity WHEN weight > 0 THEN (first_open[2] * weight) // first_open[3] ELSE 0 END AS share
        FROM (
            SELECT *, min(CASE WHEN NOT is_full AND weight > 0 THEN [place, remaining, ahead] END) OVER (PARTITION BY {by}) AS first_open
            FROM (
                SELECT *, capacity * ahead <= remaining * weight AND weight > 0 AS is_full
                FROM (
                    SELECT *,
                           budget - coalesce(sum(CASE WHEN weight > 0 THEN capacity ELSE 0 END) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
                           sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead,
                           row_number() OVER ({order}) AS place
                    FROM ({nodes}))))
    """


def _mix_sql() -> str:
    lang_weight = "CASE lang WHEN 'en' THEN 6 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END"
    top = _fill_sql(
        """SELECT domain, sum(tokens * 2) AS capacity, CASE domain WHEN 'crawl' THEN 2 WHEN 'sites' THEN 5 ELSE 3 END AS weight,
                  least((SELECT (coalesce(sum(tokens), 0) * 4) // 5 FROM leaves), (SELECT sum(tokens * 2) FROM leaves)) AS budget
           FROM leaves GROUP BY domain""", [], "domain")  # fmt: skip
    middle = _fill_sql(
        f"""SELECT l.domain, l.lang, sum(l.tokens * 2) AS capacity, {lang_weight.replace("CASE lang", "CASE l.lang")} AS weight, any_value(t.share) AS budget
            FROM leaves l JOIN top_level t ON t.domain IS NOT DISTINCT FROM l.domain GROUP BY l.domain, l.lang""", ["domain"], "lang")  # fmt: skip
    low = _fill_sql(
        """SELECT l.domain, l.lang, l.source, l.tokens, l.tokens * 2 AS capacity, 1 AS weight, m.share AS budget
           FROM leaves l JOIN middle_level m ON m.domain IS NOT DISTINCT FROM l.domain AND m.lang IS NOT DISTINCT FROM l.lang""", ["domain", "lang"], "source")  # fmt: skip
    return rf"""
        WITH docs AS (
            SELECT doc_id, CASE WHEN source = 'src0' THEN 'crawl' WHEN regexp_matches(source, '^src[1-9]$') THEN 'sites' ELSE 'other' END AS domain, lang, source,
                   coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n_tokens
            FROM documents),
        leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM docs GROUP BY ALL),
        top_level AS ({top}), middle_level AS ({middle}), low_level AS ({low}),
        budgets AS (SELECT domain, lang, source, share, share // greatest(tokens, 1) AS epochs, share % greatest(tokens, 1) AS rest FROM low_level),
        ordered AS (
            SELECT d.*, b.share, b.epochs, b.rest,
                   coalesce(sum(n_tokens) OVER (PARTITION BY d.domain, d.lang, d.source ORDER BY sha256(concat('mix:', b.epochs::BIGINT, ':', d.doc_id)), d.doc_id
                                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM docs d JOIN budgets b ON b.domain = d.domain AND b.lang IS NOT DISTINCT FROM d.lang AND b.source IS NOT DISTINCT FROM d.source)
        SELECT doc_id, domain, lang, source, n_tokens, share::BIGINT AS leaf_budget,
               (CASE WHEN n_tokens > 0 THEN epochs + (before < rest)::INT ELSE 0 END)::BIGINT AS copies
        FROM ordered
    """


def _repair_sql() -> str:
    """The graph as a recursion: for each state the least of lpad(cost) || audit, one row of a conversation at a time."""
    edge = lambda path, cost, letter: f"lpad((left({path}, 10)::BIGINT + {cost})::VARCHAR, 10, '0') || substr({path}, 11) || '{letter}'"
    put = lambda path: edge(path, 3, "I")
    keep = lambda path, role: f"CASE WHEN NOT must_go AND initial = '{role}' THEN {edge(path, 'more', 'K')} END"
    turn = lambda path: f"CASE WHEN NOT must_go THEN {edge(path, '3 + more', 'R')} END"
    closed = f"""
        SELECT *, least(u1, {put("a1")}) AS u, least(a1, {put("u1")}) AS a
        FROM (SELECT *, least(u0, {put("none")}, {put("s")}, {put("a0")}) AS u1, least(a0, {put("u0")}) AS a1 FROM steps)"""
    return rf"""
        WITH RECURSIVE given AS (
            SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: unicode(x)::BIGINT) AS bytes
            FROM conversations),
        kinds AS (
            SELECT *, xor(4294967295, list_reduce(bytes, lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]),
                lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END), 4294967295::BIGINT)) % 20 AS kind
            FROM given),
        hurt AS (
            SELECT conv, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
            FROM kinds WHERE kind <> 0),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS place FROM hurt),
        marked AS (
            SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY place) AS initial_before,
                   CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                        WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY place) > 1 THEN 'duplicate'
                        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault
            FROM placed),
        edges AS (SELECT *, fault IN ('blank', 'duplicate') AS must_go, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS more FROM marked),
        steps AS (
            SELECT conv, 0::BIGINT AS i, '0000000000' AS none, NULL::VARCHAR AS s, NULL::VARCHAR AS u0, NULL::VARCHAR AS a0 FROM (SELECT DISTINCT conv FROM hurt)
            UNION ALL
            SELECT c.conv, c.i + 1, {edge("none", 4, "D")}, least({edge("s", 4, "D")}, {keep("none", "s")}),
                   least({edge("u", 4, "D")}, {", ".join(keep(x, "u") for x in ("none", "s", "a"))}, {", ".join(turn(x) for x in ("none", "s", "a"))}),
                   least({edge("a", 4, "D")}, {keep("u", "a")}, {turn("u")})
            FROM ({closed}) c JOIN edges e ON e.conv IS NOT DISTINCT FROM c.conv AND e.place = c.i + 1),
        ended AS (
            SELECT conv, left(least(none, a), 10)::BIGINT AS cost, substr(least(none, a), 11) AS audit
            FROM ({closed}) c WHERE i = (SELECT max(i) FROM steps t WHERE t.conv IS NOT DISTINCT FROM c.conv)),
        letters AS (SELECT conv, audit, unnest(range(1, length(audit) + 1)) AS k FROM ended),
        counted AS (
            SELECT conv, k, audit[k] AS letter, length(replace(audit[:k], 'I', '')) AS place, length(replace(audit[:k], 'D', '')) AS out_place FROM letters),
        written AS (
            SELECT l.*, e.role, e.text, max((letter = 'K' AND e.initial = 's')::INT) OVER (PARTITION BY l.conv) AS has_system
            FROM counted l LEFT JOIN edges e ON e.conv IS NOT DISTINCT FROM l.conv AND e.place = l.place AND l.letter <> 'I' WHERE letter <> 'D'),
        texts AS (
            SELECT conv, string_agg(CASE WHEN letter = 'K' THEN role WHEN (out_place - has_system) % 2 = 1 THEN 'user' ELSE 'assistant' END
                                    || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS content
            FROM written GROUP BY conv),
        faults AS (
            SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                   count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (initial_before IS NOT NULL AND initial_before || initial NOT IN ('su', 'ua', 'au')) AS illegal
            FROM edges GROUP BY conv)
        SELECT g.conv AS conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
               coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
               coalesce(audit, '') AS audit, sha256(coalesce(content, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv FROM given) g
        LEFT JOIN faults f ON f.conv IS NOT DISTINCT FROM g.conv
        LEFT JOIN ended d ON d.conv IS NOT DISTINCT FROM g.conv
        LEFT JOIN texts t ON t.conv IS NOT DISTINCT FROM g.conv
    """


ORACLE: dict[str, str] = {
    "op1_mixing": _mix_sql(),
    "op11_conversation_repair": _repair_sql(),
    "op7_exact_dedup": r"""
        SELECT doc_id,
               min(doc_id) OVER (PARTITION BY content) AS keep_id,
               count(*) OVER (PARTITION BY content) AS group_size,
               doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY content) AS kept,
               sha256(content) AS text_sha256
        FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content FROM documents)
    """,
}
