"""A training corpus from ``documents`` in five stages.

language ID > exact de-duplication > near de-duplication > mixing > packing. Each stage takes what its
predecessor kept; all but the last return the columns of ``documents``. Every stage's result is
written as Parquet and read again, so a lost executor costs at most the stage at work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entityframes.llm import exact_dedup, language, mixing, near_dedup, packing
from entityframes.llm.common import materialise
from entityframes.llm.queries import MIX_WEIGHTS, mix_domain, tokenizer_path
from entityframes.storage import scope

LEAST_LANGUAGE_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and texts of which no known language is likely."""
    model = language.fit(docs, ~language.held_out("doc_id", 4, 2))
    found = language.identify(docs, model, names=("__lang_pred", "__lang_score"))
    return found.filter((F.col("__lang_pred") != language.UNDETERMINED) & (F.col("__lang_score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of equal texts."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each near-duplicate component (five-word shingles, similarity 0.8)."""
    return near_dedup.drop_near_copies(docs, width=5, percent=80)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps four fifths of the tokens, chosen so that the mix comes as near to the target weights as one epoch allows."""
    chosen = mixing.mix(docs, mix_domain(), MIX_WEIGHTS, share_of_tokens=(4, 5), max_epochs=1, seed="corpus")
    chosen = chosen.filter("copies > 0").select(F.col("doc_id").alias("__id"))
    return docs.join(chosen, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens; the last stage, one row per piece."""
    return packing.pack_documents(docs, tokenizer_path(), capacity=4096)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language ID", language_id),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("mixing sources to target weights", mixing_sources),
    ("best-fit packing", packed),
]

#: SQL has no language model, MinHash components or tokenizer; tests/llm compares with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        table = name.replace(" ", "-")
        with scope(spark, keep=(table,)):
            docs = materialise(stage(spark, docs, sf_dir), table)
    return STAGES[-1][1](spark, docs, sf_dir)
