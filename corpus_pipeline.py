"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Every stage works on all rows its predecessor kept. Rows are dropped only by a stage's own decision: texts without a
letter, all but one of equal texts, all but one of each group of near duplicates, and what the mixture doesn't draw.
Null texts count as empty, columns beyond those of ``documents`` are left out, an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.llm import bpe, exact_dedup, langid, minhash_forest, raking
from watchloom.llm.common import read_table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
RANKS = "byte_bpe_50k.tiktoken"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the rows that name their language, drop texts without a letter, name the language where it is null.

    Where no row names one, the texts with letters are undetermined and stay.
    """
    docs = docs.select(*COLUMNS)
    model = langid.train(docs)
    if not model.languages:
        model = langid.NaiveBayes((langid.UNDETERMINED,), np.zeros((1, 1), np.float32), np.zeros(1))
    rows = langid.identify(docs, model).where("language.score > 0")  # 0 for texts without letters only
    return rows.withColumn("lang", F.coalesce("lang", "language.lang_pred")).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, that of the smallest id; of rows that repeat it, one."""
    named = lambda digest: F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), digest)
    kept = exact_dedup.exact_dedup(docs).where("kept").select(named(F.col("text_sha256")).alias("_row")).distinct()
    rows = docs.select(*COLUMNS, named(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("_row"))
    return rows.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: shingles of five words, similarity 0.8 or more."""
    dropped = minhash_forest.near_dedup(docs).where("not kept").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw documents so that sources, languages and topics have their target shares of the tokens."""
    topic, tokens = raking.topic_of(F.col("text")), raking.tokens_of(F.col("text"))
    return raking.with_mix(docs.select(*COLUMNS), topic, tokens, into="_mix").where("_mix.sampled").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of the ids and of the bytes they decode to."""
    import public_tokenizers

    return bpe.digests(bpe.bpe_encode(docs, public_tokenizers.path(RANKS), decoded=True), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("copies", drop_copies),
    ("near_copies", drop_near_copies),
    ("mix", mix),
    ("encode", encode),
]

#: Naive Bayes, near duplicates and merges have no twin in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, over the documents of a folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
