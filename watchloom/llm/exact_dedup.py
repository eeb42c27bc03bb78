"""Exact duplicates: groups by a 128-bit content hash whose members are compared byte by byte."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm.common import read_table


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (lowercase hex).

    The grouping key is the text's 128-bit hash together with the text, so Spark's aggregation compares the bytes of
    all rows with equal hashes and texts that merely collide come apart. Copies collapse in each map task before
    anything is shuffled: a group that holds a third of all rows sends one row per task. The rows then find their
    group by both digests, without their texts, and a skewed join splits a large group.

    ``keep`` says whether the smallest or the largest id of a group stays. Null texts count as empty; equal rows with
    the same id are one document, so all of them carry ``kept``; rows without an id are kept only where no row with
    one has their text, and then ``keep_id`` is null. Other columns are ignored, and an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.unhex(F.md5("text")).alias("hash"))
    best = F.max("doc_id") if keep == "largest" else F.min("doc_id")
    groups = (
        rows.groupBy("hash", "text").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("hash", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    members = rows.select("doc_id", "hash", F.sha2("text", 256).alias("text_sha256"))
    return members.join(groups, ["hash", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"), keep="largest")


OP8_SQL = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
       doc_id is not distinct from max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))
"""
