"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from watchloom.llm import bpe, exact_dedup, kdtree, langid, licenses, merkle, minhash_forest, phrases, quality, raking, simple8b, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": phrases.op1_fingerprints,
    "op2_warc": warc.op2_warc,
    "op3_token_ids": simple8b.op3_token_ids,
    "op4_language_id": langid.op4_language_id,
    "op5_mix_sources": raking.op5_mix_sources,
    "op6_kd_shards": kdtree.op6_kd_shards,
    "op7_bpe": bpe.op7_bpe,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_near_dedup": minhash_forest.op9_near_dedup,
    "op10_quality": quality.op10_quality,
    "op11_merkle": merkle.op11_merkle,
    "op12_whitening": whitening.op12_whitening,
    "op13_licenses": licenses.op13_licenses,
}

ORACLES: dict[str, str] = {
    "op2_warc": warc.OP2_SQL,
    "op5_mix_sources": raking.OP5_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op11_merkle": merkle.OP11_SQL,
}
