"""The operators as queries over the given tables, and SQL that recomputes those it can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from scanfold.llm import (
    byte_cnn, chunk_encode, disclosure, embedding_whitening, license_scan, line_dedup, merkle_manifest, ngram_join, order_minhash, packing,
    phrase_index, quality_rules, secret_scan,
)
from scanfold.ship import ship

Query = Callable[[SparkSession, str], DataFrame]


def _with_package(query: Query) -> Query:
    """The query, with this package sent to the Python workers first."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)
    return run


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_disclosure": _with_package(disclosure.op3_disclosure),
    "op4_order_minhash": order_minhash.op4_order_minhash,
    "op5_packing": _with_package(packing.op5_packing),
    "op6_chunk_encode": _with_package(chunk_encode.op6_chunk_encode),
    "op7_ngram_join": _with_package(ngram_join.op7_ngram_join),
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_byte_cnn": _with_package(byte_cnn.op10_byte_cnn),
    "op11_embedding_whitening": _with_package(embedding_whitening.op11_embedding_whitening),
    "op12_phrase_index": _with_package(phrase_index.op12_phrase_index),
    "op13_merkle_manifest": _with_package(merkle_manifest.op13_merkle_manifest),
}
ORACLES = {
    "op1_license_scan": license_scan.ORACLE,
    "op2_quality_rules": quality_rules.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
}
