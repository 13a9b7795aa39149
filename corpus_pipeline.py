"""From raw documents to packed training windows, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written to
the shared folder and read back as the next stage's docs. All but the last give
the columns of docs:

1. quality rules: documents that a rule rejects go (never those that fail none);
2. line dedup: later occurrences of repeated three-line windows are cut out, and
   documents of which nothing is left go;
3. n-gram Jaccard join: of documents that share 0.8 of their five-word shingles,
   directly or by way of others, the one with the smallest doc_id stays;
4. secret scans: secrets in the text are masked, the documents stay;
5. packing: pieces of the documents in windows of 2,048 tokens, every source in
   its proportion, with the piece's ids.

n_chars, where there is one, follows the text. Null texts count as empty and
fail the quality rules; an empty table gives an empty result; columns that no
stage knows pass through to the fourth.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfold.llm import line_dedup, ngram_join, packing, quality_rules, secret_scan
from scanfold.llm.common import BLANKS, fresh
from scanfold.ship import ship
from scanfold.sources.tables import shared_folder, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lost = fresh(docs, "n_removed")
    cut = line_dedup.dedup_lines(docs, lost)
    left = cut.where((F.col(lost) == 0) | (F.btrim("text", F.lit(BLANKS)) != ""))
    return secret_scan.with_length(left, docs).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return ngram_join.keep_one(docs, size=5, percent=80)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.mask_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs)


STAGES = [("quality rules", quality_stage), ("line dedup", line_stage), ("n-gram Jaccard join", near_duplicate_stage),
          ("secret scans", secret_stage), ("packing", packing_stage)]

#: The tokenizer can't be put in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        path = os.path.join(folder, f"stage-{k + 1}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
