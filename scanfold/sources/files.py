"""Source trees and JSON-lines requests as file rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfold.functions.paths import detect_language, is_supported


def read_tree(spark: SparkSession, root: str, org: str, repo: str) -> DataFrame:
    """Every supported, non-empty file below a folder, one row each.

    Read as bytes, so that file lengths prune before the content is decoded.
    """
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
           .filter((F.col("length") > 0) & is_supported(F.col("path"))))
    return raw.select(
        F.xxhash64("path").alias("file_id"), F.lit(org).alias("org"), F.lit(repo).alias("repo"),
        F.lit(None).cast("int").alias("pr_number"), F.col("path").alias("file_path"),
        detect_language(F.col("path")).alias("language"), F.decode("content", "utf-8").alias("code"))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Scan requests stored as JSON lines."""
    schema = ("file_id long, org string, repo string, pr_number int, commit_sha string, author string, "
              "file_path string, language string, code string")
    rows = spark.read.schema(schema).json(path)
    return rows.filter(F.coalesce("code", F.lit("")) != "").withColumn(
        "language", F.coalesce("language", detect_language(F.col("file_path"))))
