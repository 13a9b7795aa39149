"""Sinks: tables that are committed together, and the scan tables stored that way."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfold.operators.contents import with_hits
from scanfold.operators.rollup import COUNTERS
from scanfold.operators.scan import explode_violations

MANIFEST = "manifest"


def _committed_runs(spark: SparkSession, path: str) -> DataFrame:
    """run -> the attempt that counts. Two writers that raced for a run may both be listed: every reader takes the same one.

    The condition, which always holds, makes Spark prune the partitions of a table joined to this.
    """
    return spark.read.parquet(f"{path}/{MANIFEST}").where("attempt > ''").groupBy("run").agg(F.min("attempt").alias("attempt"))


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def commit(tables: dict[str, DataFrame], path: str, run: str, partition_by: dict[str, list[str]] | None = None) -> bool:
    """Append the tables below ``path`` as one unit; False if this run is there already.

    Each attempt writes to partitions of its own. Its rows count once the manifest
    names it, which is the last and only step that readers see, so a writer that
    dies leaves nothing visible, and a repeated run changes nothing.
    """
    spark = next(iter(tables.values())).sparkSession
    done = f"{path}/{MANIFEST}/run={run}"
    if _exists(spark, f"{done}/_SUCCESS"):
        return False
    attempt = uuid.uuid4().hex
    for name, rows in tables.items():
        parts = (partition_by or {}).get(name, [])
        # Ids are hex text, which only a codec with an entropy coder makes smaller.
        (rows.withColumn("attempt", F.lit(attempt)).write.mode("append").partitionBy("attempt", *parts)
         .option("compression", "zstd").parquet(f"{path}/{name}"))
    spark.createDataFrame([(attempt,)], "attempt string").coalesce(1).write.mode("append").parquet(done)
    return True


def committed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of all committed runs; partitions of other attempts are not read."""
    runs = _committed_runs(spark, path).select("attempt")
    return spark.read.parquet(f"{path}/{name}").join(runs, "attempt", "left_semi").drop("attempt")


# --- scan tables ---------------------------------------------------------------

def identified(summarized: DataFrame, run: str) -> DataFrame:
    """Scan-result rows with scan_id: the run, the file and its commit. Scanning again in another run gives another id."""
    return summarized.withColumn("scan_id", F.sha2(F.concat_ws(
        "|", F.lit(run), F.col("file_id").cast("string"), F.coalesce("commit_sha", F.lit(""))), 256))


def result_rows(scans: DataFrame, now: Column) -> DataFrame:
    """What is stored of a scan."""
    flag = F.coalesce("detected_ai_code", F.lit(False)) if "detected_ai_code" in scans.columns else F.lit(False)
    return scans.select(
        F.col("scan_id").alias("id"), now.alias("timestamp"), "org", "repo", "pr_number", "commit_sha", "file_path", "language",
        F.lit("full").alias("scan_type"), "status", *COUNTERS, flag.alias("detected_ai_code"), "enforcement_action")


def violation_rows(scans: DataFrame, now: Column) -> DataFrame:
    """What is stored of each violation, under its scan's id."""
    rows = explode_violations(scans.select("scan_id", "file_path", "violations"))
    return rows.select(
        F.col("violation_id").alias("id"), "scan_id", now.alias("timestamp"), "rule_id", "severity", "category", "title", "file_path",
        "line_start", "line_end", "owasp_mapping", "cwe_id", F.lit(False).alias("is_ai_generated"),
        F.lit("open").alias("resolution_state"))


def store_scans(acted: DataFrame, path: str, run: str, now: Column, hits: DataFrame | None = None) -> bool:
    """Commit scan results and their violations under one run.

    ``acted``: scan-result rows with violations, counters, status and action, from
    a written table, so that a lost executor costs a re-read and not a re-scan. With
    ``hits``, the violations of each content, the rows have the unit of theirs instead.
    """
    scans = identified(acted, run)
    found = scans if hits is None else with_hits(scans.select("scan_id", "file_path", "unit"), hits).drop("unit")
    return commit({"scan_results": result_rows(scans, now), "violations": violation_rows(found, now)}, path, run,
                  {"violations": ["category", "severity"]})


def delete_scans(violations: DataFrame, scan_results: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remaining (scan_results, violations) after deleting scans and, with them, their violations."""
    gone = deleted.select("file_id").distinct()
    return scan_results.join(gone, "file_id", "left_anti"), violations.join(gone, "file_id", "left_anti")
