"""Licence detection, policy, roll-up and origin markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanfold.functions.dialect import any_of

# --- Fixed values: licence patterns, first match in this order wins ----------
LICENSE_PATTERNS = (
    ("MIT", (r"MIT License", r"Permission is hereby granted, free of charge", r"SPDX-License-Identifier:\s*MIT")),
    ("Apache-2.0", (r"Apache License.*Version 2\.0", r"Licensed under the Apache License",
                    r"SPDX-License-Identifier:\s*Apache-2\.0")),
    ("GPL-3.0", (r"GNU General Public License.*version 3", r"GPLv3", r"SPDX-License-Identifier:\s*GPL-3\.0")),
    ("BSD-3-Clause", (r"BSD 3-Clause License", r"Redistribution and use in source and binary forms",
                      r"SPDX-License-Identifier:\s*BSD-3-Clause")),
    ("ISC", (r"ISC License", r"SPDX-License-Identifier:\s*ISC")),
    ("AGPL-3.0", (r"GNU Affero General Public License", r"AGPL", r"SPDX-License-Identifier:\s*AGPL-3\.0")),
)
# --- Fixed values: licence names ---------------------------------------------
LICENSE_NAMES = {
    "MIT": "MIT License",
    "Apache-2.0": "Apache License 2.0",
    "GPL-2.0": "GNU General Public License v2.0",
    "GPL-3.0": "GNU General Public License v3.0",
    "BSD-2-Clause": "BSD 2-Clause License",
    "BSD-3-Clause": "BSD 3-Clause License",
    "ISC": "ISC License",
    "AGPL-3.0": "GNU Affero General Public License v3.0",
    "LGPL-2.1": "GNU Lesser General Public License v2.1",
    "LGPL-3.0": "GNU Lesser General Public License v3.0",
}
# --- Fixed values: default policy, confidences -------------------------------
DEFAULT_ALLOWED = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC")
DEFAULT_BLOCKED = ("GPL-2.0", "GPL-3.0", "AGPL-3.0")
HEADER_CONFIDENCE, MANIFEST_CONFIDENCE = 0.9, 1.0
# --- Fixed values: origin markers --------------------------------------------
ORIGIN_MARKERS = (
    (r"Copyright.*\d{4}.*", "Potential external copyright"),
    (r"@author\s+[^your-team]", "External author attribution"),
)
ORIGIN_SCORE = 0.7


def detect(files: DataFrame, header_lines: int | None = None) -> DataFrame:
    """Add ``license_id``, ``license_name``, ``confidence`` and ``license_source``; null when none is found.

    One pass per file: the licences are tried in order, each as one alternation,
    on the whole text or on its first ``header_lines`` lines.
    """
    header = F.col("_header")
    by_header = None
    for license_id, regexes in LICENSE_PATTERNS:
        found = header.rlike(any_of(regexes, "i"))
        by_header = F.when(found, license_id) if by_header is None else by_header.when(found, license_id)
    manifest = F.when(F.endswith("file_path", F.lit("package.json")), F.get_json_object("code", "$.license"))
    # The header cut is used by every pattern, so it gets a projection of its own.
    cut = files.withColumn("_header", F.col("code") if header_lines is None else F.substring_index("code", "\n", header_lines))
    found = cut.withColumn("_by_header", by_header).withColumn("_manifest", manifest)
    return (found
            .withColumn("license_id", F.coalesce("_by_header", "_manifest"))
            .withColumn("license_name", license_name(F.col("license_id")))
            .withColumn("confidence", F.when(F.col("_by_header").isNotNull(), F.lit(HEADER_CONFIDENCE))
                        .when(F.col("_manifest").isNotNull(), F.lit(MANIFEST_CONFIDENCE)))
            .withColumn("license_source", F.when(F.col("_by_header").isNotNull(), F.lit("file_header"))
                        .when(F.col("_manifest").isNotNull(), F.lit("package.json")))
            .drop("_header", "_by_header", "_manifest"))


def license_name(license_id: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in LICENSE_NAMES.items() for x in pair])
    return F.coalesce(names[license_id], license_id)


def policy_status(license_id: Column, allowed: Column, blocked: Column) -> Column:
    return (F.when(license_id.isNull(), F.lit(None).cast("string"))
            .when(F.array_contains(blocked, license_id), "blocked")
            .when(F.array_contains(allowed, license_id), "allowed")
            .otherwise("review"))


def report(judged: DataFrame, *keys: str) -> DataFrame:
    """Counts per status and the overall verdict; undetected files count in the total only."""
    out = judged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("license_status") == "allowed").alias("compliant_count"),
        F.count_if(F.col("license_status") == "blocked").alias("non_compliant_count"),
        F.count_if(F.col("license_status") == "review").alias("review_count"))
    return out.withColumn("status", F.when(F.col("non_compliant_count") > 0, "non_compliant")
                          .when(F.col("review_count") > 0, "review_required").otherwise("compliant"))


def recommendations(judged: DataFrame, *keys: str, shown: int | None = None) -> DataFrame:
    """One row per line of advice; ``section`` and ``position`` give their order.

    Every blocked file has a line. ``shown`` cuts to the first files per group for
    display; their row number has an upper bound, so Spark keeps a few rows per
    task before the shuffle.
    """
    counts = report(judged, *keys)

    def count_line(section, column, before, after):
        return counts.filter(F.col(column) > 0).select(
            *keys, F.lit(section).alias("section"), F.lit(0).cast("bigint").alias("position"),
            F.concat(F.lit(before), F.col(column).cast("string"), F.lit(after)).alias("recommendation"))

    blocked = judged.filter(F.col("license_status") == "blocked")
    if shown is not None:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("file_id"))
        blocked = blocked.select(*keys, "file_id", "file_path", "license_id", rank.alias("_n")).filter(F.col("_n") <= shown)
    files = blocked.select(*keys, F.lit(2).alias("section"), F.col("file_id").cast("bigint").alias("position"),
                           F.concat(F.lit("  - "), "file_path", F.lit(": "), "license_id").alias("recommendation"))
    return (count_line(1, "non_compliant_count", "Remove or replace ", " file(s) with blocked licenses")
            .unionByName(files)
            .unionByName(count_line(3, "review_count", "Review ", " file(s) with unclassified licenses")))


def origin_markers(files: DataFrame) -> DataFrame:
    """Foreign copyright and author marks: sources, score and risk per file."""
    sources = F.array_compact(F.array(*[
        F.when(F.col("code").rlike(any_of([regex], "i")), F.lit(source)) for regex, source in ORIGIN_MARKERS]))
    found = files.withColumn("sources", sources)
    any_found = F.size("sources") > 0
    return (found.withColumn("has_similar_code", any_found)
            .withColumn("similarity_score", F.when(any_found, F.lit(ORIGIN_SCORE)))
            .withColumn("ip_risk", F.when(any_found, "medium").otherwise("low")))
