"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = ("dedup_location", "scan_pack", "severity_summary", "sec_003", "std_003", "fed_002", "pr_rollup",
             "owasp_coverage", "license_report", "code_similarity", "custom_regex_rules", "diff_only_hits",
             "report_tiers", "audit_query", "changed_files", "ai_violations", "config_resolve", "stream_scan")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    keys = os.environ.get("BENCH_QUERIES", ",".join(HEADLINES)).split(",")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("scanfold-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from scanfold.plans.queries import QUERIES
    from scanfold.sources.corpus import code_files

    stats = code_files(spark, sf_dir).selectExpr("count(1) AS n", "sum(octet_length(code)) AS bytes").first()
    times = {}
    for key in keys:
        start = time.perf_counter()
        QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - start, 3)
    full = times.get("dedup_location")
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(scale.group(1)) if scale else None, "cpus": int(cpus),
        "files": stats["n"], "megabytes": round(stats["bytes"] / 1e6, 1),
        "full_rule_set_files_per_sec": round(stats["n"] / full) if full else None,
        "full_rule_set_mb_per_sec": round(stats["bytes"] / 1e6 / full, 2) if full else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
