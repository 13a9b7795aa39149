"""From violations to summaries, enforcement and status.

Per-file figures are computed inside the file's row.  Counters are
pre-aggregated before they leave a task, so a pull request or repository that
owns a third of all files stays cheap.  Violations are listed only where a
query brings them along; those of one key are then one value of one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanfold.catalog import SEVERITIES

COUNTERS = ("total_issues",) + SEVERITIES
ACTIONS = ("none", "annotate", "block")          # weakest first
PERFORMANCE_SCORE = 85.0                         # fixed value
PENALTY = {"security": 10.0, "standards": 5.0}   # fixed values


def severity_rank(severity: Column) -> Column:
    rank = F.lit(len(SEVERITIES))
    for i, name in enumerate(SEVERITIES[:-1]):
        rank = F.when(severity == name, F.lit(i + 1)).otherwise(rank)
    return rank


def count_of(violations: Column, severity: str) -> Column:
    if severity == "info":                       # anything unknown counts as info
        named = list(SEVERITIES[:-1])
        return F.size(F.filter(violations, lambda v: ~F.coalesce(v["severity"].isin(named), F.lit(False))))
    return F.size(F.filter(violations, lambda v: v["severity"] == severity))


def summarize(scanned: DataFrame) -> DataFrame:
    """Add the six counters and ``status`` to scan-result rows; files without hits keep zeros."""
    out = scanned.withColumn("total_issues", F.size("violations"))
    for severity in SEVERITIES:
        out = out.withColumn(severity, count_of(F.col("violations"), severity))
    return out.withColumn("status", status(F.col("total_issues")))


def status(total: Column) -> Column:
    return F.when(total == 0, F.lit("clean")).otherwise(F.lit("violations_found"))


def enforcement(mode: Column, total: Column, critical: Column, high: Column) -> Column:
    return (F.when((mode == "warning") & (total > 0), F.lit("annotate"))
            .when((mode == "blocking") & ((critical > 0) | (high > 0)), F.lit("block"))
            .when((mode == "blocking") & (total > 0), F.lit("annotate"))
            .otherwise(F.lit("none")))


def enforcement_reason(mode: Column, total: Column, critical: Column, high: Column) -> Column:
    def text(*parts):
        return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    return (F.when(mode == "advisory", F.lit("Advisory mode - informational only"))
            .when((mode == "warning") & (total > 0), text("Found ", total, " issues (warning mode)"))
            .when((mode == "blocking") & ((critical > 0) | (high > 0)),
                  text("Found ", critical, " critical and ", high, " high severity issues"))
            .when((mode == "blocking") & (total > 0), text("Found ", total, " medium/low issues")))


def action_rank(action: Column) -> Column:
    return F.when(action == "block", 2).when(action == "annotate", 1).otherwise(0)


def action_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), (rank + 1).cast("int"))


def _listed(violations: Column) -> Column:
    """Lists of violations as one, in the order of their fields."""
    return F.sort_array(F.flatten(F.collect_list(violations))).alias("violations")


def _with_path(per_file: DataFrame) -> Column:
    """A file's violations, each with the file's path before its own fields."""
    fields = per_file.schema["violations"].dataType.elementType.fieldNames()
    return F.transform("violations", lambda v: F.struct("file_path", *[v[c].alias(c) for c in fields]))


def roll_up(per_file: DataFrame, *keys: str) -> DataFrame:
    """Sum the counters over files; the strongest action wins; empty means clean.

    Where files come with their ``violations``, these are concatenated, by path and place.
    """
    sums = [F.sum(c).cast("bigint").alias(c) for c in COUNTERS]
    flags = [F.bool_or("detected_ai_code").alias("detected_ai_code")] \
        if "detected_ai_code" in per_file.columns else []
    lists = [_listed(_with_path(per_file))] if "violations" in per_file.columns else []
    out = per_file.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("files"), *sums, *flags, *lists,
        F.max(action_rank(F.col("enforcement_action"))).alias("_action"))
    return (out.withColumn("status", status(F.col("total_issues")))
            .withColumn("enforcement_action", action_name(F.col("_action"))).drop("_action"))


def add_up(rolled: DataFrame, *keys: str) -> DataFrame:
    """Add rolled-up parts of the same key, as if their files had been rolled up together."""
    flags = [F.bool_or("detected_ai_code").alias("detected_ai_code")] if "detected_ai_code" in rolled.columns else []
    lists = [_listed(F.col("violations"))] if "violations" in rolled.columns else []
    out = rolled.groupBy(*keys).agg(
        *[F.sum(c).cast("bigint").alias(c) for c in ("files", *COUNTERS)], *flags, *lists,
        F.max(action_rank(F.col("enforcement_action"))).alias("_action"))
    return (out.withColumn("status", status(F.col("total_issues")))
            .withColumn("enforcement_action", action_name(F.col("_action"))).drop("_action"))


def pr_status(rolled: DataFrame) -> DataFrame:
    """Commit status of pull requests: failure iff blocked, text cut to 140 characters."""
    mode, total, critical, high = (F.col(c) for c in ("enforcement_mode", "total_issues", "critical", "high"))
    action = enforcement(mode, total, critical, high)
    reason = F.coalesce(enforcement_reason(mode, total, critical, high), F.lit("All checks passed"))
    return (rolled.withColumn("state", F.when(action == "block", "failure").otherwise("success"))
            .withColumn("description", F.left(reason, F.lit(140))))


def push_status(rolled: DataFrame) -> DataFrame:
    mode, total, critical, high = (F.col(c) for c in ("enforcement_mode", "total_issues", "critical", "high"))
    failing = (mode == "blocking") & ((critical > 0) | (high > 0))
    text = (F.when(failing, F.concat(F.lit("Found "), critical, F.lit(" critical and "), high,
                                     F.lit(" high severity issues")))
            .when(total > 0, F.concat(F.lit("Found "), total, F.lit(" issues ("), critical, F.lit(" critical, "),
                                      high, F.lit(" high)")))
            .otherwise(F.lit("All security checks passed")))
    return (rolled.withColumn("state", F.when(failing, "failure").otherwise("success"))
            .withColumn("description", F.left(text, F.lit(140))))


def totals(per_file: DataFrame, mode: str) -> DataFrame:
    """One-row report of a whole run, with the exit code of the given mode."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in COUNTERS]
    out = per_file.agg(F.count(F.lit(1)).alias("total_files"), *sums)
    failing = F.lit(mode == "blocking") & ((F.col("critical") > 0) | (F.col("high") > 0))
    return (out.withColumn("exit_code", failing.cast("int"))
            .withColumn("report_json", F.to_json(F.struct(F.struct(
                F.col("total_files").alias("totalFiles"), F.col("total_issues").alias("totalIssues"),
                *SEVERITIES).alias("summary")))))


def owasp_coverage(violations: DataFrame, *keys: str) -> DataFrame:
    return (violations.filter(F.col("owasp_mapping").isNotNull()).groupBy(*keys, "owasp_mapping")
            .agg(F.count(F.lit(1)).alias("hits")))


def standards_flags(scanned: DataFrame) -> DataFrame:
    """Three flags, cleared by words in the descriptions of a file's violations."""
    def free_of(*words):
        def clean(v):
            text = F.lower(v["description"])
            hit = F.lit(False)
            for word in words:
                hit = hit | F.contains(text, F.lit(word))
            return ~hit
        return F.forall("violations", clean)
    return (scanned.withColumn("naming", free_of("naming"))
            .withColumn("logging", free_of("logging", "console"))
            .withColumn("error_handling", free_of("error", "catch")))


def quality_scores(scanned: DataFrame) -> DataFrame:
    def clipped(category):
        n = F.size(F.filter("violations", lambda v: v["category"] == category))
        return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - n * F.lit(PENALTY[category])))
    out = (scanned.withColumn("security_score", clipped("security"))
           .withColumn("performance_score", F.lit(PERFORMANCE_SCORE))
           .withColumn("maintainability_score", clipped("standards")))
    return out


def overall_score(scored: DataFrame, analysis_types: Column) -> DataFrame:
    """Mean of the requested analyses; 0 when none was requested."""
    score_of = F.create_map(
        F.lit("security"), F.col("security_score"), F.lit("performance"), F.col("performance_score"),
        F.lit("maintainability"), F.col("maintainability_score"))
    picked = F.transform(analysis_types, lambda t: score_of[t])
    total = F.aggregate(picked, F.lit(0.0), lambda acc, x: acc + x)
    return scored.withColumn("overall_score", F.when(F.size(analysis_types) == 0, F.lit(0.0)).otherwise(
        total / F.size(analysis_types)))
