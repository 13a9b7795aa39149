"""Model responses as a source of violations: parse, normalise, number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanfold.catalog import SEVERITIES

RESPONSE_SCHEMA = (
    "violations array<struct<severity:string,title:string,description:string,line_start:int,line_end:int,"
    "code_snippet:string,owasp_mapping:string,cwe_id:string,explanation:string,suggested_fix:string>>"
)


def unfence(raw: Column) -> Column:
    """Strip one Markdown code fence."""
    opened = F.regexp_replace(F.regexp_replace(raw, r"\A\s+|\s+\z", ""), r"\A```(?:json)?", "")
    return F.regexp_replace(F.regexp_replace(opened, r"```\z", ""), r"\A\s+|\s+\z", "")


def parse(responses: DataFrame) -> DataFrame:
    """Add the ``findings`` array; text that is not one JSON document gives none."""
    text = F.col("_text")
    valid = F.try_parse_json(text).isNotNull()
    found = F.when(valid, F.from_json(text, RESPONSE_SCHEMA)["violations"])
    kind = RESPONSE_SCHEMA.split(" ", 1)[1]
    return (responses.withColumn("_text", unfence(F.col("raw")))
            .withColumn("findings", F.coalesce(found, F.array().cast(kind)))
            .withColumn("parse_failed", ~valid).drop("_text"))


def violations(parsed: DataFrame) -> DataFrame:
    """One row per finding with defaults filled in.

    ``posexplode`` already yields the arrival order within one response, so the
    running number of a file and category needs no window.
    """
    category = F.upper("category")
    rows = parsed.select("file_id", "file_path", "category", F.posexplode_outer("findings").alias("pos", "v")).filter(
        F.col("pos").isNotNull())
    severity = F.lower(F.col("v.severity"))
    return rows.select(
        "file_id", "file_path", "category",
        F.concat(F.lit("AI-"), category, F.lit("-"), F.format_string("%03d", F.col("pos") + 1)).alias("rule_id"),
        F.when(severity.isin(list(SEVERITIES)), severity).otherwise("medium").alias("severity"),
        F.coalesce("v.title", F.lit("Unknown Issue")).alias("title"),
        F.coalesce("v.description", F.lit("No description provided")).alias("description"),
        F.coalesce("v.line_start", F.lit(1)).alias("line_start"),
        F.coalesce("v.line_end", "v.line_start", F.lit(1)).alias("line_end"),
        F.coalesce("v.code_snippet", F.lit("")).alias("code_snippet"),
        F.col("v.owasp_mapping").alias("owasp_mapping"), F.col("v.cwe_id").alias("cwe_id"),
        F.coalesce("v.explanation", "v.description", F.lit("")).alias("explanation"),
        F.col("v.suggested_fix").alias("suggested_fix"),
        F.col("pos").alias("pos"))


AUTHORSHIP_SCHEMA = "is_ai_generated boolean, confidence double, ai_code_lines array<int>"


def recommendations(parsed: DataFrame, shown: int | None = None) -> DataFrame:
    """The findings of a response that come with a fix, as one line each; ``shown`` cuts to the first for display."""
    with_fix = F.filter("findings", lambda v: F.coalesce(v["suggested_fix"], F.lit("")) != "")
    lines = F.transform(with_fix, lambda v: F.concat(F.lit("Fix: "), F.coalesce(v["title"], F.lit("Issue"))))
    return parsed.withColumn("recommendations", lines if shown is None else F.slice(lines, 1, shown))


def authorship(responses: DataFrame, shown: int | None = None) -> DataFrame:
    """Whether a file was judged machine-written: flag, share, and the line numbers; ``shown`` cuts these for display."""
    text = unfence(F.col("raw"))
    doc = F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, AUTHORSHIP_SCHEMA))
    lines = F.coalesce(doc["ai_code_lines"], F.array().cast("array<int>"))
    text = F.array_join(lines, ", ") if shown is None else F.concat(
        F.array_join(F.slice(lines, 1, shown), ", "), F.when(F.size(lines) > shown, F.lit("...")).otherwise(""))
    return (responses.withColumn("detected_ai_code", F.coalesce(doc["is_ai_generated"], F.lit(False)))
            .withColumn("ai_code_percentage", F.coalesce(doc["confidence"], F.lit(0.0)) / 100)
            .withColumn("ai_lines", text))
