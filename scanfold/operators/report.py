"""Reports for people: severity order, tiers, Markdown.

A report is a table of text blocks with a sortable position, not one string per
pull request: a pull request may own a third of all violations, and its report
is still spread over many tasks.  Blocks in ``position`` order are the report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanfold.catalog.frames import remedies_frame
from scanfold.catalog.remedies import DEFAULT
from scanfold.functions.naming import suggestion
from scanfold.functions.paths import detect_language
from scanfold.operators.rollup import severity_rank

OPEN_MEDIUM = 5      # fixed value: medium issues shown unfolded
# --- Fixed values: marks and texts -------------------------------------------
MARKS = {"critical": "\U0001F534", "high": "\U0001F7E7", "medium": "\U0001F7E1", "low": "\U0001F535",
         "info": "ℹ️"}
ACTION_TEXT = {
    "none": "✅ No issues found",
    "annotate": "⚠️ Warning (merge allowed with issues)",
    "block": "\U0001F6AB Blocked (critical/high issues must be resolved)",
}
HTML_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def escape_html(text: Column) -> Column:
    for char, entity in HTML_ESCAPES:
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def by_severity(violations: DataFrame) -> DataFrame:
    """Critical first; a range-partitioned sort, so no single task holds a severity."""
    return (violations.withColumn("severity_rank", severity_rank(F.col("severity")))
            .orderBy("severity_rank", "file_path", "line_start", "line_end", "rule_id"))


def tiers(violations: DataFrame, *keys: str) -> DataFrame:
    """Tag each violation ``open`` or ``folded``.

    Only the first medium issues need a rank, and a bounded row number is cut
    to a few rows per task before the shuffle.  The tag comes back by id.
    """
    order = ["file_path", "line_start", "line_end", "rule_id"]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, "violation_id"))
    shown = (violations.filter(F.col("severity") == "medium").select(*keys, *order, "violation_id")
             .withColumn("_n", rank).filter(F.col("_n") <= OPEN_MEDIUM)
             .select("violation_id", F.lit(True).alias("_shown")))
    joined = violations.join(shown, "violation_id", "left")
    is_open = F.col("severity").isin("critical", "high") | F.coalesce("_shown", F.lit(False))
    return joined.withColumn("tier", F.when(is_open, "open").otherwise("folded")).drop("_shown")


def with_fixes(violations: DataFrame) -> DataFrame:
    """Add ``suggested_fix``: the naming proposal, else the text of the language, else the general one."""
    fixes = remedies_frame(violations.sparkSession)
    exact = F.broadcast(fixes.filter(F.col("language") != DEFAULT).withColumnRenamed("suggested_fix", "_exact"))
    general = F.broadcast(fixes.filter(F.col("language") == DEFAULT).select(
        "rule_id", F.col("suggested_fix").alias("_general")))
    named = F.when(F.col("rule_id") == "STD-001", suggestion(
        F.coalesce("detail", F.lit("")), F.col("label"), F.lower("language")))
    return (violations.join(exact, ["rule_id", "language"], "left").join(general, "rule_id", "left")
            .withColumn("suggested_fix", F.coalesce(named, "_exact", "_general")).drop("_exact", "_general"))


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def violation_block(v=F.col) -> Column:
    """Markdown of one violation."""
    language = detect_language(F.col("file_path"))
    rule = F.concat_ws(" | ", _text("**Rule:** `", F.col("rule_id"), "`"),
                       _text("**OWASP:** ", F.col("owasp_mapping")), _text("**CWE:** ", F.col("cwe_id")))
    snippet = F.when(F.coalesce("code_snippet", F.lit("")) != "", F.concat(
        F.lit("```"), language, _text("\n// Line ", F.col("line_start"), "-", F.col("line_end"), "\n"),
        F.col("code_snippet"), F.lit("\n```\n\n"))).otherwise("")
    fix = F.when(F.coalesce("suggested_fix", F.lit("")) != "", F.concat(
        F.lit("**Suggested Fix:**\n"),
        F.when(F.contains("suggested_fix", F.lit("```")), F.concat("suggested_fix", F.lit("\n\n")))
        .otherwise(F.concat(F.lit("```"), language, F.lit("\n"), "suggested_fix", F.lit("\n```\n\n"))))).otherwise("")
    return F.concat(
        F.lit("<details>\n<summary><b>"), escape_html(F.col("title")), F.lit("</b> - <code>"),
        escape_html(F.col("file_path")), _text(":", F.col("line_start"), "</code></summary>\n\n"),
        rule, F.lit("\n\n"), snippet, F.lit("**Why this is an issue:**\n"), F.col("description"), F.lit("\n\n"),
        fix, F.lit("</details>\n"))


def markdown_blocks(summaries: DataFrame, violations: DataFrame, *keys: str) -> DataFrame:
    """Rows (keys, section, position, block).

    ``summaries`` holds one rolled-up row per key with ``override_allowed``;
    ``violations`` must carry ``tier`` and ``suggested_fix``.
    """
    table = _text(
        "## Security & Compliance Report\n\n### Summary\n\n| Severity | Count |\n|----------|-------|\n",
        *[x for s in MARKS for x in (f"| {MARKS[s]} {s.capitalize()} | ", F.col(s), " |\n")])
    action = F.create_map(*[F.lit(x) for pair in ACTION_TEXT.items() for x in pair])[F.col("enforcement_action")]
    titles = {1: "Critical Issues", 2: "High Issues", 3: "Medium Issues"}

    def block(section: int, text: Column, shown: Column | None = None) -> Column:
        made = F.struct(F.lit(section).alias("section"), text.alias("block"))
        return made if shown is None else F.when(shown, made)

    blocks = [block(0, F.concat(table, F.lit("\n**Enforcement Action:** "), action, F.lit("\n")))]
    for rank, severity in enumerate(MARKS, start=1):
        count = F.col(severity)
        if rank <= 3:
            text = F.lit(f"### {MARKS[severity]} {titles[rank]}\n")
        else:
            name = "Low Issues" if severity == "low" else "Info"
            text = _text(f"<details><summary>{MARKS[severity]} {name} (", count, ")</summary>\n")
        blocks.append(block(rank * 10, text, count > 0))
        folded_after = {"medium": OPEN_MEDIUM, "low": 0, "info": 0}.get(severity)
        if folded_after is not None:
            blocks.append(block(rank * 10 + 4, F.lit("</details>\n"), count > folded_after))
    blocks.append(block(32, _text("<details><summary>Show ", F.col("medium") - OPEN_MEDIUM,
                                  " more medium issues</summary>\n"), F.col("medium") > OPEN_MEDIUM))
    blocks.append(block(90, F.concat(
        F.lit("### Actions\n\n"),
        F.when((F.col("critical") > 0) | (F.col("high") > 0),
               F.lit("- [ ] Fix critical and high severity issues before merge\n")).otherwise(""),
        F.when(F.col("medium") > 0, F.lit("- [ ] Review medium severity issues\n")).otherwise(""),
        F.when((F.col("enforcement_action") == "block") & F.col("override_allowed"),
               F.lit("\n**Override:** comment the override command with a justification.\n")).otherwise(""))))
    frame = summaries.select(*keys, F.inline(F.array_compact(F.array(*blocks)))).select(
        *keys, "section", F.lit("").alias("position"), "block")
    rank = severity_rank(F.col("severity"))
    place = F.concat_ws("|", "file_path", F.format_string("%09d", "line_start"), F.format_string("%09d", "line_end"),
                        "rule_id")
    # Within a severity: open blocks, then the fold marker (medium only), then folded ones.
    section = rank * 10 + F.when((F.col("severity") == "medium") & (F.col("tier") == "folded"), 3).otherwise(1)
    body = violations.select(*keys, section.cast("int").alias("section"), place.alias("position"),
                             violation_block().alias("block"))
    return frame.unionByName(body)
