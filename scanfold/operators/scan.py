"""Scan a table of files: one narrow stage from file row to scan-result row.

    files  --broadcast lookup of the language's patterns-->  hits  --in-row de-dup-->  violations

There is no shuffle: the catalogue is joined by language as one array per
language, all hits of a file are found and de-duplicated inside its row, and
the text is dropped before anything leaves the stage.  A language, organisation
or repository that owns a third of the files costs nothing extra.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfold.catalog import ANY, Catalogue, Rule
from scanfold.catalog.frames import distinct_regexes, language_patterns, pattern_records
from scanfold.functions import kernel
from scanfold.functions.text import lines_of

FILE_COLUMNS = ("file_id", "org", "repo", "pr_number", "commit_sha", "author", "file_path", "language")


def _gate_open(p: Column, lowered: Column, odd: Column) -> Column:
    return (F.size(p["gate"]) == 0) | odd | F.exists(p["gate"], lambda g: F.contains(lowered, g))


def _opened(patterns: Column, literals: Column, lowered: Column, odd: Column) -> Column:
    """The patterns that the literals found in the text open, in their order: each literal is looked for once."""
    found = F.filter(literals, lambda x: (x["literal"] == "") | F.contains(lowered, x["literal"]))
    numbers = F.array_sort(F.array_distinct(F.flatten(F.transform(found, lambda x: x["opens"]))))
    return F.when(odd, patterns).otherwise(F.transform(numbers, lambda i: F.get(patterns, i)))


def find_violations(files: DataFrame, rules: list[Rule], *, languages: list[str] | None = None,
                    selected: str | None = None, extra_patterns: str | None = None,
                    dedupe: str = "rule", keep: tuple[str, ...] = (), exempt: str | None = None) -> DataFrame:
    """One row per file with its ``violations`` array.

    ``selected`` names an ``array<string>`` column of rule ids to run on that row,
    in order; ``extra_patterns`` an array column of further pattern structs;
    ``exempt`` an array column of the path exemptions that hold, for texts without a path.
    """
    spark = files.sparkSession
    languages = languages or Catalogue.builtin().languages()
    records = pattern_records(rules, languages)
    checks = {r["check"] for r in records} or {"plain"}
    regexes, contexts = distinct_regexes(records)
    skipping = any(r["skip_path"] for r in records)

    lang = F.lower(F.col("language"))
    prepared = files.withColumn("code", kernel.unmarked(F.col("code"))).select(
        "*",
        F.when(lang.isin(languages), lang).otherwise(F.lit(ANY)).alias("scan_language"),
        F.lower("code").alias("_lowered"),
        kernel.folds_oddly(F.col("code")).alias("_odd"),
        kernel.markers(F.col("code")).alias("_marks"),
        kernel.is_ascii(F.col("code")).alias("_ascii"),
        lines_of(F.col("code")).alias("_lines"),
        lang.alias("_lang"),
    )
    joined = prepared.join(language_patterns(spark, rules, languages), "scan_language", "left")

    columns = [c for c in FILE_COLUMNS if c in files.columns] + [c for c in keep if c not in FILE_COLUMNS]
    opened = joined.withColumn("_open", _patterns_column(skipping, selected, extra_patterns, exempt)).drop("patterns", "literals")
    if extra_patterns:
        checks |= {"plain"}
    shape = (spark.sparkContext.applicationId, frozenset(checks), dedupe, tuple(contexts))
    if shape not in _EXPRESSIONS:
        _EXPRESSIONS[shape] = _violations_column(checks, dedupe, contexts)
    marked = opened.withColumn("_marked", kernel.bracketed("_open", regexes))
    return marked.select(*columns, _EXPRESSIONS[shape].alias("violations"))


# The expression depends on the checks and contexts in use: built once per session and shape.
_EXPRESSIONS: dict[tuple, Column] = {}


def _patterns_column(skipping: bool, selected: str | None, extra_patterns: str | None, exempt: str | None = None) -> Column:
    """The patterns to run on a row, in order."""
    patterns = F.coalesce(_opened(F.col("patterns"), F.col("literals"), F.col("_lowered"), F.col("_odd")), F.array())
    if selected:
        patterns = F.transform(
            F.filter(patterns, lambda p: F.array_contains(F.col(selected), p["rule_id"])),
            lambda p: p.withField("rule_ord", F.array_position(F.col(selected), p["rule_id"]).cast("int")))
    if skipping:
        patterns = F.filter(patterns, lambda p: ~F.when(p["skip_path"] == "", F.lit(False)).otherwise(
            F.array_contains(exempt, p["skip_path"]) if exempt else F.rlike(F.col("file_path"), p["skip_path"])))
    if extra_patterns:
        patterns = F.concat(patterns, F.filter(F.coalesce(F.col(extra_patterns), F.array()), lambda p: _gate_open(
            p, F.col("_lowered"), F.col("_odd"))))
    return patterns


def _violations_column(checks: set[str], dedupe: str, contexts: list[str]) -> Column:
    hits = F.flatten(F.zip_with("_open", "_marked", lambda p, marked: kernel.pattern_hits(
        F.col("code"), F.col("_lines"), F.col("_lang"), F.col("_marks"), F.col("_ascii"), p, marked, checks, contexts)))
    ordered = kernel.sorted_hits(hits)
    if dedupe == "rule":
        return kernel.dedupe_rule(ordered)
    if dedupe == "location":
        return kernel.dedupe_location(ordered)
    if dedupe == "none":
        return ordered
    raise ValueError(f"unknown de-duplication: {dedupe}")


def explode_violations(scanned: DataFrame) -> DataFrame:
    """One row per violation; ``violation_id`` is a function of its scan (of its file, where scans have no id) and its place."""
    columns = [c for c in scanned.columns if c != "violations"]
    # Outer plus a filter: for the inner form the optimizer adds a size check on the
    # array, pushes it below, and the whole scan expression is evaluated twice.
    rows = scanned.select(*columns, F.inline_outer("violations")).filter(F.col("rule_id").isNotNull())
    return rows.withColumn("violation_id", F.sha2(F.concat_ws(
        "|", F.col("scan_id" if "scan_id" in columns else "file_id").cast("string"), "rule_id", F.col("line_start").cast("string"),
        F.col("line_end").cast("string")), 256))


def scan(files: DataFrame, catalogue: Catalogue | None = None, *, rule_ids=None, packs=None,
         category: str | None = None, dedupe: str = "rule") -> DataFrame:
    """Violations of a fixed rule selection, one row each."""
    catalogue = catalogue or Catalogue.builtin()
    rules = catalogue.select(rule_ids, packs, category)
    return explode_violations(find_violations(
        files, rules, languages=catalogue.languages() or None, dedupe=dedupe))


def full_scan(files: DataFrame, catalogue: Catalogue | None = None, packs=("default-security",)) -> DataFrame:
    """The scan-service result: rule hits of the packs, one hit per location."""
    catalogue = catalogue or Catalogue.builtin()
    return find_violations(files, catalogue.select(packs=packs), languages=catalogue.languages(),
                           dedupe="location")
