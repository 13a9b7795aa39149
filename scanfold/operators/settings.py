"""Nested settings: documents merged over the defaults by path, and what they switch in a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanfold.operators.rollup import severity_rank

# --- Fixed values: sections, fields and defaults -------------------------------
SECTIONS: dict[str, dict[str, object]] = {
    "override": {"enabled": True, "approvers": []},
    "security": {"block_threshold": "high", "secrets_enabled": True, "sql_injection_enabled": True,
                 "deserialization_enabled": True, "command_execution_enabled": True},
    "naming": {"enabled": True, "functions": {}, "classes": "PascalCase", "constants": "SCREAMING_SNAKE_CASE"},
    "logging": {"enabled": True, "structured": True, "required_levels": ["error", "warn", "info"], "forbid_console_log": True},
    "error_handling": {"enabled": True, "async_try_catch": True, "require_error_logging": True, "forbid_empty_catch": True},
    "license": {"allowed": ["MIT", "Apache-2.0", "BSD-3-Clause"], "blocked": ["GPL-3.0", "AGPL-3.0"], "similarity_threshold": 0.85},
    "copilot": {"strict_mode": True, "additional_checks": ["license_attribution", "security_review", "code_similarity"]},
}
#: The rule that a switch turns off.
SWITCHES = {("security", "secrets_enabled"): "SEC-001", ("security", "sql_injection_enabled"): "SEC-002",
            ("security", "command_execution_enabled"): "SEC-003", ("security", "deserialization_enabled"): "SEC-005",
            ("naming", "enabled"): "STD-001", ("logging", "enabled"): "STD-002", ("error_handling", "enabled"): "STD-003"}


def kind_of(default: object) -> str:
    if isinstance(default, bool):
        return "boolean"
    return {str: "string", float: "double", list: "array<string>", dict: "map<string,string>"}[type(default)]


def _default(value: object) -> Column:
    if isinstance(value, dict):
        return F.create_map().cast("map<string,string>")
    return F.array(*map(F.lit, value)).cast("array<string>") if isinstance(value, list) else F.lit(value)


def merged(*documents: Column) -> Column:
    """One struct of all sections from documents (VARIANT), the most general first.

    Field by field: a document that doesn't name a field leaves it as it is; one
    that names it as null, or its whole section, sets it back to the default; else
    its value counts. A value of another type, a field without a default and a
    document that is no object are as if they weren't there.
    """
    def field(section: str, name: str, default: object) -> Column:
        value = _default(default)
        for document in documents:
            there = F.try_variant_get(document, f"$.{section}", "variant")
            own = F.try_variant_get(document, f"$.{section}.{name}", "variant")
            given = F.try_variant_get(document, f"$.{section}.{name}", kind_of(default))
            reset = F.coalesce(F.is_variant_null(there), F.lit(False)) | F.coalesce(F.is_variant_null(own), F.lit(False))
            value = F.when(reset, _default(default)).otherwise(F.coalesce(given, value))
        return value.alias(name)

    return F.struct(*[F.struct(*[field(s, n, d) for n, d in fields.items()]).alias(s) for s, fields in SECTIONS.items()])


def resolve(repos: DataFrame, documents: DataFrame) -> DataFrame:
    """``settings`` of each (org, repo): the organisation's document (repo null), then the repository's, over the defaults.

    ``documents``: org, repo, document (JSON text). Both joins are on narrow rows.
    """
    parsed = documents.select("org", "repo", F.try_parse_json("document").alias("d"))
    at_org = parsed.where("repo IS NULL").select("org", F.col("d").alias("_of_org"))
    at_repo = parsed.where("repo IS NOT NULL").select("org", "repo", F.col("d").alias("_of_repo"))
    joined = repos.join(at_org, "org", "left").join(at_repo, ["org", "repo"], "left")
    return joined.select(*repos.columns, merged(F.col("_of_org"), F.col("_of_repo")).alias("settings"))


def update(documents: DataFrame, patches: DataFrame) -> DataFrame:
    """(org, repo, document, patch) for stored documents and patches by scope; what ``merged`` takes, in this order."""
    new = patches.select(F.col("org").alias("_org"), F.col("repo").alias("_repo"), F.col("document").alias("patch"))
    met = documents.join(new, (F.col("org") == F.col("_org")) & F.col("repo").eqNullSafe(F.col("_repo")), "full_outer")
    return met.select(F.coalesce("org", "_org").alias("org"), F.coalesce("repo", "_repo").alias("repo"), "document", "patch")


def switched(rule_ids: Column, settings: Column) -> Column:
    """The rules without those that the settings turn off."""
    off = F.array_compact(F.array(*[F.when(~settings[s][n], F.lit(rule)) for (s, n), rule in SWITCHES.items()]))
    return F.filter(rule_ids, lambda r: ~F.array_contains(off, r))


def blocks(violations: Column, settings: Column) -> Column:
    """Is there a violation as severe as the threshold or more? An unknown threshold blocks nothing."""
    threshold = settings["security"]["block_threshold"]
    known = threshold.isin("critical", "high", "medium", "low", "info")
    return known & F.exists(violations, lambda v: severity_rank(v["severity"]) <= severity_rank(threshold))


def enforcement(mode: Column, violations: Column, settings: Column) -> Column:
    """The action of a mode, where the settings' threshold says what blocks."""
    some = F.size(violations) > 0
    return (F.when((mode == "blocking") & blocks(violations, settings), F.lit("block"))
            .when(mode.isin("blocking", "warning") & some, F.lit("annotate")).otherwise(F.lit("none")))
