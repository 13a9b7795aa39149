"""Configuration: resolution, overlay, upsert, pack enabling, path scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanfold.catalog import Catalogue
from scanfold.functions.paths import matches_any_glob

# --- Fixed values: defaults --------------------------------------------------
DEFAULT_MODE = "warning"
DEFAULT_PACKS = ("default-security", "enterprise-standards")
DEFAULT_ALLOWED = ("MIT", "Apache-2.0", "BSD-3-Clause")
DEFAULT_BLOCKED = ("GPL-3.0", "AGPL-3.0")
DEFAULT_INCLUDE = ("src/**/*", "lib/**/*")
DEFAULT_EXCLUDE = ("node_modules/**", "dist/**", "build/**", "*.min.js")
STORED_EXCLUDE = ("node_modules/**", "dist/**")     # for a stored row whose list is empty

LIST_DEFAULTS = {
    "enabled_rule_packs": DEFAULT_PACKS, "custom_rules": (), "allowed_licenses": DEFAULT_ALLOWED,
    "blocked_licenses": DEFAULT_BLOCKED, "include_patterns": DEFAULT_INCLUDE,
    "exclude_patterns": STORED_EXCLUDE, "override_approvers": (),
}
CONFIG_FIELDS = ("enforcement_mode", *LIST_DEFAULTS, "override_allowed")


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _or_default(column: Column, default: Column) -> Column:
    """Null and empty lists both fall back."""
    return F.when(column.isNull() | (F.size(column) == 0), default).otherwise(column)


def resolve(repos: DataFrame, configs: DataFrame) -> DataFrame:
    """One configuration per (org, repo): the repository's row, else the organisation's, else defaults.

    Two keyed left joins.  ``configs`` is not hinted: Spark broadcasts it while
    it is below the threshold and otherwise shuffles on the key, splitting a hot
    organisation at run time.
    """
    fields = [c for c in CONFIG_FIELDS if c in configs.columns]
    packed = F.struct(*fields)
    at_repo = configs.filter(F.col("repo").isNotNull()).select("org", "repo", packed.alias("_repo"))
    at_org = configs.filter(F.col("repo").isNull()).select("org", packed.alias("_org"))
    joined = repos.join(at_repo, ["org", "repo"], "left").join(at_org, "org", "left")
    row = F.coalesce("_repo", "_org")
    level = F.when(F.col("_repo").isNotNull(), "repo").when(F.col("_org").isNotNull(), "org").otherwise("default")
    out = joined.select(*repos.columns, level.alias("config_level"), row.alias("_c"))
    for name in fields:
        value = F.col("_c")[name]
        if name in LIST_DEFAULTS:
            unset = strings(DEFAULT_EXCLUDE if name == "exclude_patterns" else LIST_DEFAULTS[name])
            value = F.when(F.col("config_level") == "default", unset).otherwise(
                _or_default(value, strings(LIST_DEFAULTS[name])))
        elif name == "enforcement_mode":
            value = F.coalesce(value, F.lit(DEFAULT_MODE))
        else:
            value = F.coalesce(value, F.lit(True))
        out = out.withColumn(name, value)
    return out.drop("_c")


def upsert(configs: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """Per-field update where a value is given; otherwise keep, or insert with defaults."""
    fields = [c for c in CONFIG_FIELDS if c in configs.columns]
    old = configs.select("org", "repo", *[F.col(f).alias(f"_old_{f}") for f in fields],
                         F.col("updated_at").alias("_old_at"), F.lit(True).alias("_had"))
    new = updates.select(F.col("org").alias("_n_org"), F.col("repo").alias("_n_repo"),
                         *[F.col(f).alias(f"_new_{f}") if f in updates.columns else F.lit(None).alias(f"_new_{f}")
                           for f in fields], F.lit(True).alias("_has"))
    joined = old.join(new, (F.col("org") == F.col("_n_org")) & F.col("repo").eqNullSafe(F.col("_n_repo")),
                      "full_outer")
    inserts = {"enforcement_mode": F.lit(DEFAULT_MODE), "override_allowed": F.lit(True)}
    columns = [F.coalesce("org", "_n_org").alias("org"),
               F.when(F.col("_had"), F.col("repo")).otherwise(F.col("_n_repo")).alias("repo")]
    for f in fields:
        fallback = F.when(F.col("_had").isNull(), inserts[f]) if f in inserts else F.lit(None)
        columns.append(F.coalesce(f"_new_{f}", f"_old_{f}", fallback).alias(f))
    columns.append(F.when(F.col("_has"), now).otherwise(F.col("_old_at")).alias("updated_at"))
    return joined.select(*columns)


def enable_pack(configs: DataFrame, catalogue: Catalogue, pack: str, org: str, repo: str | None = None) -> DataFrame:
    """Append a pack to one configuration row."""
    if pack not in catalogue.packs:
        raise ValueError(f"Unknown rule pack: {pack}")
    here = (F.col("org") == org) & F.col("repo").eqNullSafe(F.lit(repo))
    packs = F.coalesce("enabled_rule_packs", strings(DEFAULT_PACKS))
    return configs.withColumn("enabled_rule_packs", F.when(
        here, F.array_union(packs, strings([pack]))).otherwise(F.col("enabled_rule_packs")))


def enable_packs(configs: DataFrame, requests: DataFrame, catalogue: Catalogue) -> tuple[DataFrame, DataFrame]:
    """Configurations after many requests (org, repo, pack), and the requests for packs that aren't known.

    A pack is appended once, after those that are enabled; a scope without a row
    gets one with the default packs and its own, other fields unset. The requests
    of a scope are combined before they meet the configurations.
    """
    known = F.col("pack").isin(list(catalogue.packs))
    wanted = requests.where(known).groupBy(F.col("org").alias("_org"), F.col("repo").alias("_repo")).agg(
        F.array_sort(F.collect_set("pack")).alias("_more"))
    joined = configs.withColumn("_had", F.lit(True)).join(
        wanted, (F.col("org") == F.col("_org")) & F.col("repo").eqNullSafe(F.col("_repo")), "full_outer")
    packs = F.coalesce("enabled_rule_packs", strings(DEFAULT_PACKS))
    new = {"org": F.coalesce("org", "_org"), "repo": F.when(F.col("_had"), F.col("repo")).otherwise(F.col("_repo")),
           "enabled_rule_packs": F.when(F.col("_more").isNotNull(), F.array_union(packs, "_more")).otherwise(F.col("enabled_rule_packs"))}
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in configs.columns]), requests.where(~known | F.col("pack").isNull())


def overlay(parsed: DataFrame) -> DataFrame:
    """Parsed repository files over the defaults, section by section.

    Top-level values fall back to the defaults.  Inside ``security`` and
    ``standards`` the file's value always wins, also when it is missing: those
    come out null, not defaulted.  ``license`` is replaced as a whole.
    """
    licence = F.coalesce("license", F.struct(strings(DEFAULT_ALLOWED).alias("allowed"),
                                             strings(DEFAULT_BLOCKED).alias("blocked")))
    mode = F.nullif(F.col("enforcement_mode"), F.lit(""))
    return parsed.select(
        *[c for c in parsed.columns if c in ("org", "repo")],
        F.when(F.col("has_file"), F.coalesce(mode, F.lit(DEFAULT_MODE))).otherwise(DEFAULT_MODE)
         .alias("enforcement_mode"),
        F.when(F.col("has_file"), F.coalesce("rule_packs", strings(DEFAULT_PACKS)))
         .otherwise(strings(DEFAULT_PACKS)).alias("rule_packs"),
        F.when(F.col("has_file"), F.col("security.block_threshold")).otherwise(F.lit("high")).alias("block_threshold"),
        F.when(F.col("has_file"), F.col("security.secrets")).otherwise(F.lit(True)).alias("secrets_enabled"),
        F.when(F.col("has_file"), F.col("standards.naming")).otherwise(F.lit(True)).alias("naming_enabled"),
        F.when(F.col("has_file"), licence["allowed"]).otherwise(strings(DEFAULT_ALLOWED)).alias("allowed"),
        F.when(F.col("has_file"), licence["blocked"]).otherwise(strings(DEFAULT_BLOCKED)).alias("blocked"),
        F.when(F.col("has_file"), F.col("copilot.strict_mode")).otherwise(F.lit(True)).alias("strict_mode"))


def in_scope(path: Column, include: Column, exclude: Column) -> Column:
    """Inside an include glob (or none are given) and outside every exclude glob."""
    return ((F.size(include) == 0) | matches_any_glob(path, include)) & ~matches_any_glob(path, exclude)
