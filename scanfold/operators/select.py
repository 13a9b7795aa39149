"""Rule selection and applicability as joins on the small catalogue frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanfold.catalog import DEFAULT_SCAN_PACKS, Catalogue
from scanfold.catalog.frames import packs_frame, rules_frame


def selected_rule_ids(catalogue: Catalogue, packs: Column, rule_ids: Column | None = None,
                      category: str | None = None, default_packs=DEFAULT_SCAN_PACKS) -> Column:
    """Per row: explicit ids, else the packs' rules, else the default packs; unknown names ignored.

    The catalogue is a constant, so this is a lookup in a literal map, not a join.
    """
    def ids(names):
        return F.array(*[F.lit(n) for n in names]).cast("array<string>")

    members = F.create_map(*[x for name, rules in catalogue.list_packs().items()
                             for x in (F.lit(name), ids(i for i in rules if i in catalogue.rules))])
    chosen = F.when(F.size(F.coalesce(packs, F.array().cast("array<string>"))) == 0, ids(default_packs)).otherwise(packs)
    from_packs = F.array_distinct(F.flatten(F.transform(
        chosen, lambda p: F.coalesce(members[p], F.array().cast("array<string>")))))
    out = from_packs
    if rule_ids is not None:
        known = ids(catalogue.rules)
        out = F.when(F.size(F.coalesce(rule_ids, F.array().cast("array<string>"))) > 0, F.array_distinct(
            F.filter(rule_ids, lambda i: F.array_contains(known, i)))).otherwise(from_packs)
    if category:
        allowed = ids(r.rule_id for r in catalogue.list_rules() if r.category == category)
        out = F.filter(out, lambda i: F.array_contains(allowed, i))
    return out


def applicable_rules(files: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Files joined to the rules that support their language (an empty list supports all)."""
    rules = rules_frame(files.sparkSession, catalogue)
    languages = catalogue.languages()
    by_language = F.broadcast(rules.select(
        "rule_id", F.explode(F.when(F.size("languages") == 0, F.array(*[F.lit(x) for x in [*languages, "*"]]))
                             .otherwise(F.transform("languages", F.lower))).alias("_language")))
    lang = F.lower("language")
    keyed = files.withColumn("_language", F.when(lang.isin(languages), lang).otherwise(F.lit("*")))
    return keyed.join(by_language, "_language").drop("_language")


def list_rules(rules: DataFrame, category: str | None = None, enabled: bool | None = None) -> DataFrame:
    if category is not None:
        rules = rules.filter(F.col("category") == category)
    if enabled is not None:
        rules = rules.filter(F.col("enabled") == enabled)
    return rules


def pack_listing(configs: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Every pack with its rule count, and in how many configurations it is enabled."""
    packs = packs_frame(configs.sparkSession, catalogue)
    used = (configs.select(F.explode("enabled_rule_packs").alias("pack"), "org", "repo")
            .groupBy("pack").agg(F.count(F.lit(1)).alias("enabled_in")))
    return packs.join(used, "pack", "left").select(
        "pack", "display_name", "description", "category", F.size("rules").alias("rule_count"),
        "rules", F.coalesce("enabled_in", F.lit(0)).cast("bigint").alias("enabled_in"))
