"""Scan of what pushes bring: each changed file as it stood at the push's commit.

A repository's file versions are a table by commit order. A push meets, for each
file it changed, the newest version at or before its own commit. Pushes share
versions, and versions share content, so each content is scanned once for each
rule selection it meets, and the counters are joined back to the pushes' files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanfold.catalog import Catalogue
from scanfold.functions.dialect import any_of
from scanfold.functions.paths import detect_language
from scanfold.operators import config, events, rollup, select
from scanfold.operators.asof import as_of
from scanfold.operators.scan import find_violations
from scanfold.sources.tables import staged

PUSH_KEYS = ("event_id", "org", "repo", "branch", "commit_sha", "author")


def pushed_versions(pushes: DataFrame, versions: DataFrame) -> DataFrame:
    """The changed supported files of each push with their ``version`` (null where the repository never had one).

    ``pushes`` are typed pushes whose event_id is their place in commit order;
    ``versions`` has org, repo, file_path, position and whatever is known of a version.
    """
    changed = events.changed_files(pushes).withColumn("position", F.col("event_id"))
    return as_of(changed, versions, ["org", "repo", "file_path"], "position")


def _exemptions(path: Column, catalogue: Catalogue) -> Column:
    """Which of the catalogue's path exemptions hold: paths alike in this are scanned alike."""
    patterns = sorted({any_of(r.skip_path, "i") for r in catalogue.list_rules() if r.skip_path})
    return F.concat_ws("", *[F.rlike(path, F.lit(p)).cast("int").cast("string") for p in patterns], F.lit(""))


def scan_pushes(pushes: DataFrame, versions: DataFrame, configs: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Counters, enforcement action and AI flag per push and file found.

    ``versions``: version_id, org, repo, file_path, position, code (null where the
    file was removed) and detected_ai_code. The packs are those of the push's
    repository, as configured.
    """
    known = versions.select("org", "repo", "file_path", "position", "version_id", F.sha2("code", 256).alias("digest"), "detected_ai_code")
    found = pushed_versions(pushes, known).where(F.col("version.digest").isNotNull())
    chosen = select.selected_rule_ids(catalogue, F.col("enabled_rule_packs"), F.col("custom_rules"))
    settings = configs.select("org", "repo", "enforcement_mode", "enabled_rule_packs", "custom_rules")
    files = config.resolve(found, settings).select(
        "event_id", "org", "repo", "commit_sha", "file_path", "enforcement_mode", "version.*", chosen.alias("rule_ids"),
        detect_language(F.col("file_path")).alias("language"), _exemptions(F.col("file_path"), catalogue).alias("exempt"))
    files = staged(files.withColumn("unit", F.sha2(F.concat_ws(
        "|", "digest", "language", "exempt", F.array_join("rule_ids", ",")), 256)))

    units = files.groupBy("unit").agg(F.min(F.struct("version_id", "file_path", "language", "rule_ids")).alias("u")).select("unit", "u.*")
    texts = units.join(versions.select("version_id", "code"), "version_id").withColumn("file_id", F.col("version_id"))
    scanned = find_violations(texts, catalogue.list_rules(), languages=catalogue.languages(), selected="rule_ids",
                              dedupe="location", keep=("unit",))
    counted = staged(rollup.summarize(scanned).select("unit", *rollup.COUNTERS))
    return files.join(counted, "unit").withColumn("enforcement_action", rollup.enforcement(
        F.col("enforcement_mode"), F.col("total_issues"), F.col("critical"), F.col("high"))).drop("unit", "digest", "exempt", "rule_ids")


def push_roll_up(pushes: DataFrame, scanned: DataFrame, configs: DataFrame) -> DataFrame:
    """One row per push that changed a supported file: sums over the files found, zeros where none was."""
    changed = events.changed_files(pushes).select("event_id").distinct()
    sums = rollup.roll_up(scanned, "event_id")
    rows = pushes.select(*PUSH_KEYS).join(changed, "event_id", "left_semi").join(sums, "event_id", "left")
    zero = F.lit(0).cast("bigint")
    defaults = {"files": zero, **{c: zero for c in rollup.COUNTERS}, "detected_ai_code": F.lit(False),
                "status": F.lit("clean"), "enforcement_action": F.lit("none")}
    whole = rows.select(*PUSH_KEYS, *[F.coalesce(c, d).alias(c) for c, d in defaults.items()])
    return config.resolve(whole, configs.select("org", "repo", "enforcement_mode")).drop("config_level")
