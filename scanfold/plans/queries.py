"""Every operator as a query over the given tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanfold.catalog import Catalogue, versions
from scanfold.functions import kernel, naming
from scanfold.functions.dialect import to_jvm
from scanfold.functions.paths import detect_language, is_supported
from scanfold.functions.text import let, line_range, lines_of, strip
from scanfold.operators import ai, audit, config, contents, dedup, events, license, pushes, report, rollup, rules_store, scope, select, settings
from scanfold.operators.scan import explode_violations, scan
from scanfold.operators.similarity import similar_sources
from scanfold.sources import derived, sinks
from scanfold.sources.corpus import build_files, code_files, document_files
from scanfold.sources.tables import shared_folder, staged, table
from scanfold import streaming

CATALOGUE = Catalogue.builtin()
RULE_KEYS = {
    "sec_001": "SEC-001", "sec_002": "SEC-002", "sec_003": "SEC-003", "sec_004": "SEC-004", "sec_005": "SEC-005",
    "std_001": "STD-001", "std_002": "STD-002", "std_003": "STD-003", "hipaa_001": "HIPAA-001",
    "hipaa_002": "HIPAA-002", "hipaa_003": "HIPAA-003", "tel_001": "TEL-001", "tel_002": "TEL-002",
    "fed_001": "FED-001", "fed_002": "FED-002", "fed_003": "FED-003",
}
PACK_KEYS = {
    "scan_pack_default_security": "default-security", "scan_pack_enterprise_standards": "enterprise-standards",
    "scan_pack_healthcare": "healthcare", "scan_pack_telecom": "telecom", "scan_pack_government": "government",
}
CORE_PACKS = ("default-security", "enterprise-standards")
HIT_COLUMNS = ("file_id", "rule_id", "line_start", "line_end", "severity", "category", "label", "title",
               "description", "code_snippet", "owasp_mapping", "cwe_id")
SHORT = ("file_id", "rule_id", "line_start", "line_end", "severity")
ROLLED_FIELDS = ("line_start", "line_end", "rule_id", "severity", "category", "title", "description", "code_snippet",
                 "owasp_mapping", "cwe_id")

CALL_RE = r"\w+\s*\([^)]*\)"          # sample patterns of the kernel queries
BLOCK_RE = r"\{[^}]*\}"
RETURN_RE = r"return"
OPEN_RE = r"\)\s*(?:=>\s*)?\{"
WORD_CALL_RE = r"[a-z]+\s*\("


def _rule(rule_id: str):
    return lambda spark, sf: _hits(spark, sf, CATALOGUE.select([rule_id]), HIT_COLUMNS)


def _pack(name: str):
    return lambda spark, sf: _hits(spark, sf, CATALOGUE.select(packs=[name]), SHORT)


def _contents(spark, sf, rules, dedupe="rule") -> tuple[DataFrame, DataFrame]:
    """The code corpus without its texts, and the hits of each content."""
    return contents.scan_contents(code_files(spark, sf), rules, languages=CATALOGUE.languages(), dedupe=dedupe)


def _hits(spark, sf, rules, columns, dedupe="rule") -> DataFrame:
    """One row per file and hit."""
    files, hits = _contents(spark, sf, rules, dedupe)
    own = [c for c in columns if c in files.columns]
    return _exploded(contents.with_hits(files.select(*own, "unit"), hits, *[c for c in columns if c not in own])).select(*columns)


def _exploded(scanned: DataFrame) -> DataFrame:
    """As ``explode_violations``, of any fields that hold rule_id, without ids."""
    rows = scanned.select(*[c for c in scanned.columns if c != "violations"], F.inline_outer("violations"))
    return rows.filter(F.col("rule_id").isNotNull())


def _csv(name: str):
    return F.array_join(name, ",").alias(name)


# --- sources and projections ---------------------------------------------------

def src_code_files(spark, sf):
    body = (F.when(F.col("file_id") % 29 == 0, F.lit(None)).when(F.col("file_id") % 31 == 0, F.lit(""))
            .otherwise(F.base64(F.encode("code", "utf-8"))))
    files = code_files(spark, sf).select("file_id", "file_path", "language", body.alias("content_b64"))
    return events.decoded_files(files).select(
        "file_id", "file_path", "language", F.length("code").cast("bigint").alias("n_chars"),
        F.sha2("code", 256).alias("digest"))


def src_pr_events(spark, sf):
    return events.pr_events(derived.frame(spark, sf, derived.PR_PAYLOADS))


def src_push_events(spark, sf):
    pushes = events.push_events(derived.frame(spark, sf, derived.PUSH_PAYLOADS))
    return pushes.withColumn("n_commits", F.size("commits")).drop("commits")


def changed_files(spark, sf):
    return events.changed_files(events.push_events(derived.frame(spark, sf, derived.PUSH_PAYLOADS)))


def _push_log(spark, sf):
    return events.push_events(derived.frame(spark, sf, derived.PUSH_LOG))


def pushed_versions(spark, sf):
    """For each file a push changed, the version that its commit sees."""
    known = derived.frame(spark, sf, derived.FILE_VERSIONS).select("org", "repo", "file_path", "position", "version_id")
    return pushes.pushed_versions(_push_log(spark, sf), known).select(
        "event_id", "org", "repo", "commit_sha", "file_path", F.col("version.version_id").alias("version_id"))


def _ai_flags(spark, sf, key: str) -> DataFrame:
    """The detector's verdict by file or version."""
    return ai.authorship(derived.frame(spark, sf, derived.AUTHORSHIP)).select(F.col("file_id").alias(key), "detected_ai_code")


def detect_languages(spark, sf):
    code = derived_files(spark, sf).select("file_path")
    pages = table(spark, sf, "pages").select(F.col("url").alias("file_path"))
    return code.unionByName(pages).select("file_path", detect_language(F.col("file_path")).alias("language"),
                                          is_supported(F.col("file_path")).alias("supported"))


def derived_files(spark, sf):
    return code_files(spark, sf).drop("code")


def supported_files(spark, sf):
    status = F.when(F.col("file_id") % 6 == 0, "removed").when(F.col("file_id") % 6 == 1, "added").otherwise("modified")
    return events.supported_files(derived_files(spark, sf).withColumn("change_status", status)).select(
        "file_id", "file_path", "language", "change_status")


def rules_applicable(spark, sf):
    return select.applicable_rules(derived_files(spark, sf).select("file_id", "language"), CATALOGUE)


def _repos(spark, sf) -> DataFrame:
    return derived_files(spark, sf).select("org", "repo").distinct()


def _resolved(spark, sf) -> DataFrame:
    return config.resolve(_repos(spark, sf), derived.configurations(spark, sf))


def config_resolve(spark, sf):
    return _resolved(spark, sf).select("org", "repo", "config_level", "enforcement_mode", *[
        _csv(c) for c in config.LIST_DEFAULTS], "override_allowed")


def rules_selected(spark, sf):
    chosen = select.selected_rule_ids(CATALOGUE, F.col("enabled_rule_packs"), F.col("custom_rules"))
    return _resolved(spark, sf).select("org", "repo", F.array_join(chosen, ",").alias("rule_ids"))


def scan_pack(spark, sf):
    """Each file scanned with the packs of its repository's configuration."""
    chosen = select.selected_rule_ids(CATALOGUE, F.col("enabled_rule_packs"), F.col("custom_rules"))
    settings = _resolved(spark, sf).select("org", "repo", chosen.alias("rule_ids")).where(F.size("rule_ids") > 0)
    files, hits = _contents(spark, sf, CATALOGUE.list_rules())
    size = F.octet_length(F.concat_ws("", "org", "repo")) + F.octet_length(F.array_join("rule_ids", ",")) + 64
    met = scope.together(scope.with_settings(files.select("file_id", "org", "repo", "unit"), settings, ["org", "repo"], size))
    return _exploded(_selected(contents.with_hits(met, hits, *SHORT[1:]))).select(*SHORT)


def _selected(scanned: DataFrame) -> DataFrame:
    """Hits of all rules cut to those in ``rule_ids``: de-duplication is by rule, so this is a scan with these rules."""
    return scanned.withColumn("violations", F.filter("violations", lambda v: F.array_contains("rule_ids", v["rule_id"])))


def path_scope_filter(spark, sf):
    files = config.resolve(derived_files(spark, sf), derived.configurations(spark, sf))
    return files.select("file_id", "file_path", config.in_scope(
        F.col("file_path"), F.col("include_patterns"), F.col("exclude_patterns")).alias("in_scope"))


def with_patch(files: DataFrame) -> DataFrame:
    """A unified diff per file: every third line added, some old lines removed, two hunks."""
    pieces = F.transform(lines_of(F.col("code")), lambda line, i: F.concat(
        F.when(i == 5, F.lit("@@ -9,4 +6,9 @@ tail\n")).otherwise(""),
        F.when((i + F.col("file_id")) % 5 == 0, F.lit("-old line\n")).otherwise(""),
        F.when((i + F.col("file_id")) % 3 == 0, F.lit("+")).otherwise(F.lit(" ")), line))
    return files.withColumn("patch", F.concat(F.lit("@@ -1,8 +1,5 @@\n"), F.array_join(pieces, "\n")))


def diff_only_hits(spark, sf):
    def cut(scanned: DataFrame) -> DataFrame:
        return events.on_added_lines(scanned.withColumn("added", events.added_lines(F.col("patch"))).drop("patch"))
    files, hits = contents.scan_contents(
        with_patch(code_files(spark, sf)), CATALOGUE.list_rules(), languages=CATALOGUE.languages(), beside=("patch",), each=cut)
    return _exploded(contents.with_hits(files.select("file_id", "unit"), hits, *SHORT[1:])).select(*SHORT)


def config_overlay(spark, sf):
    out = config.overlay(derived.parsed_config_files(spark, sf))
    return out.select("org", "repo", "enforcement_mode", _csv("rule_packs"), "block_threshold", "secrets_enabled",
                      "naming_enabled", _csv("allowed"), _csv("blocked"), "strict_mode")


def _settings_columns(of: Column) -> list:
    shown = {list: lambda c: F.array_join(c, ","), dict: F.to_json}
    return [shown.get(type(d), lambda c: c)(of[s][n]).alias(f"{s}_{n}")
            for s, fields in settings.SECTIONS.items() for n, d in fields.items()]


def _settings(spark, sf) -> DataFrame:
    documents = derived.frame(spark, sf, derived.REPO_SETTINGS).unionByName(derived.frame(spark, sf, derived.ORG_SETTINGS))
    return settings.resolve(_repos(spark, sf), documents)


def settings_resolve(spark, sf):
    """All seven sections of each repository's settings."""
    return _settings(spark, sf).select("org", "repo", *_settings_columns(F.col("settings")))


def settings_update(spark, sf):
    """Stored documents with patches: by path, also on rows that exist."""
    met = settings.update(derived.frame(spark, sf, derived.REPO_SETTINGS), derived.frame(spark, sf, derived.SETTINGS_PATCHES))
    return met.select("org", "repo", *_settings_columns(settings.merged(F.try_parse_json("document"), F.try_parse_json("patch"))))


def scan_with_settings(spark, sf):
    """Files scanned with the rules that their repository's settings leave on; the threshold decides what blocks."""
    every = F.array(*[F.lit(r.rule_id) for r in CATALOGUE.list_rules()])
    known = _settings(spark, sf).select("org", "repo", F.col("settings.security.block_threshold").alias("block_threshold"),
                                        settings.switched(every, F.col("settings")).alias("rule_ids"))
    size = F.octet_length(F.concat_ws("", "org", "repo")) + F.octet_length(F.array_join("rule_ids", ",")) + 64
    files, hits = _contents(spark, sf, CATALOGUE.list_rules())
    met = scope.together(scope.with_settings(files.select("file_id", "org", "repo", "unit"), known, ["org", "repo"], size))
    found = _selected(contents.with_hits(met, hits, "rule_id", "severity"))
    switches = F.struct(F.struct("block_threshold").alias("security"))
    action = settings.enforcement(F.lit("blocking"), F.col("violations"), switches)
    return found.select("file_id", F.size("violations").alias("total_issues"), action.alias("enforcement_action"))


def list_rules(spark, sf):
    return select.list_rules(derived.custom_rules(spark, sf), "security", True).select(
        "id", "name", "severity", "rule_type", "org", "repo")


def pack_listing(spark, sf):
    configs = config.resolve(_repos(spark, sf), derived.configurations(spark, sf))
    return select.pack_listing(configs, CATALOGUE).select(
        "pack", "display_name", "category", "rule_count", _csv("rules"), "enabled_in")


# --- kernel ---------------------------------------------------------------------

def _marked(spark, sf):
    return code_files(spark, sf).withColumn("marks", kernel.markers(F.col("code")))


def regex_finditer(spark, sf):
    found = kernel.finditer(F.col("code"), F.lit(to_jvm(CALL_RE)), F.col("marks"))
    return _marked(spark, sf).select("file_id", F.inline_outer(found)).select(
        "file_id", F.col("start").cast("bigint").alias("start_at"), F.col("end").cast("bigint").alias("end_at"), "match").filter(F.col("start_at").isNotNull())


def _spans(spark, sf, regex):
    marked = kernel.bracket(F.col("code"), F.lit(to_jvm(regex)), F.col("marks"))
    return _marked(spark, sf).withColumn("spans", let(marked, lambda m: kernel.match_spans(
        m, F.col("marks"))))


def line_numbers(spark, sf):
    return _spans(spark, sf, BLOCK_RE).select("file_id", F.posexplode_outer("spans").alias("n", "s")).filter(F.col("n").isNotNull()).select(
        "file_id", "n", F.col("s.first").alias("line_start"), F.col("s.last").alias("line_end"))


def snippets(spark, sf):
    cut = let(lines_of(F.col("code")), lambda lines: F.transform("spans", lambda s: strip(
        line_range(lines, s["first"], s["last"]))))
    return _spans(spark, sf, BLOCK_RE).select("file_id", F.posexplode_outer(cut).alias("n", "snippet")).filter(
        F.col("n").isNotNull())


def context_window(spark, sf):
    cut = let(lines_of(F.col("code")), lambda lines: F.transform("spans", lambda s: line_range(
        lines, s["first"] - 2, s["first"] + 3)))
    return _spans(spark, sf, RETURN_RE).select("file_id", F.posexplode_outer(cut).alias("n", "context")).filter(
        F.col("n").isNotNull())


def comment_skip(spark, sf):
    marked = kernel.bracket(F.col("code"), F.lit(to_jvm(WORD_CALL_RE)), F.col("marks"))
    rows = (_marked(spark, sf).select("file_id", "language", F.col("marks.open").alias("open"),
                                      F.posexplode(lines_of(marked)).alias("n", "line"))
            .filter(F.contains("line", F.col("open"))))
    return rows.select("file_id", (F.col("n") + 1).alias("line"), kernel.commented_before(
        F.col("line"), F.col("open"), F.col("language")).alias("commented"))


def brace_body(spark, sf):
    marked = kernel.bracket(F.col("code"), F.lit(to_jvm(OPEN_RE)), F.col("marks"))
    bodies = kernel.brace_bodies(marked, F.col("marks"))
    return _marked(spark, sf).select("file_id", F.posexplode_outer(bodies).alias("n", "body")).filter(F.col("n").isNotNull()).select(
        "file_id", "n", F.length("body").cast("bigint").alias("body_chars"), F.md5("body").alias("body_md5"))


# --- rules ------------------------------------------------------------------------

def std_003_async(spark, sf):
    return _hits(spark, sf, CATALOGUE.select(["STD-003"]), HIT_COLUMNS).filter(F.col("label") == "unhandled async")


def secrets_in_documents(spark, sf):
    return scan(document_files(spark, sf), rule_ids=["SEC-001"]).select(
        "file_id", "line_start", "line_end", F.md5("code_snippet").alias("snippet_md5"))


def naming_fix(spark, sf):
    return derived.frame(spark, sf, derived.NAMES).select(
        "name_id", "name", naming.suggestion(F.col("name"), F.col("element"), F.col("language")).alias("suggestion"))


def scan_security(spark, sf):
    return _hits(spark, sf, CATALOGUE.select(category="security"), SHORT)


def scan_standards(spark, sf):
    return _hits(spark, sf, CATALOGUE.select(category="standards"), SHORT)


def custom_regex_rules(spark, sf):
    return rules_store.scan_custom(code_files(spark, sf), derived.custom_rules(spark, sf)).select(
        "file_id", "rule_id", "line_start", "line_end", "severity", "category", "title", "description")


def custom_rule_errors(spark, sf):
    """Stored rules that can't run; the others are those that custom_regex_rules runs."""
    return rules_store.rule_errors(derived.custom_rules(spark, sf)).select(
        "id", "org", "repo", "name", "pattern", F.col("error").isNotNull().alias("rejected"))


# --- licences and similarity ------------------------------------------------------

def _license_files(spark, sf):
    columns = ["file_id", "org", "repo", "file_path", "code"]
    return (code_files(spark, sf).select(*columns)
            .unionByName(document_files(spark, sf).select(*columns))
            .unionByName(derived.frame(spark, sf, derived.MANIFESTS).select(*columns)))


def _detected(spark, sf):
    return license.detect(_license_files(spark, sf)).drop("code")


def license_detect(spark, sf):
    return _detected(spark, sf).filter(F.col("license_id").isNotNull()).select(
        "file_path", "license_id", "confidence", "license_source")


def license_name(spark, sf):
    return _detected(spark, sf).filter(F.col("license_id").isNotNull()).groupBy("license_id", "license_name").agg(
        F.count(F.lit(1)).alias("files"))


def _judged(spark, sf):
    policies = derived.configurations(spark, sf).select("org", "repo", "allowed_licenses", "blocked_licenses")
    return config.resolve(_detected(spark, sf), policies).withColumn("license_status", license.policy_status(
        F.col("license_id"), F.col("allowed_licenses"), F.col("blocked_licenses")))


def license_status(spark, sf):
    return _judged(spark, sf).filter(F.col("license_id").isNotNull()).select(
        "file_path", "org", "repo", "license_id", "license_status")


def license_report(spark, sf):
    return license.report(_judged(spark, sf), "org", "repo")


def license_recommendations(spark, sf):
    return license.recommendations(staged(_judged(spark, sf)), "org")


def ip_markers(spark, sf):
    return license.origin_markers(_license_files(spark, sf)).select(
        "file_path", "has_similar_code", _csv("sources"), "similarity_score", "ip_risk")


def _sources(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("source_id"), "text")


def code_similarity(spark, sf):
    return similar_sources(document_files(spark, sf), _sources(spark, sf)).select(
        "file_id", "source_id", "shared", "similarity_score", "risk_level")


def code_similarity_jaccard(spark, sf):
    return similar_sources(document_files(spark, sf), _sources(spark, sf), 0.4, "jaccard").select(
        "file_id", "source_id", "shared", "similarity_score")


# --- stored tables ----------------------------------------------------------------

def _core_contents(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The corpus scanned with the core packs, one hit per location."""
    return _contents(spark, sf, CATALOGUE.select(packs=CORE_PACKS), "location")


def _counted(files: DataFrame, hits: DataFrame) -> DataFrame:
    """Files with the counters and the status of their content; who needs its violations too meets them by ``unit``."""
    return contents.meet(files, staged(rollup.summarize(hits).drop("violations")), ["unit"])


def _core_counts(spark, sf) -> DataFrame:
    return _counted(*_core_contents(spark, sf)).drop("unit")


def _enforced(spark, sf) -> DataFrame:
    """Counters and enforcement action per file, under the repository's mode; no violations column."""
    return _with_action(_core_counts(spark, sf), spark, sf)


def _flagged(counted: DataFrame, spark, sf) -> DataFrame:
    """With the detector's flag; a file it has not seen has none."""
    return counted.join(_ai_flags(spark, sf, "file_id"), "file_id", "left").withColumn(
        "detected_ai_code", F.coalesce("detected_ai_code", F.lit(False)))


def _with_action(counted: DataFrame, spark, sf) -> DataFrame:
    modes = derived.configurations(spark, sf).select("org", "repo", "enforcement_mode", "override_allowed")
    return config.resolve(counted, modes).withColumn("enforcement_action", rollup.enforcement(
        F.col("enforcement_mode"), F.col("total_issues"), F.col("critical"), F.col("high")))


def _stored_scans(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Scan results of all rules as stored tables hold them: results with the unit of their content, and the hits of each."""
    return _contents(spark, sf, CATALOGUE.list_rules())


def violations_by_repo(spark, sf):
    """Violations joined to their scan result; counted per content, then per scan, before the join."""
    scanned, hits = _stored_scans(spark, sf)
    # Results of one file_id share their violations: each result counts those of all of them.
    results = scanned.select("file_id", "org", "repo", "unit").where("file_id IS NOT NULL").withColumn(
        "_results", F.count(F.lit(1)).over(Window.partitionBy("file_id")))
    per_unit = staged(_exploded(hits).groupBy("unit", "severity").agg(F.count(F.lit(1)).alias("n")))
    return contents.meet(results, per_unit, ["unit"]).groupBy("org", "repo", "severity").agg(
        F.sum(F.col("n") * F.col("_results")).alias("violations"))


def cascade_delete(spark, sf):
    scanned, hits = _stored_scans(spark, sf)
    deleted = table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("file_id"))
    results = scanned.select("file_id", "unit")
    _, left = sinks.delete_scans(results, results, deleted)
    return _exploded(contents.with_hits(left, hits, *SHORT[1:])).select(*SHORT)


def override_events(spark, sf):
    comments = derived.frame(spark, sf, derived.COMMENTS)
    return events.override_events(comments, derived.configurations(spark, sf), derived.OVERRIDE_COMMAND).select(
        "comment_id", "author", "justification", "can_override")


NOW = "TIMESTAMP_NTZ '2024-06-01 12:00:00'"


def config_upsert(spark, sf):
    out = config.upsert(derived.configurations(spark, sf), derived.config_updates(spark, sf), F.expr(NOW))
    return out.select("org", "repo", "enforcement_mode", _csv("enabled_rule_packs"), _csv("blocked_licenses"),
                      _csv("allowed_licenses"), "override_allowed", "updated_at")


def rule_upsert(spark, sf):
    rules = derived.custom_rules(spark, sf)
    changed = rules_store.upsert(rules, derived.frame(spark, sf, derived.RULE_UPDATES), F.expr(NOW))
    doomed = table(spark, sf, "part").filter("p_partkey % 13 = 2").select(
        F.concat(F.lit("R"), "p_partkey").alias("id"))
    return rules_store.delete(changed, doomed).select("id", "name", "severity", "enabled", "pattern", "updated_at")


def _audit(spark, sf):
    return derived.frame(spark, sf, derived.AUDIT_LOGS)


def audit_query(spark, sf):
    return audit.query(_audit(spark, sf), limit=100, offset=20, event_type="scan",
                       start=F.expr("TIMESTAMP_NTZ '2024-01-02 00:00:00'"),
                       end=F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'")).select(
        "id", "timestamp", "org", "repo", "action_taken", "violations_count")


CURSOR = ("2024-01-15 06:00:00", "a5")


def audit_page(spark, sf):
    """The page after a cursor, from a log stored by days."""
    path = shared_folder(spark)
    audit.write_by_day(_audit(spark, sf), path)
    return audit.page_after(spark.read.parquet(path), CURSOR, limit=100, event_type="scan").select(
        "id", "timestamp", "org", "repo", "action_taken", "violations_count")


def _catalogue_versions(spark, sf) -> DataFrame:
    """Stored rules registered, some changed (in a batch that comes twice), some removed, some of these back again."""
    base = table(spark, sf, "part").select(F.concat(F.lit("R"), "p_partkey").alias("id"), "p_partkey")
    first = derived.custom_rules(spark, sf).select("id", "name", "severity", "pattern")
    changed = first.join(base.where("p_partkey % 3 = 1"), "id").select(
        "id", "name", F.lit("low").alias("severity"), F.lit("changed").alias("pattern"))
    same = first.join(base.where("p_partkey % 3 = 2"), "id", "left_semi")
    at = lambda day: F.expr(f"TIMESTAMP_NTZ '{day} 00:00:00'")
    second = versions.changes_of(changed.unionByName(same), at("2024-02-01"))
    out = staged(versions.register(None, versions.changes_of(first, at("2024-01-01"))))
    for batch in (second, second, versions.removals_of(base.where("p_partkey % 13 = 2"), at("2024-03-01")),
                  versions.changes_of(first.join(base.where("p_partkey % 26 = 2"), "id", "left_semi"), at("2024-04-01"))):
        out = versions.register(out, batch)
    return out


def register_rules(spark, sf):
    return _catalogue_versions(spark, sf)


def catalogue_as_of(spark, sf):
    """The rules in force at a time, as a scan of that time names them."""
    return versions.as_of(_catalogue_versions(spark, sf), F.expr("TIMESTAMP_NTZ '2024-03-15 00:00:00'")).select("id", "severity", "pattern")


def pack_enable(spark, sf):
    enabled, _ = config.enable_packs(derived.configurations(spark, sf), derived.frame(spark, sf, derived.PACK_REQUESTS), CATALOGUE)
    return enabled.select("org", "repo", "enforcement_mode", _csv("enabled_rule_packs"))


def audit_resolve(spark, sf):
    logs = _audit(spark, sf)
    changes = table(spark, sf, "events").filter("event_id % 7 = 3").select(
        F.concat(F.lit("a"), "event_id").alias("id"), F.lit("resolved").alias("resolution_state"),
        F.concat(F.lit("user"), "user_id").alias("resolved_by"))
    return audit.resolve(logs, changes, F.expr(NOW)).select(
        "id", "resolution_state", "resolved_by", "resolved_at")


def audit_from_scan(spark, sf):
    modes = F.when(F.col("file_id") % 2 == 0, "blocking").otherwise("warning")
    acted = _flagged(_core_counts(spark, sf), spark, sf).withColumn(
        "enforcement_action", rollup.enforcement(modes, F.col("total_issues"), F.col("critical"), F.col("high")))
    return audit.from_scan(acted, F.expr(NOW)).drop("id", "timestamp")


def export_audit_csv(spark, sf):
    return audit.csv_rows(_audit(spark, sf))


def export_audit_json(spark, sf):
    return audit.json_rows(_audit(spark, sf))


# --- roll-ups -----------------------------------------------------------------------

def dedup_rule(spark, sf):
    """Row-wise de-duplication of raw hits, which are those of the file's content."""
    files, hits = _contents(spark, sf, CATALOGUE.list_rules(), "none")
    raw = _exploded(hits).select("unit", "rule_id", "line_start", "line_end", "label", "pattern_ord", "match_ord")
    first = dedup.first_per_key(raw, ["unit", "rule_id", "line_start", "line_end"], ["pattern_ord", "match_ord"]).drop("match_ord")
    columns = [c for c in first.columns if c != "unit"]
    kept = staged(first.groupBy("unit").agg(F.collect_list(F.struct(*columns)).alias("violations")))
    return _exploded(contents.meet(files.select("file_id", "unit").distinct(), kept, ["unit"])).select("file_id", *columns)


def dedup_location(spark, sf):
    return _hits(spark, sf, CATALOGUE.list_rules(), SHORT, "location")


def severity_summary(spark, sf):
    return _core_counts(spark, sf).select("file_id", *[F.col(c).cast("bigint").alias(c) for c in rollup.COUNTERS], "status")


def enforcement(spark, sf):
    return _enforced(spark, sf).select("file_id", "enforcement_mode", "enforcement_action")


def owasp_coverage(spark, sf):
    files, hits = _contents(spark, sf, CATALOGUE.select(category="security"))
    per_unit = staged(rollup.owasp_coverage(_exploded(hits), "unit"))
    return contents.meet(files.select("org", "unit"), per_unit, ["unit"]).groupBy("org", "owasp_mapping").agg(F.sum("hits").alias("hits"))


def standards_compliance(spark, sf):
    files, hits = _contents(spark, sf, CATALOGUE.select(category="standards"))
    flags = staged(rollup.standards_flags(hits).drop("violations"))
    return contents.meet(files, flags, ["unit"]).select("file_id", "naming", "logging", "error_handling")


def _rolled(spark, sf, *keys: str):
    return rollup.roll_up(_flagged(_enforced(spark, sf), spark, sf), "org", "repo", "pr_number", *keys)


def pr_rollup(spark, sf):
    """Counters, flag, action and all violations of each pull request; these as JSON, by path and place."""
    files, hits = _core_contents(spark, sf)
    keys = ("org", "repo", "pr_number")
    acted = _flagged(_with_action(_counted(files, hits), spark, sf), spark, sf).select(
        *keys, "file_path", "unit", *rollup.COUNTERS, "detected_ai_code", "enforcement_action")
    rolled = rollup.roll_up(contents.with_hits(acted, hits, *ROLLED_FIELDS), *keys)
    return rolled.withColumn("violations", F.to_json("violations", {"ignoreNullFields": "false"}))


def _pushes_rolled(spark, sf):
    files = derived.file_versions(spark, sf).join(_ai_flags(spark, sf, "version_id"), "version_id", "left").withColumn(
        "detected_ai_code", F.coalesce("detected_ai_code", F.lit(False)))
    configs = derived.configurations(spark, sf)
    log = _push_log(spark, sf)
    return pushes.push_roll_up(log, staged(pushes.scan_pushes(log, files, configs, CATALOGUE)), configs)


def push_rollup(spark, sf):
    return _pushes_rolled(spark, sf).drop("enforcement_mode")


def commit_status(spark, sf):
    """States of pull requests, on their head commit, and of pushes, each on its own."""
    per_pr = _rolled(spark, sf, "commit_sha", "enforcement_mode", "override_allowed")
    prs = rollup.pr_status(per_pr).select(
        F.lit("pull_request").alias("kind"), "org", "repo", "pr_number", "commit_sha", "state", "description")
    per_push = rollup.push_status(_pushes_rolled(spark, sf)).select(
        F.lit("push").alias("kind"), "org", "repo", F.lit(None).cast("int").alias("pr_number"), "commit_sha", "state", "description")
    return prs.unionByName(per_push)


def report_totals(spark, sf):
    return rollup.totals(_core_counts(spark, sf), "blocking")


def quality_score(spark, sf):
    files, hits = _contents(spark, sf, CATALOGUE.select(packs=CORE_PACKS))
    scored = contents.meet(files, staged(rollup.quality_scores(hits).drop("violations")), ["unit"])
    types = F.when(F.col("file_id") % 4 == 0, F.array(F.lit("security"))).when(
        F.col("file_id") % 4 == 1, F.array().cast("array<string>")).otherwise(
        F.array(F.lit("security"), F.lit("performance"), F.lit("maintainability")))
    return rollup.overall_score(scored, types).select(
        "file_id", "security_score", "maintainability_score", F.round("overall_score", 6).alias("overall_score"))


def _reported(files: DataFrame, hits: DataFrame, *fields: str) -> DataFrame:
    """Violations with their ids, of the named fields."""
    return explode_violations(contents.with_hits(files, hits, *fields).drop("unit"))


def report_tiers(spark, sf):
    files, hits = _core_contents(spark, sf)
    rows = _reported(files.select("file_id", "org", "repo", "pr_number", "file_path", "unit"), hits, *SHORT[1:])
    return report.tiers(rows, "org", "repo", "pr_number").select(*SHORT, "tier")


def severity_sorted(spark, sf):
    rows = _hits(spark, sf, CATALOGUE.select(), ("file_path", *SHORT))
    return report.by_severity(rows).select("severity_rank", *SHORT)


def report_markdown(spark, sf):
    keys = ("org", "repo", "pr_number")
    files, hits = _core_contents(spark, sf)
    rows = _reported(files.select("file_id", *keys, "file_path", "language", "unit"), hits)
    tagged = report.with_fixes(report.tiers(rows, *keys))
    acted = _with_action(_counted(files, hits).drop("unit"), spark, sf)
    summaries = rollup.roll_up(acted, *keys, "override_allowed")
    return report.markdown_blocks(summaries, tagged, *keys)


def ai_parse(spark, sf):
    return ai.parse(derived.frame(spark, sf, derived.AI_RESPONSES)).select(
        "file_id", "parse_failed", F.size("findings").alias("findings"))


def ai_violations(spark, sf):
    return ai.violations(ai.parse(derived.frame(spark, sf, derived.AI_RESPONSES))).drop("pos", "file_path")


def ai_recommendations(spark, sf):
    parsed = ai.recommendations(ai.parse(derived.frame(spark, sf, derived.AI_RESPONSES)))
    return parsed.select("file_id", F.array_join("recommendations", "; ").alias("recommendations"))


def ai_authorship(spark, sf):
    return ai.authorship(derived.frame(spark, sf, derived.AUTHORSHIP)).drop("raw")


def combine_hits(spark, sf):
    """Rule hits, then model findings on security, then on standards; the first per location stays."""
    columns = ["file_path", "line_start", "line_end", "rule_id", "ord"]
    found = ("file_path", "line_start", "line_end", "rule_id", "rule_ord", "pattern_ord", "match_ord")
    rule_hits = _hits(spark, sf, CATALOGUE.select(), found, "location").select(
        "file_path", "line_start", "line_end", "rule_id",
        F.struct("rule_ord", "pattern_ord", "match_ord").alias("ord"))
    found = ai.violations(ai.parse(derived.frame(spark, sf, derived.AI_RESPONSES)))
    def of(category):
        return found.filter(F.col("category") == category).withColumn("ord", F.struct(
            F.lit(0).alias("rule_ord"), F.lit(0).alias("pattern_ord"), F.col("pos").cast("int").alias("match_ord"))).select(*columns)
    combined = dedup.combine(rule_hits, of("security"), of("standards"))
    return dedup.first_per_key(combined, ["file_path", "line_start", "line_end"], ["source_ord", "ord"]).drop("ord")


# --- sinks and streams -----------------------------------------------------------------

def sink_scan_results(spark, sf):
    """Scans and violations committed, committed again by a retry, and read back: each violation with its scan, and clean scans."""
    path = shared_folder(spark)
    files, hits = _core_contents(spark, sf)
    acted = staged(_with_action(_flagged(_counted(files, hits), spark, sf), spark, sf))
    for _ in range(2):
        sinks.store_scans(acted, path, "first", F.expr(NOW), hits)
    results = sinks.committed(spark, path, "scan_results").drop("timestamp").withColumnRenamed("id", "scan_id")
    hits = sinks.committed(spark, path, "violations").drop("file_path").withColumnRenamed("id", "violation_id")
    # Ids are hex text: half as wide as bytes, which is how they meet.
    ids = ("scan_id", "violation_id")
    met = results.withColumn("scan_id", F.unhex("scan_id")).join(hits.withColumns({c: F.unhex(c) for c in ids}), "scan_id", "left")
    return met.withColumns({c: F.lower(F.hex(c)) for c in ids}).drop("language")


def audit_append(spark, sf):
    """Scan entries appended, appended again by a retry, then manual ones; read back, each once."""
    path, logs = shared_folder(spark), _audit(spark, sf)
    columns = ("id", "timestamp", "event_type", "org", "repo", "action_taken", "scan_id", "violations_count", "resolution_state")
    manual = audit.entry_rows(logs.where("event_type <> 'scan'").select(
        F.col("id").alias("number"), "event_type", "org", "repo", "action_taken"), "manual", F.expr(NOW))
    for rows, run in ((logs.where("event_type = 'scan'").select(*columns), "scans"), (manual, "manual")) * 2:
        audit.append(rows, path, run)
    return audit.stored(spark, path).select(*columns)


def _order_stream(spark, sf, source, **options):
    """Orders as a stream; spread by key while the rows are still a few numbers wide."""
    schema = table(spark, sf, "orders").schema
    stream = streaming.file_stream(spark, source, schema, **options)
    return stream.select("o_orderkey", "o_custkey", "o_orderdate").repartition(
        spark.sparkContext.defaultParallelism, "o_orderkey")


def stream_scan(spark, sf):
    """Files scanned as they arrive, read back from the sink."""
    out = shared_folder(spark)
    files = build_files(_order_stream(spark, sf, f"{sf}/orders*.parquet").select("o_orderkey", "o_custkey"))
    query = streaming.scan_stream(files, CATALOGUE.list_rules(), f"{out}/sink", f"{out}/checkpoint")
    query.awaitTermination()
    return explode_violations(streaming.scanned(spark, f"{out}/sink")).select(*SHORT)


def stream_latest_report(spark, sf):
    """Several micro-batches that split each scan; the newest report per pull request wins, with all its parts."""
    out = shared_folder(spark)
    (table(spark, sf, "orders").repartition(4, "o_orderkey").write.parquet(f"{out}/drop"))
    orders = _order_stream(spark, sf, f"{out}/drop", files_per_trigger=1)
    dated = build_files(orders.select("o_orderkey", "o_custkey", "o_orderdate"), scanned_at="o_orderdate")

    def per_file(batch: DataFrame) -> DataFrame:
        files, hits = contents.scan_contents(batch, CATALOGUE.list_rules(), languages=CATALOGUE.languages())
        return _counted(files, hits).withColumn("enforcement_action", rollup.enforcement(
            F.lit("blocking"), F.col("total_issues"), F.col("critical"), F.col("high")))
    streaming.report_stream(dated, f"{out}/log", f"{out}/checkpoint", of_batch=per_file).awaitTermination()
    return streaming.latest_reports(spark, f"{out}/log").select(
        "org", "repo", "pr_number", "scanned_at", "files", "total_issues", "critical", "enforcement_action")


def stream_dedup(spark, sf):
    out = shared_folder(spark)
    schema = table(spark, sf, "events").schema
    base, fields = derived.PR_PAYLOADS
    raw = streaming.file_stream(spark, f"{sf}/events*.parquet", schema)
    payloads = raw.select(*[F.expr(sql).alias(name) for name, sql in fields.items()])
    query = (streaming.deduplicated_deliveries(payloads).select("delivery_id")
             .writeStream.format("parquet").outputMode("append").option("path", f"{out}/sink")
             .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(f"{out}/sink")


QUERIES = {
    **{key: _rule(rule_id) for key, rule_id in RULE_KEYS.items()},
    **{key: _pack(name) for key, name in PACK_KEYS.items()},
    **{f.__name__: f for f in (
        src_code_files, src_pr_events, src_push_events, changed_files, pushed_versions, push_rollup, supported_files, rules_applicable,
        config_resolve, rules_selected, scan_pack, path_scope_filter, diff_only_hits, config_overlay, settings_resolve, settings_update,
        scan_with_settings, list_rules,
        pack_listing, regex_finditer, line_numbers, snippets, context_window, comment_skip, brace_body,
        std_003_async, secrets_in_documents, naming_fix, scan_security, scan_standards, custom_regex_rules, custom_rule_errors,
        license_detect, license_name, license_status, license_report, license_recommendations, ip_markers,
        code_similarity, code_similarity_jaccard, violations_by_repo, cascade_delete, override_events,
        config_upsert, rule_upsert, register_rules, catalogue_as_of, pack_enable, audit_query, audit_page, audit_resolve, audit_from_scan, export_audit_csv,
        export_audit_json, dedup_rule, dedup_location, severity_summary, enforcement, owasp_coverage,
        standards_compliance, pr_rollup, commit_status, report_totals, quality_score, report_tiers,
        severity_sorted, report_markdown, ai_parse, ai_violations, ai_recommendations,
        ai_authorship, combine_hits, sink_scan_results, audit_append, stream_scan,
        stream_latest_report, stream_dedup)},
    "detect_language": detect_languages,
}
