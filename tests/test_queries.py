"""Registered queries against their SQL.  SCANFOLD_ALL=1 runs every one."""

import os

import pytest

import __spark_entry__ as entry_module
from compare import compare, duck
from scanfold.oracle.queries_sql import ORACLES
from scanfold.plans.queries import QUERIES

SAMPLE = ("dedup_location", "scan_pack", "std_003_async", "fed_003", "src_code_files", "src_push_events", "changed_files",
          "detect_language", "rules_applicable", "config_resolve", "path_scope_filter", "diff_only_hits",
          "config_overlay", "pack_listing", "regex_finditer", "context_window", "brace_body", "naming_fix",
          "custom_regex_rules", "license_status", "license_recommendations", "ip_markers", "code_similarity",
          "violations_by_repo", "override_events", "config_upsert", "rule_upsert", "audit_query", "export_audit_csv",
          "export_audit_json", "dedup_rule", "commit_status", "report_totals", "quality_score", "report_tiers",
          "ai_violations", "ai_authorship", "report_markdown", "combine_hits", "sink_scan_results", "stream_scan", "stream_latest_report", "stream_dedup",
          "pushed_versions", "push_rollup", "custom_rule_errors", "settings_resolve", "settings_update", "scan_with_settings",
          "register_rules", "catalogue_as_of", "pack_enable", "audit_append", "audit_page")
KEYS = list(QUERIES) if os.environ.get("SCANFOLD_ALL") else list(SAMPLE)


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("key", KEYS)
def test_query(spark, con, sf_dir, key):
    ok, text = compare(spark, con, key, sf_dir, entry_module.queries(), entry_module.oracle_sql())
    assert ok, text


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    rows = entry_module.entry(spark)
    assert rows.columns[0] == "file_id" and rows.count() == 1500
