"""What the physical plans must look like."""

import io
from contextlib import redirect_stdout

from scanfold.catalog import Catalogue
from scanfold.catalog.frames import distinct_regexes, pattern_records
from scanfold.operators import audit, config, license, rollup
from scanfold.operators.scan import explode_violations, find_violations
from scanfold.sources import derived
from scanfold.sources.corpus import build_files
from scanfold.sources.tables import table

CATALOGUE = Catalogue.builtin()


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def _files(spark, sf_dir):
    return build_files(table(spark, sf_dir, "orders"))


def test_scan_is_one_stage_without_shuffle(spark, sf_dir):
    scanned = find_violations(_files(spark, sf_dir), CATALOGUE.list_rules(), languages=CATALOGUE.languages(),
                              dedupe="location")
    text = plan(explode_violations(scanned))
    assert "ShuffleExchange" not in text and "Exchange hashpartitioning" not in text
    assert "SortMergeJoin" not in text and "CartesianProduct" not in text and "BroadcastNestedLoop" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_scan_expression_is_evaluated_once(spark, sf_dir):
    scanned = find_violations(_files(spark, sf_dir), CATALOGUE.select(["SEC-003"]), languages=CATALOGUE.languages())
    df = explode_violations(scanned)
    text = df._jdf.queryExecution().executedPlan().toString()
    # Each regex occurs once in the whole plan, and the one for patterns that bring their own: no pushed-down duplicate of the scan.
    regexes, _ = distinct_regexes(pattern_records(CATALOGUE.select(["SEC-003"]), CATALOGUE.languages()))
    assert text.count("regexp_replace(code") == len(regexes) + 1


def test_scan_reads_two_columns(spark, sf_dir):
    scanned = find_violations(_files(spark, sf_dir), CATALOGUE.select(["SEC-003"]), languages=CATALOGUE.languages())
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan(scanned)


def test_rollup_combines_before_its_only_shuffle(spark, sf_dir):
    scanned = rollup.summarize(find_violations(_files(spark, sf_dir), CATALOGUE.select(["SEC-003"]),
                                               languages=CATALOGUE.languages())).drop("violations")
    acted = config.resolve(scanned, derived.configurations(spark, sf_dir)).withColumn(
        "enforcement_action", rollup.enforcement(*[rollup.F.col(c) for c in
                                                   ("enforcement_mode", "total_issues", "critical", "high")]))
    text = plan(rollup.roll_up(acted, "org", "repo", "pr_number"))
    assert text.count("Exchange hashpartitioning") + text.count("\nArguments: hashpartitioning") == 1
    assert text.count("HashAggregate") >= 2


def test_audit_predicates_reach_the_scan_and_top_k_is_used(spark, sf_dir):
    logs = derived.frame(spark, sf_dir, derived.AUDIT_LOGS)
    bound = rollup.F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'")
    text = plan(audit.query(logs, limit=50, end=bound))
    assert "LessThanOrEqual(ts" in text
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_bounded_ranks_are_cut_before_the_shuffle(spark, sf_dir):
    judged = spark.createDataFrame([], "org string, file_id long, file_path string, license_id string, license_status string")
    assert "WindowGroupLimit" in plan(license.recommendations(judged, "org", shown=3))
    assert "Window" not in plan(license.recommendations(judged, "org"))
