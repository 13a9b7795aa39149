"""Settings and custom rules that reach the files in bounded parts."""

import re

import pytest
from pyspark.sql import functions as F

from scanfold.operators import rules_store, scope
from scanfold.sources import derived
from test_plans import plan

RULES = ("id string, name string, description string, category string, severity string, enabled boolean, rule_type string, "
         "languages array<string>, pattern string, owasp_mapping string, cwe_id string, fix_suggestion string, org string, repo string")
FILES = "file_id long, org string, repo string, file_path string, language string, code string"


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _rule(i, pattern, org=None, repo=None):
    return (f"R{i}", f"rule {i}", None, "security", "low", True, "regex", None, pattern, None, None, None, org, repo)


def _exchanged(df) -> list[str]:
    """What the shuffles of a plan take in."""
    text = plan(df)
    return re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: (\[.*?\])\n", text)


def test_parts_hold_each_row_once_within_the_bound(spark):
    rows = spark.range(2_000).select(F.lit("hot").alias("org"), F.col("id").cast("string").alias("repo"), F.lit("x").alias("v"))
    parts = scope.parts_of(rows, F.lit(10), 1_000)
    counts = [p.count() for p in parts]
    assert sum(counts) == 2_000 and max(counts) * 10 <= 1_000 and scope.together(parts).distinct().count() == 2_000
    assert len(scope.parts_of(rows, F.lit(10), 20_000)) == 1
    assert scope.parts_of(rows.limit(0), F.lit(10), 5)[0].count() == 0


def test_settings_meet_each_file_once_also_null_keys(spark):
    files = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (3, "b", "x"), (4, "a", "x")], "file_id int, org string, repo string")
    settings = spark.createDataFrame([("a", "x", 1), ("a", None, 2)], "org string, repo string, s int")
    for most in (1_000, 5):
        got = scope.together(scope.with_settings(files, settings, ["org", "repo"], F.lit(5), most)).collect()
        assert sorted((r["file_id"], r["s"]) for r in got) == [(1, 1), (2, 2), (4, 1)]


def test_custom_rules_give_the_same_hits_in_any_number_of_parts(spark):
    rules = [_rule(0, "x+"), _rule(1, "y", "o"), _rule(2, "z", "o", "r"), _rule(3, "x", "o", "q"), _rule(4, "(", "o"), _rule(5, "y", "p")]
    files = spark.createDataFrame([(1, "o", "r", "a.py", "python", "x\ny\nz"), (2, "p", "r", "a.py", "python", "y"), (3, None, None, "a", "a", "xx z")], FILES)
    table = spark.createDataFrame(rules, RULES)
    want = {(1, "R0", 1), (1, "R1", 2), (1, "R2", 3), (2, "R5", 1), (3, "R0", 1)}
    for most in (None, 900, 1):
        got = rules_store.scan_custom(files, table, most).collect()
        assert {(r["file_id"], r["rule_id"], r["line_start"]) for r in got} == want and len(got) == len(want)


def test_many_rules_of_one_organisation(spark, no_broadcast):
    """25,000 rules of one organisation in bounded parts; no text is shuffled."""
    n = 25_000
    rules = spark.range(n).select(*[F.expr(sql).cast(kind).alias(name) for name, kind, sql in (
        (*c.split(" ", 1), {"id": "concat('R', id)", "name": "concat('rule ', id)", "category": "'security'", "severity": "'low'", "enabled": "true",
                            "rule_type": "'regex'", "pattern": "concat('word', id, 'w')", "org": "'o'"}.get(c.split(" ")[0], "null"))
        for c in RULES.split(", "))])
    files = spark.createDataFrame([(i, "o", "r", "a.py", "python", f"word{i}w word{n - 1 - i}w") for i in range(5)], FILES)
    df = rules_store.scan_custom(files, rules, 4 << 20)
    assert sorted((r["file_id"], r["rule_id"]) for r in df.collect()) == sorted((i, f"R{k}") for i in range(5) for k in (i, n - 1 - i))


def test_no_text_is_shuffled(spark, sf_dir, no_broadcast):
    from scanfold.plans.queries import custom_regex_rules, scan_pack
    for df in (custom_regex_rules(spark, sf_dir), scan_pack(spark, sf_dir)):
        assert _exchanged(df) and not [x for x in _exchanged(df) if re.search(r"\bcode#", x)]
        assert "SortMergeJoin" not in plan(df)


def test_rejected_rules_are_listed(spark, sf_dir):
    errors = rules_store.rule_errors(derived.custom_rules(spark, sf_dir))
    assert errors.count() and {r["pattern"] for r in errors.select("pattern").distinct().collect()} == {"(unclosed"}
