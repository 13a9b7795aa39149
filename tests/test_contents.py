"""Equal contents are scanned once, with the hits that a scan of every file gives."""

from pyspark.sql import functions as F

from scanfold.catalog import Catalogue
from scanfold.operators import contents, rules_store, scope
from scanfold.operators.scan import find_violations
from scanfold.sources import sinks
from test_plans import plan
from test_scope import FILES, RULES, _rule

CATALOGUE = Catalogue.builtin()
NOISY = 'console.log("a");\nconst q = "SELECT * FROM t WHERE id = " + id;\n'
ROWS = [(1, "o", "r", "src/a.js", "javascript", NOISY), (2, "p", "s", "src/b.js", "JavaScript", NOISY), (3, "o", "r", "src/a.test.js", "javascript", NOISY),
        (4, "o", "r", None, "javascript", NOISY), (5, "o", "r", "src/a.py", "python", NOISY), (6, "o", None, "src/a.js", None, NOISY),
        (7, "o", "r", "src/a.js", "javascript", None), (8, "o", "r", "src/a.js", "javascript", ""), (1, "o", "r", "src/a.js", "javascript", NOISY)]


def _files(spark):
    return spark.createDataFrame(ROWS, FILES)


def _hits(scanned):
    return sorted(str(r.asDict(True)) for r in scanned.collect())


def test_hits_are_those_of_a_scan_of_every_file(spark):
    for dedupe in ("rule", "location", "none"):
        found = contents.find_once(_files(spark), CATALOGUE.list_rules(), languages=CATALOGUE.languages(), dedupe=dedupe)
        want = find_violations(_files(spark), CATALOGUE.list_rules(), languages=CATALOGUE.languages(), dedupe=dedupe)
        assert _hits(found) == _hits(want) and found.columns == want.columns


def test_a_content_is_scanned_once_for_each_language_and_exemption(spark):
    files, texts = contents.texts_of(_files(spark), CATALOGUE.list_rules())
    assert texts.count() == files.select("unit").distinct().count() == 6    # files 1 and 2, and 3 and 4, are alike; one comes twice
    assert "code" not in files.columns and files.count() == len(ROWS)
    many = spark.range(20_000).select(F.col("id").alias("file_id"), F.lit("a.py").alias("file_path"), F.lit("python").alias("language"), F.lit("x").alias("code"))
    assert contents.scan_contents(many, CATALOGUE.list_rules(), languages=CATALOGUE.languages())[1].count() == 1


def test_any_number_of_settings_is_one_pass_over_the_files(spark):
    settings = spark.range(500).select(F.lit("o").alias("org"), F.concat(F.lit("r"), "id").alias("repo"), F.col("id").alias("s"))
    files = settings.select("org", "repo", F.col("s").alias("file_id"))
    (met,) = scope.with_settings(files, settings, ["org", "repo"], F.lit(100), 1_000)      # 50 parts, and as many passes, before
    assert sorted((r["file_id"], r["s"]) for r in met.collect()) == [(i, i) for i in range(500)]


def test_any_number_of_custom_rules_is_one_pass_for_each_kind_of_scope(spark):
    rules = spark.createDataFrame([_rule(i, f"w{i}\\b", "o", f"r{i}") for i in range(60)], RULES)
    files = spark.createDataFrame([(i, "o", f"r{i}", "a.py", "python", f"w{i}\nw{i + 1}\n") for i in range(60)], FILES)
    df = rules_store.scan_custom(files, rules, 2_000)
    assert plan(df).count("Scan ExistingRDD") <= 2 * 3                                      # named in the tree and below it
    assert sorted((r["file_id"], r["rule_id"], r["line_start"]) for r in df.collect()) == [(i, f"R{i}", 1) for i in range(60)]


def test_results_and_violations_stored_by_content_are_those_stored_by_file(spark, tmp_path):
    from scanfold.operators import rollup
    extra = {"pr_number": F.lit(1), "commit_sha": F.lit("c"), "enforcement_action": F.lit("none")}
    files, hits = contents.scan_contents(_files(spark), CATALOGUE.list_rules(), languages=CATALOGUE.languages())
    by_content = contents.meet(files, rollup.summarize(hits).drop("violations"), ["unit"]).withColumns(extra)
    by_file = rollup.summarize(find_violations(_files(spark), CATALOGUE.list_rules(), languages=CATALOGUE.languages())).withColumns(extra)
    now = F.expr("TIMESTAMP_NTZ '2024-06-01 12:00:00'")
    assert sinks.store_scans(by_content, f"{tmp_path}/a", "run", now, hits) and sinks.store_scans(by_file, f"{tmp_path}/b", "run", now)
    for name in ("scan_results", "violations"):
        a, b = (sinks.committed(spark, f"{tmp_path}/{x}", name) for x in "ab")
        assert _hits(a) == _hits(b.select(*a.columns)) and a.count()
