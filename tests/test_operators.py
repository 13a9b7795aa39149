import datetime as dt

import pytest
from pyspark.sql import functions as F

from scanfold.catalog import Catalogue
from scanfold.functions.paths import detect_language, is_supported, matches_any_glob
from scanfold.operators import ai, audit, config, dedup, events, license, report, rollup, rules_store, similarity


@pytest.mark.parametrize("mode,critical,high,medium,expect", [
    ("advisory", 1, 0, 4, "none"), ("warning", 1, 0, 4, "annotate"), ("warning", 0, 0, 0, "none"),
    ("blocking", 1, 0, 4, "block"), ("blocking", 0, 1, 4, "block"), ("blocking", 0, 0, 5, "annotate"),
    ("blocking", 0, 0, 0, "none"), ("strange", 3, 3, 3, "none")])
def test_enforcement_table(spark, mode, critical, high, medium, expect):
    row = spark.range(1).select(rollup.enforcement(
        F.lit(mode), F.lit(critical + high + medium), F.lit(critical), F.lit(high)).alias("a")).first()
    assert row["a"] == expect


def test_summary_counts_unknown_severity_as_info(spark):
    rows = [(1, [("critical",), ("high",), ("medium",), ("low",), ("odd",), (None,)]), (2, [])]
    df = spark.createDataFrame(rows, "file_id int, violations array<struct<severity:string>>")
    got = {r["file_id"]: (r["total_issues"], r["critical"], r["high"], r["medium"], r["low"], r["info"], r["status"])
           for r in rollup.summarize(df).collect()}
    assert got == {1: (6, 1, 1, 1, 1, 2, "violations_found"), 2: (0, 0, 0, 0, 0, 0, "clean")}


def test_languages_and_supported_extensions(spark):
    rows = [("a/b.TSX", "typescript", False), ("Makefile", "makefile", False), ("x.kt", "kotlin", True),
            ("x.unknown", "unknown", False), ("a.b/c", "b/c", False), ("q.py", "python", True)]
    df = spark.createDataFrame(rows, "p string, lang string, sup boolean")
    for r in df.select("*", detect_language(F.col("p")).alias("l"), is_supported(F.col("p")).alias("s")).collect():
        assert (r["l"], r["s"]) == (r["lang"], r["sup"]), r["p"]


def test_globs(spark):
    cases = [("src/a.py", "src/**/*", True), ("src/x/y/a.py", "src/**/*", True), ("lib/a.py", "src/**/*", False),
             ("node_modules/p/i.js", "node_modules/**", True), ("dist/app.min.js", "*.min.js", True),
             ("src/a.js", "src/?.js", True), ("src/ab.js", "src/?.js", False), ("a+b.py", "a+b.py", True)]
    df = spark.createDataFrame(cases, "p string, g string, want boolean")
    for r in df.select("*", matches_any_glob(F.col("p"), F.array("g")).alias("got")).collect():
        assert r["got"] == r["want"], r


def test_exclude_wins(spark):
    df = spark.createDataFrame([("src/a.min.js",), ("src/a.js",), ("x/a.js",)], "p string")
    scope = config.in_scope(F.col("p"), config.strings(["src/**/*"]), config.strings(["*.min.js"]))
    assert [r[0] for r in df.select(scope).collect()] == [False, True, False]


def test_added_lines_of_a_diff(spark):
    patch = "\n".join(["@@ -1,3 +1,4 @@", " a", "+b", "-c", "+d", " e", "\\ No newline at end of file",
                       "@@ -20,2 +30,3 @@ def f():", "+x", " y", "+z"])
    df = spark.createDataFrame([(patch,), (None,), ("",)], "p string")
    got = [r[0] for r in df.select(events.added_lines(F.col("p"))).collect()]
    assert got == [[2, 3, 30, 32], None, []]


def test_config_resolution_levels(spark):
    configs = spark.createDataFrame([
        ("o1", "r1", "blocking", ["telecom"], None, True), ("o1", None, "advisory", [], ["x/**"], False)],
        "org string, repo string, enforcement_mode string, enabled_rule_packs array<string>, "
        "exclude_patterns array<string>, override_allowed boolean")
    repos = spark.createDataFrame([("o1", "r1"), ("o1", "r2"), ("o2", "r1")], "org string, repo string")
    got = {(r["org"], r["repo"]): r for r in config.resolve(repos, configs).collect()}
    assert (got["o1", "r1"]["config_level"], got["o1", "r1"]["enabled_rule_packs"]) == ("repo", ["telecom"])
    assert got["o1", "r1"]["exclude_patterns"] == list(config.STORED_EXCLUDE)
    assert got["o1", "r2"]["enforcement_mode"] == "advisory" and got["o1", "r2"]["override_allowed"] is False
    assert got["o1", "r2"]["enabled_rule_packs"] == list(config.DEFAULT_PACKS)
    assert got["o2", "r1"]["config_level"] == "default"
    assert got["o2", "r1"]["exclude_patterns"] == list(config.DEFAULT_EXCLUDE)


def test_enable_pack(spark):
    catalogue = Catalogue.builtin()
    configs = spark.createDataFrame([("o", "r", ["telecom"]), ("o", None, None)],
                                    "org string, repo string, enabled_rule_packs array<string>")
    with pytest.raises(ValueError, match="Unknown rule pack"):
        config.enable_pack(configs, catalogue, "nope", "o")
    got = {r["repo"]: r["enabled_rule_packs"] for r in
           config.enable_pack(configs, catalogue, "government", "o").collect()}
    assert got == {"r": ["telecom"], None: [*config.DEFAULT_PACKS, "government"]}


def test_model_findings_are_normalised(spark):
    raw = '```json\n{"violations":[{"title":"T","severity":"invalid_severity","line_start":4},{"severity":"HIGH"}]}\n```'
    df = spark.createDataFrame([(1, "a.py", "security", raw), (2, "b.py", "standards", "no json")],
                               "file_id int, file_path string, category string, raw string")
    rows = ai.violations(ai.parse(df)).orderBy("rule_id").collect()
    assert [(r["rule_id"], r["severity"], r["title"], r["line_start"], r["line_end"]) for r in rows] == [
        ("AI-SECURITY-001", "medium", "T", 4, 4), ("AI-SECURITY-002", "high", "Unknown Issue", 1, 1)]


def test_first_per_key_keeps_the_first_source(spark):
    df = spark.createDataFrame([("f", 1, "late", 2), ("f", 1, "early", 0), ("g", 1, "only", 5)],
                               "file string, line int, rule string, ord int")
    got = {tuple(r) for r in dedup.first_per_key(df, ["file", "line"], ["ord"]).collect()}
    assert got == {("f", 1, "early", 0), ("g", 1, "only", 5)}


def test_audit_page_limits(spark):
    logs = spark.createDataFrame([(str(i), dt.datetime(2024, 1, 1 + i)) for i in range(9)],
                                 "id string, timestamp timestamp")
    assert [r["id"] for r in audit.page(logs, limit=3, offset=2).collect()] == ["6", "5", "4"]
    assert audit.page(logs, limit=10_001).count() == 9
    with pytest.raises(ValueError):
        audit.page(logs, limit=-1)
    many = spark.range(12_000).selectExpr("cast(id as string) AS id", "timestamp'2024-01-01' AS timestamp")
    assert audit.export_rows(many).count() == 12_000 and audit.export_rows(many, limit=5).count() == 5


def test_license_deep_in_a_file(spark):
    text = "line\n" * 150 + "Licensed under the Apache License, Version 2.0"
    df = spark.createDataFrame([("a.py", text)], "file_path string, code string")
    assert license.detect(df).first()["license_id"] == "Apache-2.0"
    assert license.detect(df, header_lines=100).first()["license_id"] is None


def test_report_parts_add_up(spark):
    rows = [("r", 1, 7, 1, "block"), ("r", 1, 2, 0, "annotate"), ("r", 2, 0, 0, "none")]
    per_file = spark.createDataFrame(rows, "repo string, scan int, total_issues long, critical long, enforcement_action string")
    for c in ("high", "medium", "low", "info"):
        per_file = per_file.withColumn(c, F.lit(0).cast("long"))
    parts = rollup.roll_up(per_file.where("total_issues > 2"), "repo", "scan").union(
        rollup.roll_up(per_file.where("total_issues <= 2"), "repo", "scan"))
    whole = rollup.roll_up(per_file, "repo", "scan")
    assert sorted(rollup.add_up(parts, "repo", "scan").select(whole.columns).collect()) == sorted(whole.collect())


def test_audit_exports_write_files(spark, tmp_path):
    logs = spark.createDataFrame(
        [("a", dt.datetime(2024, 1, 1, 5, 6, 7), "scan", "o", "r", 1, "s", "u", "warning", 2, "pending")],
        ", ".join(f"{c} {'timestamp' if c == 'timestamp' else 'int' if c in ('pr_number', 'violations_count') else 'string'}"
                  for c in audit.EXPORT_COLUMNS))
    audit.write_csv(logs, str(tmp_path / "csv"))
    audit.write_json(logs, str(tmp_path / "json"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["timestamp"] == "2024-01-01T05:06:07"
    assert spark.read.json(str(tmp_path / "json")).count() == 1


def test_bad_custom_patterns_are_reported(spark):
    rules = spark.createDataFrame([("1", "(x", "regex", True), ("2", "ok", "regex", True), ("3", "ok", "ast", True)],
                                  "id string, pattern string, rule_type string, enabled boolean")
    got = {r["id"]: r["error"] for r in rules_store.compiled_rules(rules).collect()}
    assert set(got) == {"1", "2"} and got["1"].startswith("invalid pattern") and got["2"] is None


def test_html_is_escaped(spark):
    got = spark.range(1).select(report.escape_html(F.lit("<a href=\"x\">&'</a>"))).first()[0]
    assert got == "&lt;a href=&quot;x&quot;&gt;&amp;&#39;&lt;/a&gt;"


def test_report_blocks_fold_after_five_medium(spark):
    keys = ("org", "repo", "pr_number")
    summary = spark.createDataFrame([("o", "r", 1, 7, 0, 0, 7, 0, 0, "annotate", True)],
                                    "org string, repo string, pr_number int, total_issues long, critical long, high long, "
                                    "medium long, low long, info long, enforcement_action string, override_allowed boolean")
    rows = [("o", "r", 1, i, f"src/{i}.py", "python", "STD-002", "medium", i + 1, i + 1, "t", "d", "s", None, None,
             None, "print()", f"v{i}") for i in range(7)]
    violations = spark.createDataFrame(
        rows, "org string, repo string, pr_number int, file_id int, file_path string, language string, rule_id string, "
              "severity string, line_start int, line_end int, title string, description string, code_snippet string, "
              "owasp_mapping string, cwe_id string, detail string, label string, violation_id string")
    tagged = report.with_fixes(report.tiers(violations, *keys))
    blocks = report.markdown_blocks(summary, tagged, *keys).orderBy("section", "position").collect()
    text = "\n".join(b["block"] for b in blocks)
    assert text.count("**Rule:** `STD-002`") == 7
    assert text.index("Show 2 more medium issues") > text.index("src/4.py")
    assert text.index("Show 2 more medium issues") < text.index("src/5.py")
    assert "logging.getLogger" in text and "Review medium severity issues" in text


def _sets(text, k=similarity.SHINGLE_WORDS):
    words = [w for w in text.lower().split(" ") if w]
    return {" ".join(words[i:i + k]) for i in range(max(len(words) - k + 1, 1))} if words else set()


@pytest.mark.parametrize("metric,threshold", [("containment", 0.85), ("containment", 0.3), ("jaccard", 0.5)])
def test_similarity_equals_brute_force(spark, metric, threshold):
    import random
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 25))) for _ in range(12)]
    sources = [(i, t) for i, t in enumerate(base + [base[0]] * 8)]          # many copies of one source
    texts = []
    for i in range(60):
        t = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 4)):
            t.insert(rng.randint(0, len(t)), rng.choice("abcdxyz"))
        texts.append((i, " ".join(t) if rng.random() < 0.8 else base[1]))   # and of one file
    got = {(r["file_id"], r["source_id"]) for r in similarity.similar_sources(
        spark.createDataFrame(texts, "file_id int, code string"),
        spark.createDataFrame(sources, "source_id int, text string"), threshold, metric).collect()}
    want = set()
    for i, t in texts:
        for j, s in sources:
            a, b = _sets(t), _sets(s)
            score = len(a & b) / (len(b) if metric == "containment" else len(a | b))
            if round(score, 9) >= threshold:
                want.add((i, j))
    assert got == want and want


def test_source_tree_is_read(spark, tmp_path):
    from scanfold.sources.files import read_tree
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("print('é')\n", encoding="utf-8")
    (tmp_path / "src" / "b.txt").write_text("x")
    (tmp_path / "empty.go").write_text("")
    rows = read_tree(spark, str(tmp_path), "o", "r").collect()
    assert [(r["language"], r["code"]) for r in rows] == [("python", "print('é')\n")]


def test_requests_are_read(spark, tmp_path):
    from scanfold.sources.files import read_requests
    (tmp_path / "r.json").write_text('{"file_id":1,"file_path":"a/b.ts","code":"x"}\n{"file_id":2,"code":""}\n')
    assert [(r["file_id"], r["language"]) for r in read_requests(spark, str(tmp_path)).collect()] == [(1, "typescript")]
