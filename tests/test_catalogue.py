import pytest
from pyspark.sql import functions as F

from scanfold.catalog.frames import literal_index
from scanfold.functions import kernel
from scanfold.catalog import Catalogue, Rule, pats
from scanfold.catalog import frames
from scanfold.functions.dialect import pattern_error
from scanfold.operators.scan import scan
from test_scan_model import FILE_SCHEMA

CATALOGUE = Catalogue.builtin()


def test_builtin_rules_and_packs():
    assert len(CATALOGUE.rules) == 16
    assert {p: len(r) for p, r in CATALOGUE.list_packs().items()} == {
        "default-security": 5, "enterprise-standards": 3, "healthcare": 3, "telecom": 2, "government": 3}
    assert all(r.category == "security" for r in CATALOGUE.pack_rules("default-security"))
    assert CATALOGUE.get_rule("NOPE") is None and CATALOGUE.pack_rules("nope") == []


def test_pattern_counts_per_rule():
    count = lambda i: sum(len(p) for p in CATALOGUE.rules[i].patterns.values())
    assert {i: count(i) for i in ("SEC-003", "SEC-004", "SEC-005", "STD-001", "FED-001", "FED-002", "FED-003")} == {
        "SEC-003": 37, "SEC-004": 34, "SEC-005": 39, "STD-001": 15, "FED-001": 16, "FED-002": 13, "FED-003": 10}


def test_selection_order_and_precedence():
    ids = lambda **k: [r.rule_id for r in CATALOGUE.select(**k)]
    assert ids(rule_ids=["STD-002", "SEC-001", "NOPE"], packs=["telecom"]) == ["STD-002", "SEC-001"]
    assert ids(packs=["telecom", "nope", "telecom"]) == ["TEL-001", "TEL-002"]
    assert len(ids()) == 16
    assert ids(category="standards") == ["STD-001", "STD-002", "STD-003"]


def test_registered_rule_runs_and_can_be_removed(spark):
    rule = Rule("TEAM-1", "Todo", "d", "low", "standards", ("python",), "Todo found", "A {label}.",
                {"python": pats((r"TODO\b", "todo mark"))})
    catalogue = CATALOGUE.register_rule(rule).register_pack("team", ["TEAM-1", "SEC-001"])
    files = spark.createDataFrame([(1, "o", "r", "a.py", "python", "x\n# TODO later\n")], FILE_SCHEMA)
    rows = scan(files, catalogue, packs=["team"]).select("rule_id", "line_start", "description").collect()
    assert [tuple(r) for r in rows] == [("TEAM-1", 2, "A todo mark.")]
    assert scan(files, catalogue.unregister_rule("TEAM-1"), packs=["team"]).count() == 0


def test_catalogue_size_is_checked_before_broadcast(spark, monkeypatch):
    monkeypatch.setattr(frames, "MAX_BROADCAST_PATTERNS", 3)
    with pytest.raises(ValueError, match="broadcast bound"):
        frames.language_patterns(spark, CATALOGUE.list_rules(), CATALOGUE.languages())


def test_pattern_errors():
    assert pattern_error("(") and pattern_error("") and pattern_error(None)
    assert pattern_error("a+") is None


def test_literal_index_opens_what_gates_open():
    index = dict(literal_index([{"gate": ["a", "b", "a"]}, {"gate": []}, {"gate": ["b"]}]))
    assert index == {"a": [0], "b": [0, 2], "": [1]}


def test_short_form_of_spans_agrees(spark):
    text = "x\n" + "".join(f"<a{i}\n{'y' * (i % 2)}>" + "\n" * (i % 3) for i in range(12))
    marks = F.struct(F.lit("<").alias("open"), F.lit(">").alias("close"))
    row = spark.createDataFrame([(text,)], "t string").select(
        kernel.match_spans(F.col("t"), marks).alias("a"), kernel.few_spans(F.col("t"), marks, F.lit(12)).alias("b")).first()
    assert row["a"] == row["b"] and len(row["a"]) == 12


@pytest.mark.parametrize("regex", ["a'b", r"\d+\\x", '"q"', r"it\'s", "%_$"])
def test_regex_as_sql_text(spark, regex):
    assert spark.sql(f"SELECT {kernel.sql_text(regex)}").first()[0] == regex
