"""Nested settings: presence, nulls, and what they switch."""

import json

import pytest
from pyspark.sql import functions as F

from scanfold.operators import settings


def _merged(spark, *documents):
    df = spark.createDataFrame([documents], ", ".join(f"d{i} string" for i in range(len(documents))))
    row = df.select(settings.merged(*[F.try_parse_json(f"d{i}") for i in range(len(documents))]).alias("s")).first()["s"]
    return row.asDict(recursive=True)


def _with(**changes):
    out = {s: dict(fields) for s, fields in settings.SECTIONS.items()}
    for path, value in changes.items():
        section, name = path.split("__")
        out[section][name] = value
    return out


@pytest.mark.parametrize("documents, changes", [
    ((None,), {}), (("",), {}), (("[1]",), {}), (("{}", "not json"), {}),
    (('{"security":{"block_threshold":"low"}}',), {"security__block_threshold": "low"}),
    (('{"security":{"block_threshold":"low","secrets_enabled":false}}', '{"security":{"block_threshold":null}}'), {"security__secrets_enabled": False}),
    (('{"security":{"block_threshold":"low"}}', '{"security":null}'), {}),
    (('{"security":{"block_threshold":"low"}}', '{"security":{}}'), {"security__block_threshold": "low"}),
    (('{"license":{"allowed":[]}}', '{"license":{"blocked":["X"]}}'), {"license__allowed": [], "license__blocked": ["X"]}),
    (('{"override":{"enabled":{"a":1}},"copilot":7}',), {}),
    (('{"naming":{"functions":{"python":"snake_case"}}}',), {"naming__functions": {"python": "snake_case"}}),
    (('{"license":{"similarity_threshold":1}}',), {"license__similarity_threshold": 1.0})])
def test_merge_by_path(spark, documents, changes):
    assert _merged(spark, *documents) == _with(**changes)


def test_every_field_of_every_section_can_be_set(spark):
    other = {s: {n: (not d) if isinstance(d, bool) else ["q"] if isinstance(d, list) else {"k": "v"} if isinstance(d, dict)
                 else 0.25 if isinstance(d, float) else "low" for n, d in fields.items()} for s, fields in settings.SECTIONS.items()}
    assert _merged(spark, json.dumps(other)) == other
    assert _merged(spark, json.dumps(other), json.dumps({s: None for s in other})) == _with()


def test_organisation_then_repository(spark):
    documents = spark.createDataFrame([("o", None, '{"security":{"block_threshold":"low"},"naming":{"enabled":false}}'),
                                       ("o", "r", '{"naming":{"enabled":true}}')], "org string, repo string, document string")
    repos = spark.createDataFrame([("o", "r"), ("o", "q"), ("p", "r")], "org string, repo string")
    got = {(r["org"], r["repo"]): (r["settings"]["security"]["block_threshold"], r["settings"]["naming"]["enabled"])
           for r in settings.resolve(repos, documents).collect()}
    assert got == {("o", "r"): ("low", True), ("o", "q"): ("low", False), ("p", "r"): ("high", True)}


def test_switches_and_threshold(spark):
    rules = list(settings.SWITCHES.values())
    for (section, name), rule in settings.SWITCHES.items():
        df = spark.createDataFrame([(json.dumps({section: {name: False}}),)], "d string")
        left = df.select(settings.switched(F.array(*map(F.lit, rules)), settings.merged(F.try_parse_json("d")))).first()[0]
        assert set(rules) - set(left) == {rule}
    for threshold, severity, action in [("high", "high", "block"), ("high", "medium", "annotate"), ("critical", "high", "annotate"),
                                        ("medium", "medium", "block"), ("odd", "critical", "annotate"), ("low", None, "none")]:
        df = spark.createDataFrame([(json.dumps({"security": {"block_threshold": threshold}}), [(severity,)] if severity else [])],
                                   "d string, v array<struct<severity:string>>")
        assert df.select(settings.enforcement(F.lit("blocking"), F.col("v"), settings.merged(F.try_parse_json("d")))).first()[0] == action
