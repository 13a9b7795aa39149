"""The versioned catalogue, pack requests, pages by cursor."""

import random

import pytest
from pyspark.sql import functions as F

from scanfold.catalog import Catalogue, versions
from scanfold.operators import audit, config


def _at(day):
    return F.expr(f"TIMESTAMP_NTZ '2024-01-{day:02d} 00:00:00'")


def _plain(history):
    """(id, text or None, day) in order of time to the versions."""
    out = []
    for key in sorted({h[0] for h in history}):
        days = {}
        for _, text, day in (h for h in history if h[0] == key):
            days.setdefault(day, []).append(text)
        now = None
        for day in sorted(days):
            texts = [t for t in days[day] if t is not None]
            text = max(texts) if texts else None
            if now and text == now[1]:
                continue
            if now:
                out.append((key, now[1], now[0], day))
            now = (day, text) if text is not None else None
        if now:
            out.append((key, now[1], now[0], None))
    return sorted(out, key=repr)


def _rows(table):
    return sorted(((r["id"], r["text"], r["valid_from"].day, r["valid_to"] and r["valid_to"].day) for r in table.collect()), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_versions_against_replay(spark, seed):
    r = random.Random(seed)
    table, history = None, []
    for day in sorted(r.sample(range(1, 28), 5)):
        batch = [(r.choice("abc"), r.choice(["x", "y", None])) for _ in range(4)]
        if table is None:
            batch = [(k, t or "x") for k, t in batch]
        history += [(k, t, day) for k, t in batch]
        kept = versions.changes_of(spark.createDataFrame([b for b in batch if b[1]], "id string, text string"), _at(day))
        gone = versions.removals_of(spark.createDataFrame([(b[0],) for b in batch if not b[1]], "id string"), _at(day))
        changes = kept.unionByName(gone, allowMissingColumns=True)
        for _ in range(2):                           # a batch that comes twice changes nothing
            table = versions.register(table, changes)
        table = spark.createDataFrame(table.collect(), table.schema)
    assert _rows(table) == _plain(history)
    for day in (3, 14, 27):
        want = {k: t for k, t, a, b in _plain(history) if a <= day and (b is None or b > day)}
        assert {x["id"]: x["text"] for x in versions.as_of(table, _at(day)).collect()} == want


def test_pack_requests(spark):
    configs = spark.createDataFrame([("o", "r", ["telecom"], "x"), ("o", None, None, "y"), ("p", "r", [], "z")],
                                    "org string, repo string, enabled_rule_packs array<string>, other string")
    requests = spark.createDataFrame([("o", "r", "government"), ("o", "r", "telecom"), ("o", "r", "government"), ("o", None, "healthcare"),
                                      ("q", "s", "telecom"), ("p", "r", "nope"), ("p", "r", None)], "org string, repo string, pack string")
    enabled, refused = config.enable_packs(configs, requests, Catalogue.builtin())
    defaults = list(config.DEFAULT_PACKS)
    assert {(r["org"], r["repo"]): (r["enabled_rule_packs"], r["other"]) for r in enabled.collect()} == {
        ("o", "r"): (["telecom", "government"], "x"), ("o", None): ([*defaults, "healthcare"], "y"), ("p", "r"): ([], "z"),
        ("q", "s"): ([*defaults, "telecom"], None)}
    assert sorted((r["pack"] or "") for r in refused.collect()) == ["", "nope"]


def test_pages_by_cursor_give_every_row_once_in_order(spark, tmp_path):
    r = random.Random(1)
    rows = [(f"a{i}", f"2024-01-{r.choice([1, 1, 1, 2, 9, 10]):02d} 0{r.randint(0, 2)}:00:00", r.choice(["scan", "other"])) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, t string, event_type string").select("id", F.col("t").cast("timestamp_ntz").alias("timestamp"), "event_type")
    audit.write_by_day(df, str(tmp_path / "log"))
    logs, cursor, got = spark.read.parquet(str(tmp_path / "log")), None, []
    while True:
        page = audit.page_after(logs, cursor, limit=40, event_type="scan").collect()
        got += [x["id"] for x in page]
        if len(page) < 40:
            break
        cursor = (str(page[-1]["timestamp"]), page[-1]["id"])
    assert got == [i for i, _, _ in sorted(sorted((x for x in rows if x[2] == "scan"), key=lambda x: x[0]), key=lambda x: x[1], reverse=True)]
    assert audit.page_after(logs, ("2023-12-31 00:00:00", "a")).collect() == []


def test_a_page_reads_its_own_days(spark, tmp_path):
    df = spark.range(1_000).select(F.concat(F.lit("a"), "id").alias("id"), F.expr(
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(CAST(id / 50 AS INT))").alias("timestamp"), F.lit("scan").alias("event_type"))
    audit.write_by_day(df, str(tmp_path / "log"))
    logs = spark.read.parquet(str(tmp_path / "log"))
    for cursor in (None, ("2024-01-10 00:00:00", "zz")):
        page = audit.page_after(logs, cursor, limit=60)
        assert page.count() == 60 and len({f.split("day=")[1][:10] for f in page.inputFiles()}) <= 20
        scan = page._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(day" in scan
