"""File versions as pushes see them, and the diff filter."""

import random
import time

import pytest
from pyspark.sql import functions as F

from scanfold.catalog import Catalogue
from scanfold.operators import events, pushes
from scanfold.operators.asof import as_of


@pytest.mark.parametrize("seed", range(4))
def test_as_of_against_search(spark, seed):
    """A hot key over many partitions, ties, keys on one side only, null keys."""
    r = random.Random(seed)
    keys = ["hot"] * 8 + ["a", "b", None]
    versions = [(r.choice(keys), r.randint(0, 200), i) for i in range(150)]
    rows = [(r.choice([*keys, "z"]), r.randint(-5, 205), f"x{i % 40}") for i in range(300)]
    got = as_of(spark.createDataFrame(rows, "k string, at long, name string"),
                spark.createDataFrame(versions, "k string, at long, v int"), ["k"], "at").collect()

    def newest(k, at):
        old = [(p, v) for key, p, v in versions if key == k and k is not None and p <= at]
        return max(old)[1] if old else None
    assert sorted(((x["k"], x["at"], x["name"], x["version"] and x["version"]["v"]) for x in got), key=repr) == sorted(
        ((k, at, name, newest(k, at)) for k, at, name in rows), key=repr)


def test_as_of_of_nothing(spark):
    rows = spark.createDataFrame([("a", 1, "x")], "k string, at long, name string")
    versions = spark.createDataFrame([], "k string, at long, v int")
    assert [r["version"] for r in as_of(rows, versions, ["k"], "at").collect()] == [None]
    assert as_of(rows.limit(0), versions, ["k"], "at").collect() == []


def _push(spark, *pushed):
    """(event_id, repo, paths) as typed pushes."""
    rows = [(i, "main", "o", repo, f"sha{i}", "me", [([p], [], []) for p in paths]) for i, repo, paths in pushed]
    return spark.createDataFrame(rows, "event_id long, branch string, org string, repo string, commit_sha string, author string, "
                                 "commits array<struct<added:array<string>,modified:array<string>,removed:array<string>>>")


CONFIGS = "org string, repo string, enforcement_mode string, enabled_rule_packs array<string>, custom_rules array<string>"


def test_each_push_sees_its_own_versions_and_a_content_is_scanned_once(spark, monkeypatch):
    bad, good = 'API_KEY = "sk_live_realkey123456789"\n', "x = 1\n"
    versions = spark.createDataFrame(
        [(1, "o", "r", "a.py", 1, bad, False), (2, "o", "r", "b.py", 2, bad, True), (3, "o", "r", "a.py", 5, good, False),
         (4, "o", "r", "b.py", 7, None, False), (5, "o", "q", "a.py", 1, bad, False)],
        "version_id long, org string, repo string, file_path string, position long, code string, detected_ai_code boolean")
    log = _push(spark, (1, "r", ["a.py"]), (3, "r", ["a.py", "b.py"]), (6, "r", ["a.py"]), (8, "r", ["b.py"]), (9, "r", ["new.py"]),
                (10, "r", ["notes.txt"]), (11, "q", ["a.py"]))
    configs = spark.createDataFrame([("o", "r", "blocking", ["default-security"], []), ("o", None, "warning", ["default-security"], [])], CONFIGS)
    seen, real = [], pushes.find_violations

    def counting(files, *args, **more):
        seen.append(files.count())
        return real(files, *args, **more)
    monkeypatch.setattr(pushes, "find_violations", counting)
    scanned = pushes.scan_pushes(log, versions, configs, Catalogue.builtin())
    got = {r["event_id"]: (r["files"], r["total_issues"], r["status"], r["detected_ai_code"], r["enforcement_action"])
           for r in pushes.push_roll_up(log, scanned, configs).collect()}
    assert got == {
        1: (1, 1, "violations_found", False, "block"), 3: (2, 2, "violations_found", True, "block"),
        6: (1, 0, "clean", False, "none"), 8: (0, 0, "clean", False, "none"), 9: (0, 0, "clean", False, "none"),
        11: (1, 1, "violations_found", False, "annotate")}
    assert seen == [2]                               # two contents, five files of pushes


@pytest.mark.parametrize("seed", range(5))
def test_touching_against_search(spark, seed):
    r = random.Random(seed)
    rows = []
    for _ in range(20):
        spans = sorted((a, a + r.choice([0, 0, 1, 4])) for a in (r.randint(1, 30) for _ in range(r.randint(0, 12))))
        rows.append((spans, sorted(r.sample(range(1, 40), r.randint(0, 10)))))
    df = spark.createDataFrame(rows, "spans array<struct<line_start:int,line_end:int>>, lines array<int>")
    for x in df.select("*", events.touching(F.col("spans"), F.col("lines")).alias("got")).collect():
        assert x["got"] == [any(a <= n <= b for n in x["lines"]) for a, b in x["spans"]]


def test_diff_filter_takes_many_hits_and_lines(spark):
    """50,000 hits against 50,000 added lines in one file."""
    n = 50_000
    df = spark.range(1).select(
        F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct((2 * i).alias("line_start"), (2 * i + i % 2).alias("line_end"))).alias("violations"),
        F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: 2 * i + 1).alias("added"))
    start = time.time()
    left = events.on_added_lines(df).select(F.size("violations")).first()[0]
    assert left == n // 2 and time.time() - start < 30


def test_no_patch_keeps_nothing(spark):
    df = spark.createDataFrame([([(1, 1)], None), ([], [1])], "violations array<struct<line_start:int,line_end:int>>, added array<int>")
    assert [r["violations"] for r in events.on_added_lines(df).collect()] == [[], []]
