"""A pull request's roll-up has the violations of its files, all of them."""

import json

import duckdb

from compare import rows_of
from scanfold.operators import rollup
from scanfold.operators.scan import explode_violations, find_violations
from scanfold.oracle.queries_sql import CORE, ORACLES
from scanfold.plans.queries import CATALOGUE, QUERIES, ROLLED_FIELDS
from scanfold.sources.corpus import code_files

KEYS = ("org", "repo", "pr_number")
FILES = ("repo string, pr int, file_path string, total_issues long, critical long, high long, medium long, low long, info long, "
         "enforcement_action string, violations array<struct<line_start:int,line_end:int,rule_id:string>>")
ROWS = [("r", 1, "b.py", 2, 1, 1, 0, 0, 0, "block", [(7, 7, "S1"), (9, 9, "S2")]), ("r", 1, "a.py", 1, 0, 0, 1, 0, 0, "annotate", [(8, 9, "S3")]),
        ("r", 1, "a.py", 1, 0, 0, 1, 0, 0, "annotate", [(8, 9, "S3")]), ("r", 1, "c.py", 0, 0, 0, 0, 0, 0, "none", []),
        ("r", 2, "d.py", 0, 0, 0, 0, 0, 0, "none", []), (None, 2, None, 1, 0, 0, 0, 1, 0, "annotate", [(3, 3, "S4")])]
WANT = {("r", 1): [("a.py", 8, 9, "S3"), ("a.py", 8, 9, "S3"), ("b.py", 7, 7, "S1"), ("b.py", 9, 9, "S2")], ("r", 2): [], (None, 2): [(None, 3, 3, "S4")]}


def _listed(rolled):
    return {(r["repo"], r["pr"]): [tuple(v) for v in r["violations"]] for r in rolled.collect()}


def test_violations_of_a_pull_request_are_concatenated_by_path_and_place(spark):
    files = spark.createDataFrame(ROWS, FILES)
    whole = rollup.roll_up(files, "repo", "pr")
    assert _listed(whole) == WANT
    bare = rollup.roll_up(files.drop("violations"), "repo", "pr")
    assert sorted(map(str, bare.collect())) == sorted(map(str, whole.drop("violations").collect()))


def test_violations_of_parts_add_up(spark):
    files = spark.createDataFrame(ROWS, FILES)
    parts = rollup.roll_up(files.where("high > 0"), "repo", "pr").union(rollup.roll_up(files.where("high = 0"), "repo", "pr"))
    assert _listed(rollup.add_up(parts, "repo", "pr")) == WANT


def test_pr_rollup_lists_every_violation_of_its_files(spark, tmp_path):
    sf, con = str(tmp_path), duckdb.connect()
    for name, rows in {"orders": "SELECT i AS o_orderkey, i % 7 AS o_custkey FROM range(60) t(i) UNION ALL SELECT 60 + i, NULL FROM range(6) t(i)",
                       "customer": "SELECT i AS c_custkey FROM range(5) t(i)", "nation": "SELECT i AS n_nationkey FROM range(4) t(i)"}.items():
        con.execute(f"COPY ({rows}) TO '{sf}/{name}.parquet'")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    rolled = QUERIES["pr_rollup"](spark, sf)
    rows = rolled.collect()
    got = {tuple(r[k] for k in KEYS): json.loads(r["violations"]) for r in rows}

    want = {k: [] for k in got}
    scanned = find_violations(code_files(spark, sf), CORE, languages=CATALOGUE.languages(), dedupe="location")
    for v in explode_violations(scanned).orderBy("file_path", "line_start", "line_end").collect():
        want[tuple(v[k] for k in KEYS)].append({c: v[c] for c in ("file_path", *ROLLED_FIELDS)})
    assert got == want and sum(map(len, got.values())) > 60
    assert all(len(got[tuple(r[k] for k in KEYS)]) == r["total_issues"] for r in rows) and (None, None, 1) in got

    known = [tuple(r) for r in rows if r["org"] is not None]    # the SQL has no row for files without a repository
    cur = con.execute(ORACLES["pr_rollup"])
    assert rows_of([d[0] for d in cur.description], cur.fetchall()) == rows_of(rolled.columns, known)
