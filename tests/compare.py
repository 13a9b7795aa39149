"""Run queries on Spark and their SQL on DuckDB over the same tables and compare the rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def spark_session(app: str = "scanfold-tests"):
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").appName(app)
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(value):
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def _kinds(dtypes):
    names = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
             "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP"}
    return [names.get(t, t) for _, t in sorted(dtypes)]


def _duck_kinds(description):
    return [str(d[1]).upper() for d in sorted(description, key=lambda d: d[0])]


def compare(spark, con, key: str, sf_dir: str, queries, oracles):
    """(ok, message) for one key."""
    start = time.time()
    df = queries[key](spark, sf_dir)
    got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - start
    if key not in oracles:
        return True, f"rows only: {len(got)} in {spent:.1f}s"
    start = time.time()
    cur = con.execute(oracles[key])
    names = [d[0] for d in cur.description]
    want_columns, want = rows_of(names, cur.fetchall())
    text = f"{len(got)} rows, spark {spent:.1f}s, sql {time.time() - start:.1f}s"
    if got_columns != want_columns:
        return False, f"columns differ: {got_columns} / {want_columns}"
    loose = {c for c, t, w in zip(got_columns, _kinds(df.dtypes), _duck_kinds(cur.description)) if t != w}
    if loose:
        text += f" (types differ: {sorted(loose)})"
    if got != want:
        extra, missing = sorted(set(got) - set(want))[:2], sorted(set(want) - set(got))[:2]
        return False, f"{text}; expected {len(want)}\n   only spark: {extra}\n   only sql:   {missing}"
    return True, text


def main(argv):
    import __spark_entry__ as e
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.001"
    keys = argv[2].split(",") if len(argv) > 2 else list(e.queries())
    spark, con = spark_session(), duck(sf_dir)
    bad = []
    for key in keys:
        try:
            ok, text = compare(spark, con, key, sf_dir, e.queries(), e.oracle_sql())
        except Exception as exc:                                  # report and go on
            ok, text = False, f"{type(exc).__name__}: {str(exc)[:700]}"
        print(("ok   " if ok else "FAIL ") + key + ": " + text[:1500], flush=True)
        if not ok:
            bad.append(key)
    print(f"{len(keys) - len(bad)} of {len(keys)} ok; failing: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv))
