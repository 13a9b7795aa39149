"""Text queries with SQL give the same rows on both engines, also on awkward tables."""

import pytest

from compare import compare, duck
from scanfold.llm.queries import ORACLES, QUERIES

ROWS = {
    "empty": [],
    "odd": [(1, None, "en", None), (2, "", None, "a"), (3, "\n\n", "en", "a"), (4, "one two", "en", "a"),
            (5, "A\nB\nC\nD\nE\nA\nB\nC\nZ", "en", "b"), (6, "q\n B \n\nC\nD\nx", "de", "b"),
            (7, "a b c a b c a b c " * 40, "fr", "b"), (8, "long " * 30000, "fr", None),
            (9, "Released under the MIT  license\n\nthe end", "en", "c"), (10, "x | y # z\n" * 60, "es", "c"),
            (11, "é𝒳 ü\x1f\x0bß " * 30, "de", "c"), (12, "A\nB\nC", "en", "c"), (13, "A\nB\nC", "en", "c")],
}


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_given_tables(spark, sf_dir, key):
    ok, text = compare(spark, duck(sf_dir), key, sf_dir, QUERIES, ORACLES)
    assert ok, text


@pytest.mark.parametrize("name", sorted(ROWS))
@pytest.mark.parametrize("key", sorted(ORACLES))
def test_odd_tables(spark, tmp_path, key, name):
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(ROWS[name], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(path)
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    ok, text = compare(spark, con, key, str(tmp_path), QUERIES, ORACLES)
    assert ok, text
