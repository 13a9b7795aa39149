"""What host verdicts do, and odd tables."""

from pyspark.sql import functions as F

from scanfold.llm import quality_rules as Q
from scanfold.sources.tables import staged

CLEAN = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))
LOUD = CLEAN + " #" * 12                         # fails the rule on symbols only
SHORT = "too short"
SCHEMA = "doc_id long, text string, source string"


def _docs(spark):
    """A host with many loud documents, one with few of many, a small one with one."""
    rows = [(i, LOUD if i % 5 == 0 else CLEAN, "bad") for i in range(100)]
    rows += [(1000 + i, LOUD if i == 0 else CLEAN, "good") for i in range(400)]
    rows += [(2000, LOUD, "tiny"), (2001, CLEAN, "tiny"), (2002, SHORT, "good"), (2003, None, None), (2004, "", "bad")]
    return spark.createDataFrame(rows, SCHEMA)


def test_documents_go_at_hosts_that_fail_often_and_clean_ones_never(spark):
    got = {r["doc_id"]: r for r in Q.judge(_docs(spark)).collect()}
    gone = {d for d, r in got.items() if not r["kept"]}
    assert {d for d in gone if d < 1000} == {*range(0, 100, 5)}
    assert got[1000]["fails"]["symbols"] and got[1000]["kept"]
    assert gone >= {2002, 2003, 2004} and 2001 not in gone
    assert not [d for d, r in got.items() if not r["kept"] and not r["base_failed"] and not any(r["fails"])]


def test_the_filter_keeps_what_the_verdicts_keep(spark):
    docs = _docs(spark).withColumns({"host": F.lit("x"), "m": F.lit(1), "strict": F.lit(2), "host_key": F.lit(3), "fails_key": F.lit(4)})
    kept = Q.keep_good(docs).collect()
    assert {r["doc_id"] for r in kept} == {r["doc_id"] for r in Q.judge(_docs(spark)).collect() if r["kept"]}
    assert {(r["host"], r["m"], r["strict"], r["host_key"], r["fails_key"]) for r in kept} == {("x", 1, 2, 3, 4)}
    assert kept[0].__fields__ == docs.columns and all(r["text"] in (CLEAN, LOUD) for r in kept)


def test_verdicts_act_on_the_given_tables(spark):
    """Some documents go by their host's verdict; most are labelled bad."""
    path = "/root/testdata/sf0.01"
    rows = Q.judge(spark.read.parquet(f"{path}/documents.parquet"))
    by_host = staged(rows.where("NOT kept AND NOT base_failed")).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id", "left")
    got = {r["quality"]: r["n"] for r in by_host.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    assert got.get(0, 0) > 0 and got.get(1, 0) * 5 < got.get(0, 0)


def test_repeated_rows_and_very_long_text(spark):
    rows = [(1, CLEAN, "a"), (1, CLEAN, "a"), (1, CLEAN + " tail", "a"), (2, "word and more " * 60_000, "a")]
    got = Q.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"], r["kept"]) for r in got) == [(1, True), (1, True), (1, True), (2, False)]
    assert Q.keep_good(spark.createDataFrame([], SCHEMA)).collect() == []
