"""Tables that are committed together."""

import pytest
from pyspark.sql import functions as F

from scanfold.operators import audit
from scanfold.operators.scan import explode_violations
from scanfold.sources import sinks


def _frame(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v int")


def _read(spark, path, name="t"):
    return sorted(r["v"] for r in sinks.committed(spark, path, name).collect())


def test_a_run_counts_once_and_as_a_whole(spark, tmp_path):
    path = str(tmp_path)
    assert sinks.commit({"t": _frame(spark, 1, 2), "u": _frame(spark, 9)}, path, "a")
    assert not sinks.commit({"t": _frame(spark, 1, 2), "u": _frame(spark, 9)}, path, "a")
    assert sinks.commit({"t": _frame(spark, 3), "u": _frame(spark)}, path, "b")
    assert _read(spark, path) == [1, 2, 3] and _read(spark, path, "u") == [9]


def test_what_a_dead_writer_left_is_not_seen_and_does_not_hinder(spark, tmp_path):
    path = str(tmp_path)
    sinks.commit({"t": _frame(spark, 1)}, path, "a")

    bad = _frame(spark, 5).withColumn("v", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        sinks.commit({"t": _frame(spark, 2), "u": bad}, path, "b")
    assert _read(spark, path) == [1]
    assert sinks.commit({"t": _frame(spark, 2), "u": _frame(spark, 5)}, path, "b")
    assert _read(spark, path) == [1, 2]


def test_of_two_writers_of_a_run_all_readers_take_the_same(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    monkeypatch.setattr(sinks, "_exists", lambda *_: False)          # both looked before either was done
    for value in (1, 2):
        assert sinks.commit({"t": _frame(spark, value)}, path, "a")
    assert len(_read(spark, path)) == 1


def test_ids_tell_scans_of_one_file_apart(spark):
    scans = spark.createDataFrame([(1, "c1"), (1, "c2"), (2, None)], "file_id long, commit_sha string").withColumn(
        "violations", F.expr("array(named_struct('rule_id', 'R', 'line_start', 1, 'line_end', 1))"))
    ids = {r["violation_id"] for run in ("a", "b") for r in explode_violations(sinks.identified(scans, run)).collect()}
    assert len(ids) == 6


def test_only_partitions_of_committed_attempts_are_read(spark, tmp_path):
    path = str(tmp_path)
    sinks.commit({"t": _frame(spark, 1)}, path, "a")
    text = sinks.committed(spark, path, "t")._jdf.queryExecution().toString()
    assert "dynamicpruning" in text.lower()


def test_manual_audit_entries(spark, tmp_path):
    entries = spark.createDataFrame([(1, "override", "o", "r", "override")], "number int, event_type string, org string, repo string, action_taken string")
    rows = audit.entry_rows(entries, "m1", F.expr("TIMESTAMP_NTZ '2024-06-01 12:00:00'"))
    assert audit.append(rows, str(tmp_path), "m1") and not audit.append(rows, str(tmp_path), "m1")
    got = audit.stored(spark, str(tmp_path)).collect()
    assert len(got) == 1 and (got[0]["resolution_state"], got[0]["violations_count"], got[0]["scan_id"]) == ("pending", 0, None)
