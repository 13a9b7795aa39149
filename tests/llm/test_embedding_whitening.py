"""Whitening against numpy on whole matrices."""

import math
import random

import numpy as np
import pytest

from scanfold.llm import embedding_whitening
from scanfold.llm.embedding_whitening import op11_embedding_whitening, whiten
from scanfold.ship import ship

SCHEMA = "vec_id long, embedding array<float>"


def kept(rows):
    return [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def check(got, rows, components=16):
    """got: rows of the query; rows: (vec_id, vector) of one length."""
    left = kept(rows)
    fit = [list(t) for t in {tuple(x) for _, x in left}]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    v = np.array(fit, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(v.T @ v / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > values[0] * len(sums) * 1e-13).sum()))
    assert len(got) == len(left) * k
    table = {}
    for r in got:
        assert r["n"] == n and 0 <= r["identity_error"] < 1e-8
        assert abs(r["explained"] / (values[r["component"] - 1] / values.sum()) - 1) < 1e-8
        table.setdefault((r["vec_id"], r["deviation"]), []).append((r["component"], r["whitened"]))
    signs = {}
    for i, x in left:
        cells = table[i, sum((n * c - s) ** 2 for c, s in zip(x, sums))]
        want = (np.array(x) - np.array(sums) / n) @ vectors[:, :k] / np.sqrt(values[:k])
        per = {}
        for c, w in cells:
            per.setdefault(c, []).append(w)
        assert sorted(per) == [*range(1, k + 1)]
        for c in range(1, k + 1):
            if abs(want[c - 1]) > 1e-3:
                signs.setdefault(c, np.sign(want[c - 1]) * np.sign(per[c][0]))
            assert any(abs(w * signs.get(c, 1) - want[c - 1]) < 1e-6 for w in per[c])


def made(seed, n, d):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 1 / (1 + j)) for j in range(d)]) for i in range(n)]
    odd = [(n, None), (n + 1, [None, *[0.5] * (d - 1)]), (n + 2, [float("nan"), *[0.5] * (d - 1)]), (n + 3, [float("-inf"), *[0.5] * (d - 1)])]
    return rows + odd + [(n + 4 + i, rows[0][1]) for i in range(n // 2)] + [rows[1], (None, rows[2][1])]


@pytest.mark.parametrize("n, d", [(40, 5), (300, 20), (12, 30)])
def test_against_numpy(spark, tmp_path, monkeypatch, n, d):
    ship(spark)
    monkeypatch.setattr(embedding_whitening, "BLOCK_ENTRIES", 100)
    rows = made(n, n, d)
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n", "2 AS place", "3 AS x", "4 AS rid").write.parquet(f"{tmp_path}/embeddings.parquet")
    check(op11_embedding_whitening(spark, str(tmp_path)).collect(), rows)


def test_given_table(spark, sf_dir):
    ship(spark)
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(op11_embedding_whitening(spark, sf_dir).collect(), rows)


def test_spaces_of_other_lengths_and_no_spread(spark):
    ship(spark)
    rows = [(i, [i * 1.0, (i % 3) * 1.0]) for i in range(9)] + [(20 + i, [float(i * i)]) for i in range(4)] + [(30, [1.0] * 3), (31, [1.0] * 3), (32, [])]
    got = whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted({r["vec_id"] for r in got}) == [*range(9), *range(20, 24)]
    assert {r["vec_id"]: len(r["whitened"]) for r in got} == {**dict.fromkeys(range(9), 2), **dict.fromkeys(range(20, 24), 1)}
    assert {r["n"] for r in got if r["vec_id"] < 9} == {9} and {r["n"] for r in got if r["vec_id"] > 9} == {4}


def test_huge_entries(spark, tmp_path):
    ship(spark)
    rows = [(i, [3e38 * (-1) ** i, float(i)]) for i in range(5)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op11_embedding_whitening(spark, str(tmp_path)).collect()
    assert {r["vec_id"] for r in got} == {*range(5)} and {r["deviation"] for r in got} == {None}
    deviations = {r["vec_id"]: int(r["deviation"]) for r in whiten(spark.createDataFrame(rows, SCHEMA)).collect()}
    x = [[math.floor((-1) ** i * 2 ** 40) + 1_000_000, 64 * i + 1_000_000] for i in range(5)]
    sums = [sum(c) for c in zip(*x)]
    assert deviations == {i: sum((5 * c - s) ** 2 for c, s in zip(x[i], sums)) for i in range(5)}


def test_empty_tables(spark, tmp_path):
    ship(spark)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert op11_embedding_whitening(spark, str(tmp_path)).collect() == []
    assert whiten(spark.createDataFrame([(1, None), (2, [None])], SCHEMA)).collect() == []
