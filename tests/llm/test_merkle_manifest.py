"""The manifest against a plain tree."""

import hashlib
import random
import zlib

import pytest

from scanfold.llm import merkle_manifest
from scanfold.llm.merkle_manifest import OpenTree, digest, fold, height, op13_merkle_manifest
from scanfold.ship import ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    values = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(nodes):
    """The root, and for each node its path: (place, run) by level."""
    paths, at = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [nodes[i:i + 3] for i in range(0, len(nodes), 3)]
        for i, below in enumerate(at):
            for x in below:
                paths[x].append((i % 3, runs[i // 3]))
        at = [sum(at[i:i + 3], []) for i in range(0, len(at), 3)]
        nodes = [sha(*r) for r in runs]
    return nodes[0], paths


def plain(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees, ordered = {}, {}
    for s in names:
        ordered[s] = sorted(by_source[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"])))
        trees[s] = plain_tree([leaf_of(r, r["text"]) for r in ordered[s]])
    root, tops = plain_tree([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops, strict=True):
        for r, path in zip(ordered[s], trees[s][1], strict=True):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None
            node = leaf_of(r, r["text"].replace("\n", "") if hit else r["text"])
            others = [d for place, run in path + top for i, d in enumerate(run) if i != place]
            for place, run in path + top:
                node = sha(*[node if i == place else d for i, d in enumerate(run)])
            out.append((r["doc_id"], leaf_of(r, r["text"]), trees[s][0], root, sha(*others), node, node == root))
    return out


def same(got, want):
    return sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)


def made(seed):
    r = random.Random(seed)
    sources = ["hot"] * 6 + ["a", "ä", "Z", None, "", "b b"]
    rows = [{"doc_id": r.choice([i, i, i, 7, None]), "text": r.choice([None, "", "x", f"one\n{i}", f"né {i}", "same\ntext"]), "lang": r.choice(["en", None, ""]),
             "source": r.choice(sources), "n_chars": r.choice([None, -1, i])} for i in range(r.choice([1, 2, 9, 27, 28, 200]))]
    return rows + r.choices(rows, k=len(rows) // 3)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("levels", [1, 2, 7])
def test_against_plain_tree(spark, tmp_path, monkeypatch, seed, levels):
    if levels < 7:                                  # several steps of appends; the worker's module is set by the copied function
        monkeypatch.setattr(merkle_manifest, "LEVELS", levels)
        monkeypatch.setattr(merkle_manifest, "BLOCK", 3 ** levels)
        grow = merkle_manifest._grow

        def small(batches, grow=grow, levels=levels):
            import scanfold.llm.merkle_manifest as m
            m.LEVELS, m.BLOCK = levels, 3 ** levels
            try:
                yield from m._grow(batches)
            finally:
                m.LEVELS, m.BLOCK = 7, 3 ** 7
        monkeypatch.setattr(merkle_manifest, "_grow", small)
    ship(spark)
    rows = made(seed)
    docs = spark.createDataFrame([[r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")] for r in rows], SCHEMA)
    docs.selectExpr("*", "1 AS key", "'k' AS node", "2 AS rank").write.parquet(f"{tmp_path}/documents.parquet")
    assert same(op13_merkle_manifest(spark, str(tmp_path)).collect(), plain(rows))


def test_given_table(spark, sf_dir):
    ship(spark)
    got = op13_merkle_manifest(spark, sf_dir).collect()
    rows = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert same(got, plain(rows))
    assert {r["verified"] for r in got} == {True, False}


def test_empty_table(spark, tmp_path):
    ship(spark)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert op13_merkle_manifest(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("n", [*range(1, 30), 81, 82, 250])
def test_open_tree(n):
    tree, leaves = OpenTree(), [digest([bytes([i])]) for i in range(n)]
    for x in leaves:
        tree.append(x)
    root = tree.close(height(n))
    want, paths = plain_tree([x.hex() for x in leaves])
    assert root.hex() == want
    for x, w, path in zip(leaves, tree.witnesses, paths, strict=True):
        top, siblings = fold(x, bytes(w))
        assert top == root and [s.hex() for s in siblings] == [d for place, run in path for i, d in enumerate(run) if i != place]


def test_very_long_text(spark, tmp_path):
    ship(spark)
    rows = [{"doc_id": i, "text": "é\n" * 400_000 if i == 2 else str(i), "lang": "x", "source": "s", "n_chars": 1} for i in range(4)]
    spark.createDataFrame([[r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")] for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert same(op13_merkle_manifest(spark, str(tmp_path)).collect(), plain(rows))
