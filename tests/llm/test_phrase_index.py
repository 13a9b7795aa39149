"""The phrase index against plain search."""

import hashlib
import random
import re

import pytest

from scanfold.llm import phrase_index
from scanfold.llm.phrase_index import decontaminate, op12_phrase_index
from scanfold.ship import ship


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def plain(docs, items, size=10, span=15):
    windows = {}
    for item, text in items:
        ws = words(text)
        for i in range(max(1, len(ws) - size + 1) if ws else 0):
            windows.setdefault(tuple(ws[i:i + size]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        ws, hit, found, near = words(text), set(), set(), set()
        for w, owners in windows.items():
            for i in range(len(ws) - len(w) + 1):
                if tuple(ws[i:i + len(w)]) == w:
                    hit |= {*range(i, i + len(w))}
                    found |= owners
            if any({*w} <= {*ws[max(0, i):i + span]} for i in range(1 - span, len(ws))):
                near |= owners
        out.append((doc_id, len(ws), len(hit), sorted(found), len(near)))
    return sorted(out, key=repr)


def made(seed):
    """Texts over few words, so that windows are met in whole, in part and out of order."""
    r = random.Random(seed)
    vocab = ["a", "B", "cé", "Dd", "1x", "né2", "foo"]
    say = lambda n: "".join(r.choice(vocab) + r.choice([" ", ", ", "\n", " \x7f-"]) for _ in range(n))
    items = [(i, say(r.choice([1, 2, 4, 6, 12]))) for i in range(12)] + [(3, say(5)), (None, say(4)), (90, ""), (91, None), (92, "?!")]
    docs = [(i, say(r.randint(0, 60))) for i in range(40)] + [(7, items[4][1] * 3), (None, items[0][1]), (41, None), (42, ""), (43, "-- !!")]
    return docs, items


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("small", [False, True])
def test_against_plain_search(spark, monkeypatch, seed, small):
    ship(spark)
    if small:                                       # several segments and blocks, no broadcast, all terms indexed
        monkeypatch.setattr(phrase_index, "BLOCK_WINDOWS", 7)
        monkeypatch.setattr(phrase_index, "SENT_USES", 0)
        monkeypatch.setattr(phrase_index, "SENT_TERMS", 0)
    docs, items = made(seed)
    found = decontaminate(spark.createDataFrame(docs, "doc_id long, text string").withColumns({}).selectExpr("doc_id", "text", "1 AS term", "2 AS segment"),
                          spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS window", "'y' AS item"), 4, 6)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain(docs, items, 4, 6)


def test_segments_in_a_partition(spark):
    """Documents that share a partition and a segment border."""
    class Context:
        @staticmethod
        def partitionId():
            return 3
    import pyarrow as pa
    import pyspark

    docs, _ = made(9)
    texts = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs]), pa.array([t and t.encode() for _, t in docs], pa.binary())], ["doc_id", "text"])
    old, phrase_index.SEGMENT_WORDS, get = phrase_index.SEGMENT_WORDS, 500, pyspark.TaskContext.get
    pyspark.TaskContext.get = lambda: Context
    try:
        rows = [r for b in phrase_index._segments(None)(iter([texts])) for r in b.to_pylist()]
    finally:
        phrase_index.SEGMENT_WORDS, pyspark.TaskContext.get = old, get
    assert len({r["segment"] for r in rows}) > 2
    assert [(r["doc_id"], r["n_words"]) for r in rows if r["term"] is None] == [(d, len(words(t))) for d, t in docs]
    assert sum(r["n"] for r in rows if r["term"]) == sum(len(words(t)) for _, t in docs)


def test_query_on_given_tables(spark, sf_dir):
    ship(spark)
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {r["doc_id"]: r for r in op12_phrase_index(spark, sf_dir).collect()}
    windows = {}
    for r in items.collect():
        ws = words(r["text"])
        for i in range(max(1, len(ws) - 9) if ws else 0):
            windows.setdefault(tuple(ws[i:i + 10]), set()).add(str(r["item_id"]))
    sizes, some = sorted({len(w) for w in windows}), 0
    for r in docs.collect():
        ws, hit, found = words(r["text"]), set(), set()
        for n in sizes:
            for i in range(len(ws) - n + 1):
                if owners := windows.get(tuple(ws[i:i + n])):
                    hit |= {*range(i, i + n)}
                    found |= owners
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_hit"], g["n_items"], g["contaminated"]) == (len(ws), len(hit), len(found), bool(hit))
        assert g["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert g["n_near"] >= g["n_items"]
        some += bool(hit)
    assert some


def test_empty_tables(spark):
    ship(spark)
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert decontaminate(docs.limit(0), items).collect() == []
    assert [tuple(r) for r in decontaminate(docs, items.limit(0)).collect()] == [(1, 2, 0, [], 0)]


def test_very_long_text_and_common_term(spark):
    ship(spark)
    text = "x y " * 300_000 + "one two three four"
    docs = spark.createDataFrame([(1, text), (2, text), (3, "x")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "x"), (2, "One, two three four"), (3, "four three two one")], "item_id long, text string")
    got = {r[0]: tuple(r) for r in decontaminate(docs, items, 4, 4).collect()}
    assert got[1] == (1, 600_004, 300_004, ["1", "2"], 3) and got[2][1:] == got[1][1:] and got[3] == (3, 1, 1, ["1"], 1)
