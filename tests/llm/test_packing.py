import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from scanfold.llm import packing as P
from scanfold.llm.bpe import default_path

TOKENIZER = Tokenizer.from_file(default_path())


def round_robin(tokens, targets, window):
    """The mixture played slot by slot: per window, how many tokens each queue sends."""
    sent, out = [0] * len(tokens), []
    while sum(sent) < sum(tokens):
        row = [0] * len(tokens)
        for _ in range(min(window, sum(tokens) - sum(sent))):
            q = min((q for q in range(len(tokens)) if sent[q] < tokens[q]), key=lambda q: ((2 * sent[q] + 1) / targets[q], q))
            sent[q] += 1
            row[q] += 1
        out.append(row)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_closed_form(seed):
    r = random.Random(seed)
    tokens = [r.choice((1, 3, 50, 400, 2000)) for _ in range(r.randrange(1, 9))]
    targets = [float(t) for t in tokens] if seed % 2 else [r.choice((1.0, 2.0, 2.5, 40.0)) for _ in tokens]
    m, window = P.Mixture(tokens, targets), r.choice((16, 100))
    rows = round_robin(tokens, targets, window)
    sums = np.cumsum([[0] * len(tokens), *rows], axis=0)
    assert np.array_equal(m.sent(np.arange(len(rows) + 1) * window), sums)
    order = [(((2 * a + 1) / targets[q]), q, a) for q in range(len(tokens)) for a in range(tokens[q])]
    for k, (_, q, a) in enumerate(sorted(order)):
        if k % 7 == 0:
            assert m.rank(np.array([q]), np.array([a]))[0] == k


def check(texts, pieces, window):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    assert set(by_doc) == set(texts)
    for d, t in texts.items():
        ids = np.array(TOKENIZER.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for p in sorted(by_doc[d], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(ids[at:at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for s, ps in by_seq.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == window or s == len(by_seq) - 1 and at <= window


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    pieces = P.op5_packing(spark, sf_dir).collect()
    check({r.doc_id: r.text for r in rows}, pieces, P.WINDOW)
    source, total, mix = {r.doc_id: r.source for r in rows}, defaultdict(int), defaultdict(lambda: defaultdict(int))
    for p in pieces:
        total[source[p.doc_id]] += p.length
        mix[p.sequence_id][source[p.doc_id]] += p.length
    share = {s: n / sum(total.values()) for s, n in total.items()}
    for s in range(max(mix)):
        assert all(abs(mix[s][q] - share[q] * P.WINDOW) < 2 for q in share)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "MOST_QUEUES", 3)
    texts = {i: t for i, t in enumerate([None, "", "word", "<|endoftext|> a", "é𝒳 " * 50, "x" * 5000, " " * 3000, "a b " * 900,
                                         "same", "same", "one two three"] * 3)}
    rows = [(d, t, [None, "", "a", "b", "c", "d"][d % 6], 7) for d, t in texts.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, length int")
    check(texts, P.digest(P.pack(df, window=64)).collect(), 64)
    named = P.pack(df, window=64, targets={"a": 3.0, "b": 1.0, "": 2.0})
    check(texts, P.digest(named).collect(), 64)
    assert P.digest(P.pack(df.limit(0))).count() == 0
    twice = spark.createDataFrame([(1, "a b", None)] * 3, "doc_id long, text string, source string")
    assert sorted((p.sequence_id, p.offset, p.length) for p in P.pack(twice).collect()) == [(0, 0, 3), (0, 3, 3), (0, 6, 3)]
