import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from scanfold.llm import chunk_encode as E
from scanfold.llm.bpe import bpe, default_path

TOKENIZER = Tokenizer.from_file(default_path())


def texts(seed):
    r = random.Random(seed)
    parts = ["the", "then", "é", "ß", "12", "3.5", "don't", "<|endoftext|>", "  ", "\n", "\t", "...", "$", "中文", "🙂", "   ",
             " ", "x" * 40, "'ll", " 's"]
    passage = " ".join(r.choice(parts) + str(r.randrange(99)) for _ in range(900))
    out = [None, "", " ", "a" * 3000, " " * 3000, "é" * 3000, "<|endoftext|>" * 300, "中文字" * 900, passage]
    for _ in range(12):
        out.append((r.choice(("", " ")).join(r.choice(parts) for _ in range(r.randrange(2000)))) + " " + passage[r.randrange(3000):])
        out.append(" ".join(r.choice(parts) for _ in range(r.randrange(2500))))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_exact(seed):
    chunks = E.Chunks(bpe(default_path()), 200_000)
    for t in texts(seed):
        want = TOKENIZER.encode(t or "", add_special_tokens=False).ids
        assert E.encode(t or "", chunks).tolist() == want
        assert chunks.coder.decode(np.array(want, np.uint32)) == TOKENIZER.decode(want, skip_special_tokens=False)
    assert chunks.reused > 2 and chunks.held <= 200_000


def test_boundaries_follow_content():
    r = random.Random(3)
    passage = "".join(r.choice("abcdefgh é") for _ in range(20_000)).encode()

    def cut(data):
        ends = E.boundaries(data)
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    a, b = cut(b"some words before " + passage), cut(b"other ones" + passage)
    assert len(set(a) & set(b)) >= len(a) - 3 > 5
    assert b"".join(cut(passage)) == passage and all(x.decode() for x in cut(passage))


def test_query(spark, tmp_path):
    rows = [(i, t, t) for i, t in enumerate(texts(9) + ["same text " * 500] * 8)]
    spark.createDataFrame(rows, "doc_id long, text string, route string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in E.op6_chunk_encode(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        ids = TOKENIZER.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        text = TOKENIZER.decode(ids, skip_special_tokens=False)
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(spark):
    assert E.encode_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_short_texts_are_kept():
    from scanfold.llm import chunk_encode
    from scanfold.llm.bpe import bpe, default_path
    coder = bpe(default_path())
    chunks = chunk_encode.Chunks(coder)
    for text in ["a short text", "noblanks" * 300] * 50:
        assert chunk_encode.encode(text, chunks).tolist() == coder.encode(text).tolist()
    assert (chunks.asked, chunks.reused) == (100, 98)
