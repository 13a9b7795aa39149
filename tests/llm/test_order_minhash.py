import hashlib
import struct

import xxhash
from pyspark.sql import functions as F

from scanfold.llm import order_minhash as M


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chain(*values):
    h = 42
    for v in values:
        if isinstance(v, tuple):
            kind, v = v
            data = struct.pack("<q" if kind == "long" else "<i", v)
        else:
            data = v.encode()
        h = xxhash.xxh64(data, h).intdigest()
    return signed(h)


def expected(text, k=M.K):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    runs = [chain(*words)] if 0 < len(words) < k else [chain(*words[i:i + k]) for i in range(len(words) - k + 1)]
    seen, bins = {}, {}
    for i, g in enumerate(runs):
        n = seen[g] = seen.get(g, -1) + 1
        h = chain(("long", g), ("int", n))
        bins.setdefault(h >> (64 - M.BITS), []).append((h, i, g))
    out = []
    for b in sorted(bins):
        chosen = sorted(sorted(bins[b])[:2], key=lambda x: x[1])
        t = chain(*[("long", g) for _, _, g in chosen])
        out.append((b + (1 << (M.BITS - 1))) << 32 | (t & (1 << 64) - 1) >> 32)
    return out


def like(a, b):
    bins = {x >> 32 for x in a} | {x >> 32 for x in b}
    return len(set(a) & set(b)) / len(bins) if bins else 1.0


TEXTS = [None, "", " \n", "one", "a b c d", "a b c d e", "x " * 300, "é𝒳 " * 9 + "end", " ".join(map(str, range(400))),
         " ".join(map(str, range(200))) + " " + " ".join(map(str, range(200))), "a b c d e", "tail\x0bword\x0cmore\x1fone"]


def test_fingerprints(spark):
    df = spark.createDataFrame([(t, t) for t in TEXTS], "text string, fingerprint string")
    rows = df.select("text", M.fingerprint(F.col("text")).alias("f")).collect()
    for r in rows:
        assert list(r.f) == expected(r.text), r.text
    assert M.fingerprints(df).columns == ["text", "fingerprint"]


def check(rows, texts):
    order = sorted(texts, reverse=True)
    for i, d in enumerate(order):
        t, following = texts[d] or "", texts[order[(i + 1) % len(order)]] or ""
        half = len(t) // 2
        e = t[:len(t) - half] + following[:half]
        r, f = rows[d], expected(t)
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert r.fingerprint == "".join(f"{x:010x}" for x in f)
        assert r.edited_fingerprint == "".join(f"{x:010x}" for x in expected(e))
        assert abs(r.near_edited - like(f, expected(e))) < 1e-12 and abs(r.near_next - like(f, expected(following))) < 1e-12


def test_query(spark, sf_dir, monkeypatch):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check({r.doc_id: r for r in M.op4_order_minhash(spark, sf_dir).collect()}, texts)
    monkeypatch.setattr(M, "RANGE_ROWS", 7)
    check({r.doc_id: r for r in M.op4_order_minhash(spark, sf_dir).collect()}, texts)


def test_small_tables(spark, tmp_path):
    schema = "doc_id long, text string"
    for name, data in {"none": [], "one": [(5, "just one text of more than five words")], "same": [(1, "a b")] * 4,
                       "nulls": [(None, "x y"), (None, None), (3, "z")]}.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        rows = M.op4_order_minhash(spark, f"{tmp_path}/{name}").collect()
        assert len(rows) == len(data)
        if name == "same":
            assert all(r.near_next == 1.0 for r in rows)
