"""The pipeline against plain Python versions of its stages."""

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from scanfold.llm import quality_rules as Q
from test_ngram_join import expected as linked
from test_packing import TOKENIZER
from test_secret_scan import expected as secrets


def words_of(text):
    return [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]


def measures(text):
    text, ws = text or "", words_of(text)
    lines, seen, at = [x for x in text.split("\n") if words_of(x)], defaultdict(list), set()
    for i in range(len(ws) - 2):
        seen[tuple(ws[i:i + 3])].append(i)
    for places in seen.values():
        if len(places) > 1:
            at |= {i + d for i in places for d in range(3)}
    return {"n_words": len(ws), "word_chars": sum(map(len, ws)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(at)}


def good(docs):
    rows = {d: measures(t) for d, (t, _) in docs.items()}
    fails = {d: [m["n_symbols"] * 10 > m["n_words"], m["n_dup_lines"] * 10 > m["n_lines"] * 3,
                 m["word_chars"] < m["n_words"] * 3 or m["word_chars"] > m["n_words"] * 12,
                 m["n_repeat_words"] * 5 > m["n_words"]] for d, m in rows.items()}
    hosts = defaultdict(list)
    for d, (_, s) in docs.items():
        hosts[s or ""].append(d)
    strict = {}
    for r in range(4):
        k = {h: sum(fails[d][r] for d in ds) for h, ds in hosts.items()}
        q = sum(k[h] ** 2 / len(ds) for h, ds in hosts.items())
        a, s = Q.beta_prior(len(hosts), len(docs), sum(k.values()), q)
        for h, ds in hosts.items():
            strict[h, r] = (k[h] + a) / (len(ds) + s) > Q.HOST_LIMIT
    base = {d: m["n_words"] < 50 or m["n_repeat_words"] * 100 > m["n_words"] * 50 for d, m in rows.items()}
    return {d: v for d, v in docs.items() if not base[d] and not any(fails[d][r] and strict[v[1] or "", r] for r in range(4))}


def cut_lines(docs):
    first, out = {}, {}
    solid = {d: [(i, x.strip(" \t\n\x0b\x0c\r")) for i, x in enumerate((t or "").split("\n")) if words_of(x)] for d, (t, _) in docs.items()}
    for d in sorted(docs):
        for j in range(len(solid[d]) - 2):
            first.setdefault(tuple(x for _, x in solid[d][j:j + 3]), (d, j))
    for d, (t, s) in docs.items():
        gone = set()
        for j in range(len(solid[d]) - 2):
            if first[tuple(x for _, x in solid[d][j:j + 3])] != (d, j):
                gone |= {j, j + 1, j + 2}
        drop = {solid[d][j][0] for j in gone}
        for j in gone:
            if j + 1 in gone:
                drop |= set(range(solid[d][j][0], solid[d][j + 1][0]))
        kept = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop) if gone else t
        if not gone or words_of(kept):
            out[d] = (kept, s)
    return out


def masked(text):
    out, at = [], 0
    for start, _, _, end in secrets(text):
        if start >= at:
            out += [text[at:start], "[secret]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def corpus():
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 9)))
    passage = "\n".join(" ".join(word() for _ in range(18)) for _ in range(4))
    docs, base = {}, ""
    for i in range(90):
        if i % 3 == 0:
            base = "\n".join(" ".join(word() for _ in range(20)) for _ in range(r.randrange(2, 9)))
        text = base if i % 3 else base + "\n" + " ".join(word() for _ in range(30))
        if i % 3 == 2:
            text = text.replace(" ", "  ").replace("\n", " ")
        if i % 7 == 0:
            text = passage + "\n\n" + text
        if i % 5 == 0:
            text += f"\ntoken = \"{r.randrange(1 << 100):025x}\" end"
        docs[i] = (text if i % 11 else " | ".join(text.split()), f"s{i % 4}" if i % 4 else None)
    return docs | {100: (None, "s1"), 101: ("", None), 102: ("too short", "s2"), 103: ("again and again " * 60, "s1"), 104: passage and (passage, "s1")}


def test_stages_and_run(spark, tmp_path):
    docs = corpus()
    df = spark.createDataFrame([(d, t, "en", s, len(t or ""), "x") for d, (t, s) in docs.items()],
                               "doc_id long, text string, lang string, source string, n_chars long, tokens string")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want, now = docs, df
    plain = [good, cut_lines, lambda d: {i: d[i] for i, (_, c) in linked({i: t for i, (t, _) in d.items()}, 5, 80).items() if c == i},
             lambda d: {i: (masked(t), s) for i, (t, s) in d.items()}]
    for (name, stage), check in zip(P.STAGES, plain):
        before, want = want, check(want)
        out = stage(spark, now, str(tmp_path))
        assert out.columns == df.columns
        got = {r.doc_id: r for r in out.collect()}
        assert {d: (r.text, r.source) for d, r in got.items()} == want, name
        assert all(r.n_chars == len(r.text) and r.tokens == "x" for r in got.values())
        assert want != before, name
        now = spark.createDataFrame([tuple(r) for r in got.values()], df.schema)
    pieces = P.run(spark, str(tmp_path)).collect()
    ids = defaultdict(dict)
    for p in pieces:
        ids[p.doc_id][p.start] = np.frombuffer(p.ids, "<u4").tolist()
    assert {d: sum((v[k] for k in sorted(v)), []) for d, v in ids.items()} == {
        d: [*TOKENIZER.encode(t, add_special_tokens=False).ids, 1] for d, (t, _) in want.items()}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_null_columns(spark):
    df = spark.createDataFrame([(None, None, None, None, None)] * 2 + [(7, "a b", None, None, None)],
                               "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in P.STAGES:
        assert stage(spark, df, "").where(F.lit(True)).count() <= 3, name
