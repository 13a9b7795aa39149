import hashlib
import math
import random
import re
from collections import Counter

import pytest

from scanfold.llm import disclosure as D

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_base(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for rank, pattern in ((2, CARD), (3, PHONE)):
        for m in pattern.finditer(text):
            d = [int(c) for c in m[0] if c.isdigit()]
            check = sum(sum(divmod(2 * x, 10)) if k % 2 else x for k, x in enumerate(reversed(d))) % 10 == 0
            if 10 <= len(d) <= 15 if rank == 3 else 14 <= len(d) <= 19 and check:
                out.append((m.start(), rank, m.end()))
    return sorted(out)


def expected(texts):
    base = {d: plain_base(t or "") for d, t in texts.items()}
    n_e, n_et, n_t, near = Counter(), Counter(), Counter(), {}
    for d, t in texts.items():
        t = t or ""
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", t)]
        words = [(a, b) for a, b in words if b - a >= 3]
        n_t.update({t[a:b].lower() for a, b in words})
        near[d] = []
        for start, rank, end in base[d]:
            e = D.entity(t[start:end], rank)
            # words that the span or the reach cuts are no whole words
            lead = [(max(a, 0), min(b, start)) for a, b in words if a < start and min(b, start) - a >= 3 and b > start - 200]
            tail = [(max(a, end), b) for a, b in words if b > end and b - max(a, end) >= 3 and a < end + 200]
            for a, b in [(max(a, start - 200), b) for a, b in lead][-8:] + [(a, min(b, end + 200)) for a, b in tail][:8]:
                if b - a < 3 or (a == start - 200 > 0 and t[a - 1].isalpha()) or (b == end + 200 < len(t) and t[b].isalpha()):
                    continue
                if not any(x < b and a < y for x, _, y in base[d]):
                    near[d].append((e, t[a:b].lower(), a, b))
        n_e.update({D.entity(t[a:b], k) for a, k, b in base[d]})
        n_et.update({(e, w) for e, w, _, _ in near[d]})
    out = {}
    for d in texts:
        found = {}
        for e, w, a, b in near[d]:
            if n_et[e, w] >= 2 and 2 <= n_e[e] < len(texts):
                share = math.log(n_et[e, w] * len(texts) / (n_e[e] * n_t[w])) / math.log(len(texts) / n_e[e])
                if share >= D.GENERALISE - 1e-12:
                    found[a, b] = max(found.get((a, b), 0), 5 if share >= D.REMOVE - 1e-12 else 4)
        out[d] = sorted([*base[d], *((a, k, b) for (a, b), k in found.items())])
    return out


def joined(spans):
    return ",".join(f"{D.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_base_patterns():
    r = random.Random(4)
    parts = ["a", "b.c", "@", "@x.y", ".", "-", "1", "22", "255", "256", ".", "4111111111111111", "4111 1111-1111 1111", "+", "+49 (30) 1234-5678",
             "(", ")", " ", "  ", "é", "𝒳", "_", "%", "01", "999.1.2.3", "10.0.0.1"]
    for _ in range(4000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(14)))
        assert D.base_spans(t) == plain_base(t), t
    long = "a" * 200_000 + "@" + "1" * 200_000 + "+1" + "(" * 200_000
    assert D.base_spans(long) == []


def corpus():
    r = random.Random(8)
    words = [f"{a}{b}{c}" for a in "kl" for b in "aeiou" for c in ("man", "ter", "sol")]
    texts = {}
    for i in range(60):
        t = " ".join(r.choice(words) for _ in range(r.randrange(40)))
        if i % 4 == 0:
            t += f" Zaphod writes from zap{i // 4 % 2}@heart.gold about {('arthur', 'ford')[i // 4 % 2]}, {r.choice(words)}; call +44 20 7946 {1000 + i} now 𝒳 "
        texts[i] = t + " ".join(r.choice(words) for _ in range(r.randrange(9)))
    return texts | {90: None, 91: "", 92: "10.0.0.1 " * 300, 93: "longword" * 900 + " zap0@heart.gold"}


def test_against_brute_force(spark, tmp_path):
    texts = corpus()
    df = spark.createDataFrame([(d, t, t) for d, t in texts.items()], "doc_id long, text string, spans string")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = expected(texts)
    rows = D.op3_disclosure(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts) and any("remove" in r.spans for r in rows) and any("generalise" in r.spans for r in rows)
    for r in rows:
        base = [s for s in want[r.doc_id] if s[1] < 4]
        assert r.spans == joined(want[r.doc_id]), texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
    clean = {r.doc_id: r for r in D.sanitise(df).collect()}
    assert clean[90].text is None and clean[91].text == "" and clean[0].spans == texts[0]
    assert "zap0" not in clean[0].text and "[email]" in clean[0].text


@pytest.mark.parametrize("sent", [0, 1_000_000])
def test_given_table_and_both_ways_to_count(spark, sf_dir, monkeypatch, sent):
    monkeypatch.setattr(D, "SENT_TERMS", sent)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = expected(texts)
    assert {r.doc_id: r.spans for r in D.op3_disclosure(spark, sf_dir).collect()} == {d: joined(s) for d, s in want.items()}


def test_odd_tables(spark):
    schema = "doc_id long, text string"
    assert D.find_personal(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "mail bob@x.org please")] * 3 + [(None, "mail bob@x.org please"), (None, None)]
    got = D.find_personal(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5 and sum(len(r.spans) > 0 for r in got) == 4
    assert D.sanitise(spark.createDataFrame(rows, schema)).count() == 5
