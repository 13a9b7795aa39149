import random

import pytest
from pyspark.sql import functions as F

from scanfold.llm import components as C
from scanfold.llm import ngram_join as J


def sets(texts, size):
    out = {}
    for d, t in texts.items():
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t or "").split(" ") if w]
        words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
        grams = {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} - {()}
        out[d] = grams
    return out


def expected(texts, size, percent):
    grams, root = sets(texts, size), {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            x, y = grams[a], grams[b]
            common = len(x & y)
            if x and y and 100 * common >= percent * (len(x) + len(y) - common):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {d: (len(grams[d]), find(d)) for d in ids}


def family(seed, n=160):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(400)}"
    passage = [word() for _ in range(60)]
    texts, i = {}, 0
    base = [word() for _ in range(90)]
    for i in range(n):
        kind = r.randrange(6)
        if kind == 0:
            base = [word() for _ in range(r.choice((1, 2, 3, 8, 30, 90, 200)))]
            words = base
        elif kind == 1:
            words = passage + [word() for _ in range(r.randrange(1, 40))]
        else:
            words = list(base)
            for _ in range(r.randrange(0, 1 + len(words) // 25)):
                words[r.randrange(len(words))] = word()
            if kind == 2:
                words = words[r.randrange(2):]
        texts[i * 3 + 1] = " ".join(words).upper() if kind == 3 else "\n".join(words)
    return texts | {900: None, 901: "", 902: " \x0b ", 903: "é ü", 904: "É ü", 905: "one", 906: "ONE"}


@pytest.mark.parametrize("seed,size,percent,frequent,gain", [(1, 3, 90, 100, 16), (2, 3, 90, 2, 16), (3, 5, 80, 2, 0),
                                                            (4, 3, 80, 1, 0)])
def test_against_all_pairs(spark, monkeypatch, seed, size, percent, frequent, gain):
    monkeypatch.setattr(J, "FREQUENT", frequent)
    monkeypatch.setattr(J, "GAIN", gain)
    texts = family(seed)
    df = spark.createDataFrame([(d, t, d) for d, t in texts.items()], "doc_id long, text string, component_id long")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.link(df, size, percent).collect()}
    assert got == expected(texts, size, percent)


def test_rest_alone_finds_all_links(spark, monkeypatch):
    """With the star rounds switched off, combinations and rare tokens still find every component."""
    monkeypatch.setattr(J, "_star_pairs", lambda live, turn: live.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
    for frequent, gain in ((1, 0), (3, 16), (1000, 16)):
        monkeypatch.setattr(J, "FREQUENT", frequent)
        monkeypatch.setattr(J, "GAIN", gain)
        texts = family(7, 100)
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in J.link(df).collect()} == expected(texts, 3, 90)


@pytest.mark.parametrize("percent,frequent,gain", [(90, 30, 16), (90, 1, 0), (80, 2, 0)])
def test_frequent_pairs_miss_no_like_pair(spark, monkeypatch, percent, frequent, gain):
    """Copies of one set at all distances, some in one component: every like pair of two components is a candidate."""
    monkeypatch.setattr(J, "FREQUENT", frequent)
    monkeypatch.setattr(J, "GAIN", gain)
    r = random.Random(percent)
    base, rows = r.sample(range(10_000), 60), []
    for node in range(120):
        own = set(base[r.randrange(6):])
        for _ in range(r.randrange(14)):
            own.discard(r.choice(base))
            own.add(r.choice(base) if r.random() < 0.3 else r.randrange(20_000, 20_400))
        rows.append((node, min(node, 40), len(own), sorted(own)))
    made = J._frequent_pairs(spark.createDataFrame(rows, "node long, comp long, n long, tokens array<long>"), percent)
    got = {(p.a, p.b) for p in made.collect()}
    like = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[1] != y[1]
            and 100 * len({*x[3]} & {*y[3]}) >= percent * len({*x[3]} | {*y[3]})}
    assert like and like <= got
    assert all(rows[a][1] != rows[b][1] and a < b for a, b in got)


def test_copies_that_differ_each_in_its_own_way_are_not_listed_in_pairs(spark, monkeypatch):
    """Near copies of one text around the threshold: links as by brute force, pairs to verify in proportion to the copies."""
    r, listed, like = random.Random(11), [], J._like
    base = [f"w{r.randrange(400)}" for _ in range(150)]
    texts = {0: " ".join(base)}
    for d in range(1, 241):
        words = list(base)
        for at in r.sample(range(150), r.randrange(1, 6)):
            words[at] = f"x{d}-{at}" if r.random() < 0.9 else f"y{at}"
        texts[d] = " ".join(words)

    def counted(pairs, sets, percent):
        listed.append(pairs.count())
        return like(pairs, sets, percent)

    monkeypatch.setattr(J, "_like", counted)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in J.link(df).collect()}
    assert got == expected(texts, 3, 90)
    assert 20 < len({c for _, c in got.values()}) < 220
    assert sum(listed) < 2 * len(texts)


@pytest.mark.parametrize("percent", [90, 80])
def test_diff_pairs_are_the_like_pairs_of_one_leader(spark, percent):
    r = random.Random(percent)
    rows, sets = [], {}
    for home in (1000, 2000):
        head = set(r.sample(range(10_000), 50 if home == 1000 else 23))
        for node in range(home + 1, home + 150):
            own = set(head) if r.random() < 0.7 or node < home + 3 else set(sets[r.randrange(home + 1, node)][1])
            for _ in range(r.randrange(12)):
                own.discard(r.choice(sorted(own)))
                if r.random() < 0.8:
                    own.add(r.randrange(20_000, 20_100) if r.random() < 0.3 else r.randrange(30_000, 90_000))
            sets[node] = (home, own, 100 * len(own & head) >= percent * len(own | head))
            rows.append((node, home, len(own), len(head), sets[node][2], sorted(own ^ head)))
    near = spark.createDataFrame(rows, "a long, b long, n long, m long, like boolean, diff array<long>")
    got = [(p.a, p.b) for p in J._diff_pairs(near, percent).collect()]
    got = {(min(p), max(p)) for p in got}
    pairs = {(a, b): sets[a][2] and sets[b][2] for a in sets for b in sets if a < b and sets[a][0] == sets[b][0]
             and 100 * len(sets[a][1] & sets[b][1]) >= percent * len(sets[a][1] | sets[b][1])}
    assert {p for p, both in pairs.items() if not both} <= got <= set(pairs)
    assert len({p for p, both in pairs.items() if not both}) > 20


def test_prefixes_share_enough():
    r = random.Random(5)
    for _ in range(300):
        n = r.randrange(1, 120)
        x = set(r.sample(range(10_000), n))
        y = set(x)
        for _ in range(r.randrange(0, 1 + n // 6)):
            y.discard(r.choice(sorted(y))) if len(y) > 1 and r.random() < 0.5 else y.add(r.randrange(10_000))
        for percent in (80, 90):
            if 100 * len(x & y) >= percent * len(x | y):
                cut = lambda s: set(sorted(s)[:J.prefix(len(s), percent) + J.extension(len(s), percent) - 1])  # noqa: E731,B023
                assert len(cut(x) & cut(y)) >= max(J.shared_least(len(x), percent), J.shared_least(len(y), percent))


def test_odd_tables(spark):
    schema = "doc_id long, text string, node string"
    assert J.link(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d", "x"), (None, "a b c d", "x"), (5, "a b c d", None), (5, "a b c d", None), (7, "A B c d", ""), (8, "", "")]
    got = sorted((r.doc_id or 0, r.component_id) for r in J.link(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 5), (0, 5), (5, 5), (5, 5), (7, 5), (8, 8)]
    kept = J.keep_one(spark.createDataFrame(rows, schema))
    assert kept.columns == ["doc_id", "text", "node"] and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 5, 5, 8]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7)]
    got = {r.node: r.comp for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)}
