import zlib

import numpy as np
from pyspark.sql import functions as F

from scanfold.llm import byte_cnn as B


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = B.op10_byte_cnn(spark, path).collect()
    assert {r.doc_id for r in rows} == set(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert np.mean(held) > 0.96


def test_gradients():
    r = np.random.default_rng(1)
    model = B.ByteCnn(["a", "b", "c"], np.zeros(256, np.uint8))
    x, y = r.integers(1, 20, (5, B.LENGTH)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    loss = lambda: -np.log(model.probabilities(x)[np.arange(5), y]).mean()
    grads = model._gradients(x, y, np.ones(5))
    for values, g in zip([*model.conv, model.bias, model.out, model.out_bias], grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = values[at]
        values[at] = old + 1e-3
        up = loss()
        values[at] = old - 1e-3
        down = loss()
        values[at] = old
        assert abs((up - down) / 2e-3 - g[at]) < 0.05 * abs(g[at]) + 1e-3


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, score string"
    words = {"en": "the house and the tree with water ", "de": "das Haus und der Baum mit Wasser "}
    rows = [(i, words[lang] * (i % 7 + 1), lang, "x") for i in range(120) for lang in words]
    rows += [(500, None, "en", None), (501, "", None, None), (502, "12 34 ?!", "de", None), (503, "the tree " * 9000, None, None),
             (None, "der Baum und das Haus", None, None), (504, "中文", None, None)]
    df = spark.createDataFrame(rows, schema)
    got = {r.doc_id: r for r in B.predict(df, B.fit(df)).collect() if r.doc_id is None or r.doc_id >= 500}
    assert [got[d].lang_pred for d in (500, 501, 502, 503, None)] == ["und", "und", "und", "en", "de"]
    assert got[500].score == 0.0 and got[None].held_out and got[504].lang_pred in words
    assert B.predict(df.limit(0), B.fit(df.limit(0))).count() == 0
    nothing = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in B.predict(nothing, B.fit(nothing)).collect()} == {"und"}


def naive(model, text):
    """Scores of a text by plain loops over windows, filters and places."""
    data, votes = [int(model.classes[b]) for b in text.encode()], np.zeros(len(model.labels))
    for at in range(0, len(data), B.LENGTH):
        x = data[at:at + B.LENGTH]
        x += [0] * (B.LENGTH - len(x))
        feature = []
        for k, (w, c) in enumerate(zip(B.WIDTHS, model.conv)):
            for f in range(B.FILTERS):
                best = max(sum(float(c[j, x[i + j], f]) for j in range(w)) for i in range(B.LENGTH - w + 1))
                feature.append(max(best + float(model.bias[k * B.FILTERS + f]), 0.0))
        z = [sum(v * float(model.out[i, k]) for i, v in enumerate(feature)) + float(model.out_bias[k]) for k in range(len(model.labels))]
        e = np.exp(np.array(z) - max(z))
        votes += e / e.sum() * sum(v > 0 for v in x)     # a window counts by its bytes
    return votes / votes.sum()


def test_predictor_against_plain_loops():
    r = np.random.default_rng(3)
    model = B.ByteCnn(["a", "b", "c"], r.integers(1, B.LETTERS, 256).astype(np.uint8), seed=5)
    model.bias[:], model.out_bias[:] = r.normal(0, 0.2, len(model.bias)), r.normal(0, 0.2, 3)
    texts = ["x", "short text", "é" * 100, "one window and more " * 20, "exactly " * 32, "w" * 256, "z" * 257]
    langs, scores = B.predictor(model)(texts)
    for text, lang, score in zip(texts, langs, scores):
        want = naive(model, text)
        assert lang == model.labels[int(want.argmax())] and abs(score - want.max()) < 1e-4


def test_numerals_are_no_letters():
    model = B.ByteCnn(["a", "b"], np.ones(256, np.uint8))
    odd = ["\u00b2 \u00bd \u2460", "\u2167", "12_3", "\u0663", ""]
    assert B.predictor(model)(odd) == (["und"] * 5, [0.0] * 5)
    assert "und" not in B.predictor(model)(["\u00b2x", "\u00aa", "\u4e2d"])[0]


def test_ties_and_repeated_rows(spark):
    model = B.ByteCnn(["a", "b"], np.ones(256, np.uint8))
    model.out[:], model.out_bias[:] = 0, 0
    rows = B.predict(spark.createDataFrame([(1, "word"), (1, "word"), (1, None)], "doc_id long, text string"), model).collect()
    assert sorted((r.lang_pred, r.score) for r in rows) == [("a", 0.5), ("a", 0.5), ("und", 0.0)]
