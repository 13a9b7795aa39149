"""Language identification by a byte convolutional network (operator 10).

A text's UTF-8 bytes are cut into windows of LENGTH bytes, the last one padded.
Filters of several widths slide over a window's bytes; each filter's largest
response is kept, and a softmax over these gives the languages' probabilities.
A document's score for a language is the mean over its windows, weighted by
their bytes; the whole text is read.

The network is trained in numpy on the driver, on at most CELLS * PER_CELL
documents of each language and WINDOWS windows of each, chosen by a hash of
text; this bound is the only sample. Bytes outside the LETTERS - 2 most frequent
of the training windows share a class. Widths, filters and steps are parameters.

A null text or one without a letter is "und" with score 0, as is everything if
there is nothing to learn from. Rows of equal text are predicted alike. Only
text is an input of a prediction; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanfold.sources.tables import table

LENGTH, LETTERS = 256, 64
WIDTHS, FILTERS = (2, 3, 4), 8
CELLS, PER_CELL, WINDOWS = 64, 8, 4
EPOCHS, BATCH, RATE = 14, 64, 0.01


class ByteCnn:
    """Widths of filters over byte classes, max pooling, softmax."""

    def __init__(self, labels: list[str], classes: np.ndarray, seed: int = 7):
        r = np.random.default_rng(seed)
        self.labels, self.classes = labels, classes
        self.conv = [r.normal(0, 0.3, (w, LETTERS, FILTERS)).astype(np.float32) for w in WIDTHS]
        for c in self.conv:
            c[:, 0] = 0                                        # class 0 is padding
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = r.normal(0, 0.3, (len(self.bias), len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)

    def responses(self, x: np.ndarray) -> list[np.ndarray]:
        """Per width: response of each filter at each place of windows x (rows, LENGTH)."""
        pairs = x[:, :-1].astype(np.int32) * LETTERS + x[:, 1:]
        out = []
        for k, (w, c) in enumerate(zip(WIDTHS, self.conv)):
            places = x.shape[1] - w + 1
            total = None
            for j in range(0, w - 1, 2):
                both = (c[j][:, None] + c[j + 1][None]).reshape(LETTERS * LETTERS, FILTERS)
                part = both.take(pairs[:, j:j + places], axis=0)
                total = part if total is None else np.add(total, part, out=total)
            if w % 2:
                total += c[w - 1].take(x[:, w - 1:w - 1 + places], axis=0)
            out.append(total)
        return out

    def features(self, x: np.ndarray) -> np.ndarray:
        pooled = np.concatenate([r.max(1) for r in self.responses(x)], 1)
        return np.maximum(pooled + self.bias, 0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.features(x) @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 11) -> None:
        """Adam over mini-batches; windows are cut to random lengths, so short texts are learned too."""
        r = np.random.default_rng(seed)
        values = [*self.conv, self.bias, self.out, self.out_bias]
        moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
        weight = len(y) / len(self.labels) / np.maximum(np.bincount(y, minlength=len(self.labels)), 1)     # languages count alike
        step = 0
        for _ in range(EPOCHS):
            order = r.permutation(len(x))
            for at in range(0, len(order), BATCH):
                rows = order[at:at + BATCH]
                cut = np.where(r.random(len(rows)) < 0.5, LENGTH, r.integers(8, LENGTH + 1, len(rows)))
                b = np.where(np.arange(LENGTH) < cut[:, None], x[rows], 0)
                step += 1
                for v, g, (m, s) in zip(values, self._gradients(b, y[rows], weight[y[rows]]), moments):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    v -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)

    def _gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        responses = self.responses(x)
        best = [r.argmax(1) for r in responses]
        pooled = np.concatenate([np.take_along_axis(r, b[:, None], 1)[:, 0] for r, b in zip(responses, best)], 1) + self.bias
        feature = np.maximum(pooled, 0)
        z = feature @ self.out + self.out_bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= (weight / len(y))[:, None].astype(np.float32)
        back = (p @ self.out.T) * (pooled > 0)
        grads = []
        for k, (w, c, b) in enumerate(zip(WIDTHS, self.conv, best)):
            g, part = np.zeros_like(c), back[:, k * FILTERS:(k + 1) * FILTERS]
            for j in range(w):
                letter = np.take_along_axis(x, b + j, 1)
                np.add.at(g[j], (letter, np.arange(FILTERS)[None]), part)
            g[:, 0] = 0
            grads.append(g)
        return [*grads, back.sum(0), feature.T @ p, p.sum(0)]


def windows(data: bytes, classes: np.ndarray) -> np.ndarray:
    """Byte classes of a text's windows, the last one padded with class 0."""
    raw = classes[np.frombuffer(data, np.uint8)]
    return np.pad(raw, (0, -len(raw) % LENGTH)).reshape(-1, LENGTH)


def byte_classes(texts: list[bytes]) -> np.ndarray:
    """Class of each byte: 1 to LETTERS - 2 for the most frequent, LETTERS - 1 for the rest; capitals as small letters."""
    count = np.bincount(np.frombuffer(b"".join(texts).lower(), np.uint8), minlength=256)
    out = np.full(256, LETTERS - 1, np.uint8)
    for k, b in enumerate(np.argsort(-count, kind="stable")[:LETTERS - 2]):
        out[b] = k + 1
    out[65:91] = out[97:123]
    return out


def has_letter(text: str) -> bool:
    """A character of the letter classes, as \\p{L} has them; digits and numerals of any kind aren't letters."""
    return any(map(str.isalpha, text))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def sample(docs: DataFrame) -> list[tuple[str, bytes]]:
    """At most CELLS * PER_CELL texts of each language, by hash; each task sends no more than that either."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    keyed = known.select("lang", "text", F.xxhash64("text", F.lit(3)).alias("h"))
    rank = F.row_number().over(Window.partitionBy("lang", F.pmod("h", F.lit(CELLS))).orderBy("h", "text"))
    rows = keyed.withColumn("rank", rank).where(F.col("rank") <= PER_CELL).select("lang", "text", "h")
    # of a long text, WINDOWS pieces that lie evenly; 3 bytes a character at most are read again below
    size = F.char_length("text")
    pieces = F.when(size <= LENGTH * WINDOWS, F.array("text")).otherwise(F.transform(
        F.sequence(F.lit(0), F.lit(WINDOWS - 1)), lambda k: F.substring("text", (F.floor(
            (size - LENGTH) * k / (WINDOWS - 1)) + 1).cast("int"), F.lit(LENGTH))))
    found = rows.select("lang", "h", F.posexplode(pieces).alias("at", "piece")).collect()
    return [(r["lang"], r["piece"].encode()) for r in sorted(found, key=lambda r: (r["lang"], r["h"], r["at"], r["piece"]))]


def fit(docs: DataFrame) -> ByteCnn | None:
    rows = sample(docs)
    if not rows:
        return None
    labels = sorted({lang for lang, _ in rows})
    model = ByteCnn(labels, byte_classes([t for _, t in rows]))
    cut = [(labels.index(lang), w) for lang, t in rows for w in windows(t, model.classes)[:WINDOWS]]
    model.train(np.array([w for _, w in cut]), np.array([k for k, _ in cut]))
    return model


def predictor(model: ByteCnn | None, block: int = 128) -> Callable[[list[str | None]], tuple[list[str], list[float]]]:
    """Texts to languages and scores, window batch by window batch."""
    def run(texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        rows = [i for i, t in enumerate(texts) if model and t and has_letter(t)]
        for at in range(0, len(rows), 100):
            part = rows[at:at + 100]
            data = [texts[i].encode() for i in part]
            cut = [windows(d, model.classes) for d in data]
            x = np.concatenate(cut)
            p = np.concatenate([model.probabilities(x[a:a + block]) for a in range(0, len(x), block)])
            p *= (x > 0).sum(1, keepdims=True)
            starts = np.cumsum([0, *(len(c) for c in cut[:-1])])
            total = np.add.reduceat(p.astype(np.float64), starts, 0)
            total /= total.sum(1, keepdims=True)
            for i, row in zip(part, total):
                k = int(row.argmax())
                langs[i], scores[i] = model.labels[k], float(min(row[k], 1.0))
        return langs, scores
    return run


def predict(docs: DataFrame, model: ByteCnn | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row."""
    guess = predictor(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                langs, scores = guess(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()),
                                                  pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op10_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
