"""Mixture-controlled packing (operator 5).

Documents are encoded, closed with an end id, and join the queue of their
source. Windows of WINDOW tokens are filled by deficit round-robin over the
queues: each slot goes to the queue that is furthest behind its target share
(by the ratio (2 * sent + 1) / target; ties to the lower queue), and within a
window the queues' parts stand one after the other. So every window holds the
target proportions to within a token, the deficits pass from window to window,
and a queue that has run dry leaves its share to the others. With the default
targets, the corpus's own shares, all queues last until the end; only the last
window can be short.

The deficits after any number of slots have a closed form, the number of tokens
that each queue has sent by then. So no window waits for another: each task
knows where its documents stand in their queues (sums over tasks and sources,
small tables) and works out alone which windows they fill, with the deficits
that all earlier windows and partitions leave. Texts and ids are not shuffled
or gathered by source, and a source with a third of all rows changes nothing.

Sources beyond MOST_QUEUES - 1, by tokens, share the last queue and its pooled
share. A null or empty text is the end id alone; null sources are a source of
their own; repeated rows are packed each for themselves; other columns play no
part.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanfold.llm.bpe import bpe, default_path
from scanfold.sources.tables import shared_folder, table

WINDOW = 2048
END = 1
MOST_QUEUES = 64
CODED = "doc_id long, source string, task int, before long, n long, wide boolean, ids binary"
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, source string, ids binary"


def _encoded(path: str, end: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, source, text) to ids, with the tokens that the task has given the same source before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task, sent = bpe(path), TaskContext.get().partitionId(), {}
        kind = np.dtype("<u2") if coder.size <= 1 << 16 else np.dtype("<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sources, before, n, ids = part.column(1).to_pylist(), [], [], []
                for source, text in zip(sources, part.column(2)):
                    row = np.append(coder.encode(text.as_py() or ""), np.uint32(end)).astype(kind)
                    before.append(sent.get(source, 0))
                    sent[source] = before[-1] + len(row)
                    n.append(len(row))
                    ids.append(row.tobytes())
                rows = len(n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([task] * rows, pa.int32()), pa.array(before, pa.int64()),
                     pa.array(n, pa.int64()), pa.array([kind.itemsize == 4] * rows, pa.bool_()), pa.array(ids, pa.binary())],
                    ["doc_id", "source", "task", "before", "n", "wide", "ids"])
    return run


class Mixture:
    """The order in which queues send their tokens: token a of queue q at (2 a + 1) / target, ties to the lower queue."""

    def __init__(self, tokens: list[int], targets: list[float]):
        self.tokens = np.array(tokens, np.int64)
        self.targets = np.array(targets, np.float64)

    def _at(self, sent: np.ndarray) -> np.ndarray:
        return (2.0 * sent + 1.0) / self.targets

    def _upto(self, level: np.ndarray) -> np.ndarray:
        """Tokens of each queue whose place is at most a level; level: (m,) gives (m, queues)."""
        level = level[:, None]
        n = np.clip(np.floor((level * self.targets + 1.0) / 2.0), 0, self.tokens).astype(np.int64)
        n -= (n > 0) & (self._at(n - 1) > level)
        n += (n < self.tokens) & (self._at(n) <= level)
        return n

    def rank(self, queue: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Slots filled before token `place` of `queue`."""
        level = (2.0 * place + 1.0) / self.targets[queue]
        n = self._upto(level)
        tied = (n > 0) & (self._at(n - 1) == level[:, None]) & (np.arange(len(self.tokens)) > queue[:, None])
        return n.sum(1) - tied.sum(1) - 1

    def sent(self, slots: np.ndarray) -> np.ndarray:
        """Tokens of each queue among the first slots: (m,) gives (m, queues)."""
        slots = np.minimum(slots, self.tokens.sum())
        near, width = 2.0 * slots / self.targets.sum(), 4.0 * len(self.tokens) / self.targets.sum()
        low, high = np.maximum(near - width, 0.0), near + width
        low[self._upto(low).sum(1) > slots] = 0.0
        high[self._upto(high).sum(1) < slots] = self._at(self.tokens).max()
        for _ in range(200):
            middle = (low + high) / 2
            wide = (middle > low) & (middle < high) & (slots - self._upto(low).sum(1) > 2)
            if not wide.any():
                break
            below = self._upto(middle).sum(1) <= slots
            low[wide & below], high[wide & ~below] = middle[wide & below], middle[wide & ~below]
        n = self._upto(low)
        n[low == 0.0] = 0
        while (open_ := np.flatnonzero(slots - n.sum(1))).size:
            following = np.where(n[open_] < self.tokens, self._at(n[open_]), np.inf)
            n[open_, following.argmin(1)] += 1
        return n


def _cut(mixture: Mixture, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, source, queue, place, n, wide, ids) to pieces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                queue, place, n = (part.column(k).to_numpy().astype(np.int64) for k in (2, 3, 4))
                first, last = (mixture.rank(queue, x) // window for x in (place, place + n - 1))
                counts = last - first + 1
                row = np.repeat(np.arange(len(n)), counts)
                seq = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                needed = np.unique(np.concatenate([seq, seq + 1]))
                sent = mixture.sent(needed * window)
                i, j = np.searchsorted(needed, seq), np.searchsorted(needed, seq + 1)
                q, own = queue[row], np.arange(len(row))
                begins, ends = sent[i, q], sent[j, q]
                lo, hi = np.maximum(place[row], begins), np.minimum((place + n)[row], ends)
                lead = np.cumsum(sent[j] - sent[i], 1)[own, q] - (ends - begins)
                keep = hi > lo
                row, seq, lo, hi, begins, lead = (x[keep] for x in (row, seq, lo, hi, begins, lead))
                start, length = lo - place[row], hi - lo
                codes = [np.frombuffer(b, "<u4" if w else "<u2").astype("<u4") for b, w in
                         zip(part.column(6).to_pylist(), part.column(5).to_pylist())]
                ids = [codes[r][s:s + m].tobytes() for r, s, m in zip(row.tolist(), start.tolist(), length.tolist())]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), pa.array(start), pa.array(length), pa.array(n[row]), pa.array(seq),
                     pa.array(lead + lo - begins), part.column(1).take(take), pa.array(ids, pa.binary())],
                    ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "source", "ids"])
    return run


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end: int = END,
         targets: dict[str, float] | None = None, source_col: str = "source") -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, sequence_id, offset, source, ids (4 bytes each).

    ``targets`` gives sources their weights in a window; sources it doesn't name
    share the last queue with weight ``targets[""]``, or their share of tokens.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"), "text")
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    rows.mapInArrow(_encoded(path or default_path(), end), CODED).write.option("compression", "zstd").parquet(folder)
    coded = spark.read.parquet(folder)
    tasks = coded.groupBy("source", "task").agg(F.sum("n").alias("n"))
    totals = tasks.groupBy("source").agg(F.sum("n").alias("tokens"))
    named = totals.where(F.col("source").isin(list(targets))) if targets else totals
    top = named.orderBy(F.desc("tokens"), "source").limit(MOST_QUEUES - 1).collect()       # a fixed number of rows
    everything = totals.agg(F.sum("tokens")).first()[0] or 0
    own = [r["source"] for r in top]
    rest = everything - sum(r["tokens"] for r in top)
    tokens = [r["tokens"] for r in top] + [rest] * (rest > 0)
    weights = [float(targets[s]) for s in own] + [float(targets.get("", rest))] * (rest > 0) if targets else [float(t) for t in tokens]
    number = F.lit(len(own))
    for k, s in enumerate(own):
        number = F.when(F.col("source").eqNullSafe(F.lit(s)), F.lit(k)).otherwise(number)
    # where each source begins in its queue, and each task's rows in their source
    alone = Window.partitionBy("queue").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    begin = totals.withColumn("queue", number).select("queue", F.col("source").alias("whose"), F.coalesce(
        F.sum("tokens").over(alone), F.lit(0)).alias("base"))
    earlier = Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    place = tasks.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    name = lambda c: F.struct(F.col(c).isNull(), F.coalesce(F.col(c), F.lit("")))
    place = place.join(begin, name("source") == name("whose")).select(
        F.col("source").alias("of"), F.col("task").alias("by"), "queue", (F.col("base") + F.col("earlier")).alias("begin"))
    found = coded.join(place, (name("source") == name("of")) & (F.col("task") == F.col("by")))
    return found.select("doc_id", "source", "queue", (F.col("begin") + F.col("before")).alias("place"), "n", "wide", "ids").mapInArrow(
        _cut(Mixture(tokens, weights), window), PIECES)


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([zlib.crc32(x) for x in batch.column(
            batch.num_columns - 1).to_pylist()], pa.int64())], [*batch.schema.names[:-1], "ids_crc32"])


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with a checksum instead of their ids."""
    return pieces.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids").mapInArrow(
        _crc, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents")))
