"""BPE encoding and decoding with reuse of content-defined chunks (operator 6).

A rolling hash over bytes cuts each text where its content says so, so that
texts that share a passage share its chunks wherever it stands. Rows are dealt
by their smallest chunk hash: texts with much in common meet in one task, and
Spark splits what is too much for one. A task keeps the ids of chunks it has
encoded (a bounded number of bytes, longest unused first to go) and takes a
chunk that it meets again from there.

Ids of neighbouring chunks are not simply joined: a window that reaches some
words into both is encoded anew. It agrees if it begins with the left chunk's
own ids and ends with the right chunk's; what lies between is the join.
Otherwise the window grows, in the end to the whole text. Its edges lie before
a single blank between visible ASCII characters, where byte-level BPE always
begins a new piece, so agreement is exact. Chunks without such places are
merged with the next. Texts are compressed while they move.

A null text counts as empty and has no ids; repeated rows are encoded each for
themselves; other columns play no part.
"""

from __future__ import annotations

import functools
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfold.llm.bpe import Bpe, bpe, default_path
from scanfold.sources.tables import table

#: A chunk ends where BITS bits of the hash are 0: 1,024 bytes on average. Shorter ones than LEAST are not cut off.
BITS, LEAST = 10, 256
CACHE_BYTES = 48 << 20
_GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks of a UTF-8 text; the hash sees 16 bytes, and no character is split."""
    raw = np.frombuffer(data, np.uint8)
    h = _GEAR[raw]
    for step in (1, 2, 4, 8):
        older = h[:-step].copy()
        h[step:] += older << np.uint32(step)
    ends = np.flatnonzero(h[15:] >> np.uint32(32 - BITS) == 0) + 16
    ends = ends[ends < len(raw)]
    ends = ends[(raw[ends] & 0xC0) != 0x80]
    out, last = [], 0
    for e in ends.tolist():
        if e - last >= LEAST:
            out.append(e)
            last = e
    return [*out, len(data)]


def _safe(data: bytes, at: int) -> bool:
    return 0x21 <= data[at - 1] <= 0x7E and 0x21 <= data[at + 1] <= 0x7E


def safe_places(data: bytes, begin: int, end: int, count: int, from_end: bool) -> list[int]:
    """The first or last places of single blanks between visible ASCII characters, in ascending order."""
    out, at = [], end - 1 if from_end else begin
    while len(out) < count:
        at = data.rfind(b" ", begin + 1, at) if from_end else data.find(b" ", at + 1, end - 1)
        if at < 0:
            break
        if _safe(data, at):
            out.append(at)
    return out[::-1] if from_end else out


class Chunks:
    """Ids of chunks, kept by content up to a number of bytes."""

    def __init__(self, coder: Bpe, most: int = CACHE_BYTES):
        self.coder, self.most, self.held, self.kept = coder, most, 0, OrderedDict()
        self.asked = self.reused = 0

    def ids(self, chunk: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and where in the chunk's bytes each ends."""
        self.asked += 1
        if (found := self.kept.get(chunk)) is not None:
            self.reused += 1
            self.kept.move_to_end(chunk)
            return found
        ids = self.coder.encode(chunk.decode())
        found = ids, np.cumsum(self.coder.lengths[ids])
        self.kept[chunk] = found
        self.held += len(chunk) + 12 * len(ids)
        while self.held > self.most:
            old, (x, _) = self.kept.popitem(last=False)
            self.held -= len(old) + 12 * len(x)
        return found


def encode(text: str, chunks: Chunks) -> np.ndarray:
    """Ids of a text, made from its chunks."""
    data = text.encode()
    spans, begin = [], 0
    for end in boundaries(data):
        if end - begin and len(safe_places(data, begin, end, 4, False)) == 4:
            spans.append((begin, end))
            begin = end
    if begin < len(data):                                      # what is left over joins the last chunk
        spans = [*spans[:-1], (spans[-1][0], len(data))] if spans else [(0, len(data))]
    if len(spans) < 2:
        return chunks.ids(data)[0]
    coded = [chunks.ids(data[a:b]) for a, b in spans]
    out, done = [], 0                                          # done: ids of the current chunk that the join before took
    for k, ((a, b), (c, d)) in enumerate(zip(spans, spans[1:])):
        left, right = coded[k], coded[k + 1]
        reach = 2
        while True:
            before, after = safe_places(data, a, b, reach, True), safe_places(data, c, d, reach, False)
            i, j = (int(np.searchsorted(left[1], x - a)) + 1 for x in (before[0], before[-1]))
            m, n = (int(np.searchsorted(right[1], x - c)) + 1 for x in (after[0], after[-1]))
            window = chunks.coder.encode(data[before[0]:after[-1]].decode())
            if i >= done and np.array_equal(window[:j - i], left[0][i:j]) and np.array_equal(
                    window[len(window) - (n - m):], right[0][m:n]):
                break
            if len(before) < reach and len(after) < reach:
                return chunks.coder.encode(text)
            reach *= 2
        out += [left[0][done:j], window[j - i:len(window) - (n - m)]]
        done = m
    return np.concatenate([*out, coded[-1][0][done:]])


@functools.lru_cache(2)
def worker_chunks(path: str) -> Chunks:
    """One per worker process; tasks that follow one another share it."""
    return Chunks(bpe(path))


def route(text: bytes) -> int:
    """Smallest hash of a text's chunks."""
    import xxhash

    ends = boundaries(text)
    return min(xxhash.xxh64_intdigest(text[a:b]) for a, b in zip([0, *ends], ends)) >> 1


def _routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to doc_id, route and the text compressed, which is what moves."""
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts = [x.as_py() for x in part.column(1)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([route(t) if t else 0 for t in texts], pa.int64()),
                 pa.array([press.compress(t) for t in texts], pa.binary())], ["doc_id", "route", "packed"])


def _coded(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        chunks, unpress = worker_chunks(path), zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [unpress.decompress(t.as_py()).decode() for t in part.column(1)]
                ids = [encode(t, chunks).astype("<u4") if t else np.empty(0, "<u4") for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in ids], pa.binary())],
                                                 ["doc_id", "ids"])
    return run


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (4 bytes each, little-endian) of each row's text."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    dealt = rows.mapInArrow(_routed, "doc_id long, route long, packed binary").hint("rebalance", "route")
    return dealt.select("doc_id", "packed").mapInArrow(_coded(path or default_path()), "doc_id long, ids binary")


def decode_ids(coded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and the decoded text."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [coder.decode(np.frombuffer(x.as_py(), "<u4")) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())],
                                                 ["doc_id", "ids", "text"])
    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def op6_chunk_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decode_ids(encode_documents(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
