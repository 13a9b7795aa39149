"""Benchmark decontamination with a distributed positional inverted index (operator 12).

Training texts are dealt into segments of about SEGMENT_WORDS words. A segment
numbers its words in one row, with a gap after each document that no phrase can
bridge, and stores for each term the sorted positions at which it stands: its
posting list, one row of a table in the shared folder. Term counts over the
whole corpus are sums of list lengths.

A test window (some consecutive words of a test item) is looked up in a segment
by intersecting the lists of its terms, each shifted back by the term's offset,
from the term that is rarest in the corpus on: what is left are exactly the
starts of the phrase. Proximity matches are found on the same lists: places where
all of a window's terms stand within SPAN words, in any order.

Windows reach the segments by an equi-join of their terms with the posting
rows. They are dealt into blocks of BLOCK_WINDOWS, so that a group of work, one
segment and one block, is bounded whatever the size of either table. A hot
term, passage or source is spread over the segments it occurs in.

Terms are the words themselves, so matches are exact. Null, empty and wordless
texts have no words and no hits; a null or wordless test item has no window.
Rows with equal ids stay separate documents; equal item ids count as one item,
and items without an id as one. A very long text makes a long segment of its own.
Empty tables give no hits. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfold.sources.tables import staged, table

#: Words of a window; words within which all terms of a window are near one another.
WINDOW, SPAN = 10, 15
#: Unused positions after a document; no window or span may be longer.
GAP = 64
SEGMENT_WORDS, BLOCK_WINDOWS = 1 << 21, 20_000
#: At most so many distinct terms (some 20 bytes each) are sent to the tasks that index; beyond, all terms are indexed.
SENT_TERMS = 1_000_000
#: At most so many window terms (16 bytes each) are broadcast; more are joined by shuffle.
SENT_USES = 2_000_000

#: Bytes of a term, A-Z in lower case; all others separate terms.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: The same for Spark's regex.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

INDEX_SCHEMA = "segment long, ord long, doc_id long, n_words long, term string, n long, positions binary"


def _segments(terms: dict[bytes, int] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, text) to a row per document and a row per segment and term; only of these terms, if given.

    The term '' lists where the segment's documents begin.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, done = TaskContext.get().partitionId() << 32, 0
        names: dict[bytes, int] = {}
        fresh = _Numbers(names) if terms is None else None
        ids, places, starts, docs, at = [], [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal done
            segment = number + done
            done += 1
            n = len(docs)
            yield _batch([segment] * n, [d[0] for d in docs], [d[1] for d in docs], [d[2] for d in docs],
                         [None] * n, [None] * n, pa.nulls(n, pa.binary()))
            if not starts:
                return
            term, place = np.concatenate(ids), np.concatenate(places)
            order = np.argsort(term, kind="stable")
            term, place = term[order], place[order]
            heads = np.flatnonzero(np.diff(term, prepend=-1))
            spelled = list(names) if terms is None else list(terms)
            words = ["", *(spelled[i].decode("utf-8", "replace") for i in term[heads].tolist())]
            bounds = np.concatenate(([0], heads + len(starts), [len(place) + len(starts)]))
            steps = np.diff(np.concatenate((starts, place)), prepend=0)
            steps[bounds[:-1]] = np.concatenate((starts[:1], place[heads]))
            for a in range(0, len(words), 20_000):
                part = bounds[a:a + 20_001]
                data = pa.py_buffer(steps[part[0]:part[-1]].astype(np.uint32).tobytes())
                lists = pa.BinaryArray.from_buffers(pa.binary(), len(part) - 1, [
                    None, pa.py_buffer(((part - part[0]) * 4).astype(np.int32).tobytes()), data])
                m = len(part) - 1
                yield _batch([segment] * m, [None] * m, [None] * m, [None] * m, words[a:a + m], np.diff(part), lists)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = text.as_buffer().to_pybytes().translate(_BYTES).split() if text.is_valid else []
                docs.append((len(starts) if words else None, doc_id, len(words)))
                if words:
                    found = map(fresh.get, words) if terms is None else map(terms.get, words, repeat(-1))
                    own = np.fromiter(found, np.int64, len(words))
                    known = np.flatnonzero(own >= 0)
                    ids.append(own[known])
                    places.append(known + at)
                    starts.append(at)
                    at += len(words) + GAP
                if at >= SEGMENT_WORDS or len(docs) >= 100_000:
                    yield from flush()
                    ids, places, starts, docs, at = [], [], [], [], 0
                    names.clear()
        if docs:
            yield from flush()
    return run


class _Numbers:
    """Numbers terms in the order in which they come."""

    def __init__(self, names: dict[bytes, int]):
        self.names = names

    def get(self, term: bytes) -> int:
        return self.names.setdefault(term, len(self.names))


def _batch(*columns) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
        ["segment", "ord", "doc_id", "n_words", "term", "n", "positions"])


def index_texts(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """The stored index of (doc_id, text); only of the given terms (column term), which then are all that can be looked up."""
    sent = None
    if terms is not None:
        some = terms.select("term").distinct().limit(SENT_TERMS + 1).collect()
        sent = {r[0].encode(): i for i, r in enumerate(some)} if len(some) <= SENT_TERMS else None
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return staged(texts.mapInArrow(_segments(sent), INDEX_SCHEMA))


def documents_of(index: DataFrame) -> DataFrame:
    """A row per document; ord, its number in the segment, is null without words."""
    return index.where("term is null").select("segment", "ord", "doc_id", "n_words")


def windows_of(items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(window, item) and (window, at, term, width): the distinct windows of (item_id, text) and their terms."""
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))
    some = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words.alias("words")).where(F.size("words") > 0)
    cut = staged(some.select("item", F.explode(F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0))), lambda i: F.slice("words", i + 1, size))).alias("words")).distinct())
    known = staged(cut.select("words").distinct().withColumn("window", F.monotonically_increasing_id()))
    return (cut.join(known, "words").select("window", "item"),
            known.select("window", F.size("words").alias("width"), F.posexplode("words").alias("at", "term")))


MATCH_SCHEMA = "segment long, ord long, ranges array<struct<a:long,b:long>>, windows array<long>, near array<long>"


def _near(lists: list[np.ndarray], span: int) -> np.ndarray:
    """Positions of the first list that lie in some run of span words with a position of every other."""
    p = lists[0]
    for q in lists[1:]:
        i = np.searchsorted(q, p - span + 1)
        p = p[(i < len(q)) & (q[np.minimum(i, len(q) - 1)] <= p + span - 1)]
        if not len(p):
            return p
    begin = p[:, None] - np.arange(span)
    whole = np.ones(begin.shape, bool)
    for q in lists[1:]:
        i = np.searchsorted(q, begin)
        whole &= (i < len(q)) & (q[np.minimum(i, len(q) - 1)] < begin + span)
    return p[whole.any(1)]


def _phrase(lists: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Starts that all lists share once each is shifted back by its offset."""
    p = lists[0][1] - lists[0][0]
    for at, q in lists[1:]:
        i = np.searchsorted(q, p + at)
        p = p[(i < len(q)) & (q[np.minimum(i, len(q) - 1)] == p + at)]
        if not len(p):
            break
    return p


def _look_up(span: int) -> Callable[[pa.Table], pa.Table]:
    """The posting rows of a segment, with the windows of a block that use each term, to its matches by document."""
    def run(group: pa.Table) -> pa.Table:
        segment = group.column("segment")[0].as_py()
        group = group.combine_chunks()
        names = group.column("term").to_pylist()
        lists = [np.cumsum(np.frombuffer(x.as_buffer(), np.uint32).astype(np.int64)) for x in group.column("positions")]
        starts = lists[names.index("")]
        often = group.column("often").to_numpy()
        uses = group.column("uses").combine_chunks() if isinstance(group.column("uses"), pa.ChunkedArray) else group.column("uses")
        term = np.repeat(np.arange(len(names)), np.diff(uses.offsets.to_numpy()))
        flat = uses.flatten()
        window, at, width = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("window", "at", "width"))
        # windows all of whose terms occur here, each with its terms from the rarest on
        order = np.lexsort((term, often[term], window))
        window, at, width, term = window[order], at[order], width[order], term[order]
        heads = np.flatnonzero(np.diff(window, prepend=-1))
        found: list[tuple[np.ndarray, int, int]] = []
        close: list[tuple[np.ndarray, int]] = []
        for a, b in zip(heads, np.append(heads[1:], len(window)), strict=True):
            if b - a < width[a]:
                continue
            own = term[a:b].tolist()
            near = _near([lists[t] for t in dict.fromkeys(own)], span)
            if not len(near):
                continue
            close.append((near, window[a]))
            starting = _phrase([(o, lists[t]) for o, t in zip(at[a:b].tolist(), own, strict=True)]) if len(own) <= span else near[:0]
            if len(starting):
                found.append((starting, window[a], width[a]))
        rows: dict[int, tuple[list, set, set]] = {}
        if found:
            p = np.concatenate([x[0] for x in found])
            w, n = (np.repeat([x[k] for x in found], [len(x[0]) for x in found]) for k in (1, 2))
            order = np.lexsort((n, p))
            p, w, n = p[order], w[order], n[order]
            top = np.maximum.accumulate(p + n)
            new = np.append(True, p[1:] > top[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(p)) - 1
            for d, a, b in zip(_doc(starts, p[first]), p[first].tolist(), top[last].tolist(), strict=True):
                rows.setdefault(d, ([], set(), set()))[0].append({"a": a, "b": b})
            for d, x in {*zip(_doc(starts, p), w.tolist(), strict=True)}:
                rows[d][1].add(x)
        for p, x in close:
            for d in {*_doc(starts, p)}:
                rows.setdefault(d, ([], set(), set()))[2].add(int(x))
        docs = sorted(rows)
        return pa.table({
            "segment": pa.array([segment] * len(docs), pa.int64()), "ord": pa.array(docs, pa.int64()),
            "ranges": pa.array([rows[d][0] for d in docs], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
            "windows": pa.array([sorted(rows[d][1]) for d in docs], pa.list_(pa.int64())),
            "near": pa.array([sorted(rows[d][2]) for d in docs], pa.list_(pa.int64()))})
    return run


def _doc(starts: np.ndarray, p: np.ndarray) -> list[int]:
    return (np.searchsorted(starts, p, "right") - 1).tolist()


def match_windows(index: DataFrame, parts: DataFrame, span: int = SPAN) -> DataFrame:
    """Per segment, document and block of windows: ranges of positions that phrases cover, windows found and windows near.

    A window longer than span has no proximity match and is found only as far as span reaches; keep span at the window's width or more.
    """
    parts = staged(parts)
    n = parts.agg(F.countDistinct("window")).first()[0]
    blocks = max(1, -(-n // BLOCK_WINDOWS))
    uses = parts.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks))).groupBy("term", "block").agg(
        F.collect_list(F.struct("window", "at", "width")).alias("uses"))
    none = uses.select(F.lit("").alias("term"), "block", F.slice("uses", F.lit(1), F.lit(0)).alias("uses")).dropDuplicates(["block"])
    often = index.where("term <> ''").join(uses.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("often"))
    side = staged(uses.union(none).join(often, "term", "left").select("term", "block", "uses", F.coalesce("often", F.lit(0).cast("bigint")).alias("often")))
    known = F.broadcast(side) if parts.count() <= SENT_USES else side
    rows = index.where("term is not null").select("segment", "term", "positions").join(known, "term")
    return rows.groupBy("segment", "block").applyInArrow(_look_up(span), MATCH_SCHEMA)


def _covered(ranges):
    """Positions in a list of ranges that may overlap."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    return F.aggregate(F.sort_array(ranges), zero, lambda s, r: F.struct(
        (s["n"] + F.greatest(r["b"] - F.greatest(r["a"], s["end"]), F.lit(0).cast("bigint"))).alias("n"),
        F.greatest(s["end"], r["b"]).alias("end")))["n"]


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, span: int = SPAN) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, items (sorted ids of the items with phrases in it), n_near (items with near windows)."""
    if not 0 < size <= span <= GAP:
        raise ValueError(f"a window has 1 to span words, a span at most {GAP}")
    owners, parts = windows_of(items, size)
    parts = staged(parts)
    index = index_texts(docs, parts.select("term"))
    matches = staged(match_windows(index, parts, span))
    hit = matches.groupBy("segment", "ord").agg(_covered(F.flatten(F.collect_list("ranges"))).alias("n_hit"))

    def whose(column: str) -> DataFrame:
        return matches.select("segment", "ord", F.explode(column).alias("window")).join(owners, "window").select("segment", "ord", "item").distinct()
    names = whose("windows").groupBy("segment", "ord").agg(F.sort_array(F.collect_list("item")).alias("items"))
    near = whose("near").groupBy("segment", "ord").agg(F.count(F.lit(1)).alias("n_near"))
    rows = documents_of(index).join(hit, ["segment", "ord"], "left").join(names, ["segment", "ord"], "left").join(near, ["segment", "ord"], "left")
    zero = F.lit(0).cast("bigint")
    return rows.select("doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"),
                       F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("n_near", zero).alias("n_near"))


def op12_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"), "n_near")
