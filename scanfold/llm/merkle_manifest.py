"""Merkle manifest of a dataset with incremental witnesses (operator 13).

Every document is a leaf. The leaves of a source, in order of doc_id, make a
tree in which every ARITY consecutive nodes become their hash, until one node,
the subroot, remains; the subroots, in order of source, make the tree on top in
the same way. A witness holds, level by level, a node's place in its run and the
digests of the run's other nodes: enough to recompute the root.

1. Leaves are hashed where the texts lie; only digests move on. They are dealt by
   range of (source, doc_id), so a source that holds most rows is spread over
   many tasks; counts per task and source give every leaf its rank.
2. Ranks are cut into blocks of ARITY ** LEVELS leaves, aligned to the tree.
   A task streams through its blocks: each leaf is appended to the open subtrees
   of its block, and whenever a sibling run completes, the witnesses of all leaves
   below are extended by the others' digests.
3. The roots of blocks are further appends: the same step runs on them until each
   source has one node. A leaf's witness is its own followed by that of its
   block's root, and so on, and then that of its subroot.

No task holds more than a block. Results of the steps are written to the shared
folder, so a lost executor costs the reading of files only.

Nulls, an empty text and any length of text are hashed as they are: a null field
as '-'. A null doc_id comes first in its source and is not tampered with; a null
source is a source of its own. Rows with equal doc_id stand in order of their
leaves, equal rows side by side as leaves of their own, each with its own
witness. A table without rows has no result. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanfold.sources.tables import staged, table

ARITY = 3
#: Levels of a block: a block has ARITY ** LEVELS leaves.
LEVELS = 7
BLOCK = ARITY ** LEVELS
DIGEST = 32


def digest(parts: list[bytes]) -> bytes:
    """The hash of digests, which go in as hexadecimal text."""
    return hashlib.sha256(b"".join(p.hex().encode() for p in parts)).digest()


def height(n: int) -> int:
    """Levels of the tree of n leaves."""
    h, reach = 0, 1
    while reach < n:
        h, reach = h + 1, reach * ARITY
    return h


class OpenTree:
    """A tree that grows by appends at its end; witnesses are kept for the leaves below the open runs."""

    def __init__(self):
        self.open: list[list[tuple[bytes, list[int]]]] = []
        self.witnesses: list[bytearray] = []

    def append(self, leaf: bytes) -> None:
        self.witnesses.append(bytearray())
        self._put(0, leaf, [len(self.witnesses) - 1])

    def _put(self, level: int, node: bytes, below: list[int]) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append((node, below))
        if len(self.open[level]) == ARITY:
            self._complete(level)

    def _complete(self, level: int) -> None:
        """Give each node's leaves the digests of its siblings, and the run's hash to the level above."""
        run, self.open[level] = self.open[level], []
        for place, (_, below) in enumerate(run):
            step = bytes([place * ARITY + len(run) - 1]) + b"".join(d for i, (d, _) in enumerate(run) if i != place)
            for leaf in below:
                self.witnesses[leaf] += step
        self._put(level + 1, digest([d for d, _ in run]), [x for _, below in run for x in below])

    def close(self, levels: int) -> bytes:
        """The root once the tree has so many levels; runs that are open are completed as they are."""
        for level in range(levels):
            if level < len(self.open) and self.open[level]:
                self._complete(level)
        return self.open[levels][0][0]


def fold(leaf: bytes, witness: bytes) -> tuple[bytes, list[bytes]]:
    """The root that a leaf and its witness give, and the siblings, from the leaf up and left to right."""
    at, siblings = 0, []
    while at < len(witness):
        place, others = divmod(witness[at], ARITY)
        run = [witness[at + 1 + i * DIGEST:at + 1 + (i + 1) * DIGEST] for i in range(others)]
        siblings += run
        at += 1 + others * DIGEST
        leaf = digest([*run[:place], leaf, *run[place:]])
    return leaf, siblings


GROWN_SCHEMA = "key string, rank long, n long, node binary, witness binary, root boolean"


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, rank, n, node) sorted by key and rank to the same with witnesses, and a row for each block's root."""
    tree, now, rows = None, None, []

    def ended() -> list[tuple]:
        key, block, n = now
        root = tree.close(min(LEVELS, height(n)))
        done = [(*row, bytes(w), False) for row, w in zip(held, tree.witnesses, strict=True)]
        return [*done, (key, block, -(-n // BLOCK), root, None, True)]

    def out() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.bool_())
        names = ["key", "rank", "n", "node", "witness", "root"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "rank", "n", "node")), strict=True):
            at = (row[0], row[1] // BLOCK, row[2])
            if at != now:
                if tree:
                    rows += ended()
                    if len(rows) >= 5_000:
                        yield out()
                        rows = []
                tree, now, held = OpenTree(), at, []
            tree.append(row[3])
            held.append(row)
    if tree:
        rows += ended()
        yield out()


def _ranked(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """rows with rank, a row's number among those of its key in the given order, and n, how many these are.

    Rows of one key may lie in many partitions; equal rows are told apart by a number.
    """
    spark = rows.sparkSession
    many = spark.sparkContext.defaultParallelism
    parts = max(many, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sorting = [key, *order, "tie"]
    numbered = staged(rows.withColumn("tie", F.monotonically_increasing_id()))
    dealt = staged(numbered.repartitionByRange(parts, *sorting).sortWithinPartitions(*sorting).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    counts = dealt.groupBy(key, part.alias("part")).agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("first"))
    own = Window.partitionBy(key)
    before = F.coalesce(F.sum("c").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    offsets = counts.select(key, "part", (before - F.col("first")).alias("shift"), F.sum("c").over(own).alias("n"))
    return dealt.withColumn("part", part).join(offsets, [key, "part"]).withColumn("rank", F.col("at") + F.col("shift")).drop("tie", "at", "part", "shift")


def _witnessed(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(key, rank, n, node) to tables (key, rank, node, witness), one for each step of appends, and (key, node): the roots of the keys."""
    steps, roots = [], None
    while True:
        dealt = nodes.select("key", "rank", "n", "node").repartition("key", F.floor(F.col("rank") / BLOCK)).sortWithinPartitions("key", "rank")
        grown = staged(dealt.mapInArrow(_grow, GROWN_SCHEMA))
        steps.append(grown.where("not root").select("key", "rank", "node", "witness"))
        tops = grown.where("root").select("key", "rank", "n", "node")
        ended = tops.where("n = 1").select("key", "node")
        roots = ended if roots is None else roots.union(ended)
        nodes = tops.where("n > 1")
        if nodes.isEmpty():
            return steps, roots


def _with_ways(steps: list[DataFrame]) -> DataFrame:
    """(key, rank, node, witness): the first step's rows, their witnesses followed by those of the nodes above."""
    rows = steps[-1]
    for below in reversed(steps[:-1]):
        above = rows.select("key", F.col("rank").alias("block"), F.col("witness").alias("more"))
        rows = below.withColumn("block", F.floor(F.col("rank") / BLOCK)).join(above, ["key", "block"], "left").select(
            "key", "rank", "node", F.concat("witness", F.coalesce("more", F.lit(b""))).alias("witness"))
    return rows


def field(value: Column) -> Column:
    """A field as it goes into a leaf."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_of(**changed: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in FIELDS]).cast("binary"), 256))


def source_key(source: Column) -> Column:
    """Never null, and in the order of sources: null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def manifest(docs: DataFrame, tampered_text: Column | None = None) -> DataFrame:
    """Per row of docs: doc_id, leaf, subroot, root, witness, and shown, the leaf with the text as tampered (or the leaf itself)."""
    docs = docs.select(*FIELDS)
    shown = leaf_of() if tampered_text is None else leaf_of(text=tampered_text)
    leaves = docs.select("doc_id", source_key(F.col("source")).alias("key"), leaf_of().alias("node"), shown.alias("shown"))
    ranked = staged(_ranked(leaves, "key", "doc_id", "node", "shown"))
    steps, subroots = _witnessed(ranked)
    subroots = staged(subroots)
    tops = _ranked(subroots.select(F.lit("").alias("key"), F.col("key").alias("source"), "node"), "key", "source")
    tops = staged(tops)
    top_steps, root = _witnessed(tops)
    above = _with_ways(top_steps).select("rank", F.col("witness").alias("top")).join(tops.select("rank", F.col("source").alias("key"), F.col("node").alias("subroot")), "rank").drop("rank")
    ways = _with_ways(steps).select("key", "rank", "witness")
    found = root.select("node").first()
    rows = ranked.select("key", "rank", "doc_id", F.col("node").alias("leaf"), "shown").join(ways, ["key", "rank"]).join(above, "key")
    return rows.select("doc_id", "leaf", "subroot", F.lit(bytes(found[0]) if found else None).cast("binary").alias("root"),
                       F.concat("witness", "top").alias("witness"), "shown")


PROVED_SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proved() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            proofs, folded = [], []
            for leaf, witness in zip(batch.column("shown").to_pylist(), batch.column("witness").to_pylist(), strict=True):
                top, siblings = fold(leaf, witness)
                proofs.append(digest(siblings).hex())
                folded.append(top.hex())
            texts = {c: [x.hex() for x in batch.column(c).to_pylist()] for c in ("leaf", "subroot", "root")}
            kept = [x == y for x, y in zip(folded, texts["root"], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.string()) for x in (*texts.values(), proofs, folded)), pa.array(kept, pa.bool_())],
                ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
    return run


def prove(rows: DataFrame) -> DataFrame:
    """What a manifest's rows fold to: hexadecimal digests, and whether the shown leaf belongs to the root."""
    return rows.withColumn("doc_id", F.col("doc_id").cast("bigint")).mapInArrow(_proved(), PROVED_SCHEMA)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return prove(manifest(table(spark, sf_dir, "documents"), text))
