"""Whitening of embeddings with distributed block matrices (operator 11).

Entries become integers, x = floor(64 * c) + 1,000,000, so that sums are exact.
Rows of one length form a space; the spaces are whitened each on its own.

1. The fit list is each distinct x once. Its count n and sums S are added up
   exactly; a row's entries are centred before anything is multiplied.
2. Centred rows are indexed and laid into blocks of a tall BlockMatrix A. A block
   holds rows of one file of the written table and is filled up with zero rows,
   which add nothing, so blocks need no shuffle. The scatter is A' A, its middle
   dimension split over many tasks; it has no more entries than columns squared.
3. eigh of the scatter / n gives the components. Those whose eigenvalue is zero up
   to rounding have no scale and are left out: a space whose fit list has one
   vector has no components at all.
4. All rows, not only distinct ones, are projected by a second multiplication. A
   product of a tall matrix would run in few tasks, so its blocks are laid out as
   a square grid, and the whitening matrix repeats along the diagonal.
5. The covariance of the whitened fit list, computed like that in step 2, gives
   the largest departure from the identity.

The first and the last step see every row; nothing is sampled. A vector that a
third of the rows share costs no more than others: it is added up before the
shuffle, and projected where it lies.

Dropped are rows whose vector is null or holds a null, NaN or infinite entry; an
empty vector has no components and so no rows. Entries beyond 2 ** 34 count as
that. Null and repeated ids are rows as others. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from scanfold.sources.tables import staged, table

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Largest entry that counts as it is; its sums and products fit the integers used.
LARGEST = float(1 << 34)
#: Entries of a block (8 bytes each), and bytes of blocks that a task of a multiplication gets.
BLOCK_ENTRIES, TASK_BYTES = 1 << 16, 64 << 20

Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

BLOCKS = StructType([StructField("at", StructType([StructField("i", LongType()), StructField("j", LongType())])), StructField("block", MatrixUDT())])
_AT = pa.struct([("i", pa.int64()), ("j", pa.int64())])
_BLOCK = pa.struct([("type", pa.int8()), ("numRows", pa.int32()), ("numCols", pa.int32()), ("colPtrs", pa.list_(pa.int32())),
                    ("rowIndices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64())), ("isTransposed", pa.bool_())])


def entries(vector: Column) -> Column:
    """Integers for a vector's entries; null for a vector that is left out."""
    c = F.transform(vector, lambda v: v.cast("double"))
    odd = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    bounded = lambda v: F.least(F.greatest(v, F.lit(-LARGEST)), F.lit(LARGEST))
    return F.when(~odd, F.transform(c, lambda v: F.floor(bounded(v) * SCALE).cast("bigint") + SHIFT))


@dataclass(frozen=True)
class Layout:
    """How the rows of a written table lie in blocks: part p has counts[p] rows, from block starts[p] on."""

    width: int
    height: int                 # rows of a block
    parts: dict[int, int]       # a file's number in the table to p
    starts: np.ndarray
    counts: np.ndarray
    blocks: int

    @staticmethod
    def of(rows: DataFrame, width: int) -> Layout:
        """For rows numbered as they were written (column rid): one count for each file."""
        found = rows.groupBy(F.shiftright("rid", 33).alias("part")).agg(F.count(F.lit(1)).alias("c")).collect()
        counts = np.array([r["c"] for r in found], np.int64)
        height = max(16, BLOCK_ENTRIES // width)
        each = -(-counts // height)
        return Layout(width, height, {r["part"]: p for p, r in enumerate(found)}, np.cumsum(each) - each, counts, int(each.sum()))

    def place(self, rid: np.ndarray) -> np.ndarray:
        """Row indices in the matrix."""
        p = np.array([self.parts[x] for x in (rid >> 33).tolist()], np.int64)
        return self.starts[p] * self.height + (rid & ((1 << 33) - 1))

    def filled(self, block: int) -> int:
        """Rows of a block that aren't filling."""
        p = np.searchsorted(self.starts, block, "right") - 1
        return int(min(self.height, self.counts[p] - (block - self.starts[p]) * self.height))

    def tasks(self, least: int) -> int:
        return max(least, -(-self.blocks * self.height * self.width * 8 // TASK_BYTES))


@dataclass(frozen=True)
class Centre:
    """Count and sums of the fit list; the mean is kept as a whole number and a rest, so differences don't round."""

    n: int
    sums: list[int]

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole) - rest

    def deviations(self, x: np.ndarray) -> list[Decimal | None]:
        """Sums of (n * x - S) ** 2, exact; None beyond 38 digits."""
        whole, rest = [s // self.n for s in self.sums], [s % self.n for s in self.sums]
        near = x - np.array(whole, np.int64)
        if self.n * (int(np.abs(near).max(initial=0)) + 1) < int((2 ** 62 // x.shape[1]) ** 0.5):
            d = near * self.n - np.array(rest, np.int64)
            found = (d * d).sum(1).tolist()
        else:
            d = near.astype(object) * self.n - np.array(rest, object)
            found = (d * d).sum(1).tolist()
        return [Decimal(v) if v < 10 ** 38 else None for v in found]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _totals(width: int) -> Batches:
    """Per task: how many rows, and the sums of their entries as text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * width
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            for a in range(0, len(x), 1 << 20):                     # so many entries of the largest size add up in 64 bits
                sums = [s + int(v) for s, v in zip(sums, x[a:a + (1 << 20)].sum(0), strict=True)]
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int32()), pa.array([str(v) for v in (n, *sums)])], ["at", "total"])
    return run


def _centre(fit: DataFrame, width: int) -> Centre:
    found = fit.mapInArrow(_totals(width), "at int, total string").groupBy("at").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("at").collect()
    return Centre(int(found[0]["total"]), [int(r["total"]) for r in found[1:]])


def _block_batch(keys: list[tuple[int, int]], blocks: list[np.ndarray]) -> pa.RecordBatch:
    """Blocks by their places; a matrix of MLlib is stored by columns."""
    values = np.concatenate([b.ravel(order="F") for b in blocks])
    ends = np.cumsum([0, *(b.size for b in blocks)])
    n, empty = len(blocks), pa.nulls(len(blocks), pa.list_(pa.int32()))
    matrix = pa.StructArray.from_arrays([
        pa.array([1] * n, pa.int8()), pa.array([b.shape[0] for b in blocks], pa.int32()), pa.array([b.shape[1] for b in blocks], pa.int32()), empty, empty,
        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values)), pa.array([False] * n)], fields=list(_BLOCK))
    at = pa.StructArray.from_arrays([pa.array([k[x] for k in keys], pa.int64()) for x in (0, 1)], fields=list(_AT))
    return pa.RecordBatch.from_arrays([at, matrix], ["at", "block"])


def _blocks(layout: Layout, centre: Centre, columns: int) -> Batches:
    """(rid, x) to blocks of centred rows, block t at place (t // columns, t % columns).

    A file that two tasks read gives two parts of a block, each with zeros for the other's rows: products add up to the same.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, None
        for batch in batches:
            at = layout.place(batch.column("rid").to_numpy())
            rows = centre.centred(_matrix(batch.column("x"), layout.width))
            number = at // layout.height
            heads = np.flatnonzero(np.diff(number, prepend=-1))
            for a, b in zip(heads, np.append(heads[1:], len(at)), strict=True):
                if number[a] != now:
                    if block is not None:
                        yield _block_batch([divmod(now, columns)], [block])
                    now, block = int(number[a]), np.zeros((layout.height, layout.width))
                block[at[a:b] % layout.height] = rows[a:b]
        if block is not None:
            yield _block_batch([divmod(now, columns)], [block])
    return run


def _block_matrix(blocks: DataFrame, height: int, width: int, rows: int, columns: int) -> BlockMatrix:
    """A BlockMatrix of a table of places and blocks: what BlockMatrix does with an RDD, without rows in Python."""
    return BlockMatrix(callMLlibFunc("createBlockMatrix", blocks, height, width, rows, columns), height, width)


def _table_of(matrix: BlockMatrix) -> DataFrame:
    found = callMLlibFunc("getMatrixBlocks", matrix._java_matrix_wrapper._java_model)
    return found.select(F.col("_1._1").cast(IntegerType()).alias("i"), F.col("_1._2").alias("j"), F.col("_2").alias("block"))


def _scatter(tall: BlockMatrix, splits: int) -> np.ndarray:
    """A' A; the sum over blocks is split, which MLlib offers as a further argument of multiply that Python's method doesn't pass."""
    left = tall.transpose()
    product = left._java_matrix_wrapper.call("multiply", tall._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, tall.colsPerBlock, tall.colsPerBlock).toLocalMatrix().toArray()


def _repeated(whitening: np.ndarray) -> Batches:
    """A row for each diagonal place to the whitening matrix there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in batch.column(0).to_pylist():
                yield _block_batch([(j, j)], [whitening])
    return run


def _numbers(batch: pa.RecordBatch, columns: int) -> Iterator[tuple[int, np.ndarray]]:
    """Block numbers and blocks of a table of places and blocks."""
    block = batch.column("block")
    for k, (i, j) in enumerate(zip(batch.column("i").to_pylist(), batch.column("j").to_pylist(), strict=True)):
        m = block[k]
        order = "C" if m["isTransposed"].as_py() else "F"
        values = m["values"].values.to_numpy(zero_copy_only=False)
        yield i * columns + j, values.reshape((m["numRows"].as_py(), m["numCols"].as_py()), order=order)


def _rows_of(layout: Layout, columns: int) -> Batches:
    """Blocks to (place, whitened): their rows without the filling."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, block in _numbers(batch, columns):
                n, k = layout.filled(t), block.shape[1]
                values = pa.array(np.ascontiguousarray(block[:n]).ravel())
                ends = pa.array(np.arange(0, n * k + 1, k), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) + t * layout.height), pa.ListArray.from_arrays(ends, values)], ["place", "whitened"])
    return run


def _project(rows: DataFrame, layout: Layout, centre: Centre, whitening: np.ndarray) -> tuple[DataFrame, int]:
    """A table of the projected rows' blocks, and the columns of the grid that they lie in."""
    side = int(np.ceil(np.sqrt(layout.blocks)))
    k = whitening.shape[1]
    grid = _block_matrix(rows.mapInArrow(_blocks(layout, centre, side), BLOCKS), layout.height, layout.width,
                         -(-layout.blocks // side) * layout.height, side * layout.width)
    spark = rows.sparkSession
    diagonal = spark.range(0, side, 1, layout.tasks(spark.sparkContext.defaultParallelism)).mapInArrow(_repeated(whitening), BLOCKS)
    return _table_of(grid.multiply(_block_matrix(diagonal, layout.width, k, side * layout.width, side * k))), side


def _covariance_error(blocks: DataFrame, side: int, layout: Layout, centre: Centre, k: int) -> float:
    """Largest absolute entry of the covariance of the projected fit list minus the identity."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, block in _numbers(batch, side):
                yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(block.sum(0))], ["at", "total"])

    found = blocks.mapInArrow(sums, "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).orderBy("at").collect()
    mean = np.array([r["total"] for r in found]) / centre.n

    def tall(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, block in _numbers(batch, side):
                n = layout.filled(t)
                yield _block_batch([(t, 0)], [np.vstack((block[:n] - mean, block[n:]))])

    matrix = _block_matrix(blocks.mapInArrow(tall, BLOCKS), layout.height, k, layout.blocks * layout.height, k)
    return float(np.abs(_scatter(matrix, layout.tasks(1)) / centre.n - np.eye(k)).max())


def _measured(layout: Layout, centre: Centre) -> Batches:
    """(vec_id, rid, x) to places and deviations."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = centre.deviations(_matrix(batch.column("x"), layout.width))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(layout.place(batch.column("rid").to_numpy())),
                                                  pa.array(found, pa.decimal128(38, 0))], ["vec_id", "place", "deviation"])
    return run


RESULT = "vec_id long, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"


def _whiten_space(rows: DataFrame, width: int, components: int) -> DataFrame | None:
    rows = staged(rows.withColumn("rid", F.monotonically_increasing_id()))
    fit = staged(rows.select("x").distinct().withColumn("rid", F.monotonically_increasing_id()))
    centre, listed = _centre(fit, width), Layout.of(fit, width)
    tall = _block_matrix(fit.mapInArrow(_blocks(listed, centre, 1), BLOCKS), listed.height, width, listed.blocks * listed.height, width)
    scatter = _scatter(tall, listed.tasks(fit.sparkSession.sparkContext.defaultParallelism)) / centre.n
    values, vectors = np.linalg.eigh((scatter + scatter.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > max(values[0], 0) * width * np.finfo(float).eps).sum()))
    if not k:
        return None
    whitening = vectors[:, :k] / np.sqrt(values[:k])
    fitted, side = _project(fit, listed, centre, whitening)
    error = _covariance_error(staged(fitted), side, listed, centre, k)
    layout = Layout.of(rows, width)
    projected, side = _project(rows, layout, centre, whitening)
    whole = projected.mapInArrow(_rows_of(layout, side), "place long, whitened array<double>")
    known = rows.mapInArrow(_measured(layout, centre), "vec_id long, place long, deviation decimal(38,0)")
    shares = (values[:k] / np.trace(scatter)).tolist()
    return known.join(whole, "place").select("vec_id", F.lit(centre.n).cast("bigint").alias("n"), "deviation", "whitened",
                                             F.array(*map(F.lit, shares)).alias("explained"), F.lit(error).alias("identity_error"))


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per remaining row of (vec_id, embedding): the columns of RESULT, arrays by component."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), entries(F.col("embedding")).alias("x")).where("size(x) > 0")
    widths = sorted(r[0] for r in rows.select(F.size("x")).distinct().collect())
    spaces = [_whiten_space(rows.where(F.size("x") == w), w, components) for w in widths]
    out = vectors.sparkSession.createDataFrame([], RESULT)
    for space in spaces:
        out = out if space is None else out.unionByName(space)
    return out


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(table(spark, sf_dir, "embeddings"))
    each = found.select("*", F.posexplode("whitened").alias("k", "value"))
    return each.select("vec_id", (F.col("k") + 1).alias("component"), "n", F.col("deviation").try_cast("bigint").alias("deviation"),
                       F.col("value").alias("whitened"), F.get("explained", F.col("k")).alias("explained"), "identity_error")
