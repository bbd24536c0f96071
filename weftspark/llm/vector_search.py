"""Exact top-k by inner product with vector-approximation files.

The approximation of a vector is one byte per component: the cell it falls into, of 256 cells
between the component's least and greatest value over all vectors. The approximations are
written as a table of their own, the file that is scanned: blocks of queries meet chunks of
cells, and every score gets a bound from both sides. A task hands on the vectors whose upper
bound reaches the k-th lower bound it has seen; over all tasks the k-th lower bound is higher,
and few are left. Their exact vectors are read in the order of their upper bounds: first READ
times k for each query, then all whose bound reaches the k-th exact score found. No other can
be among the k best.

Queries are a table too. Nothing but the components' ranges goes through the driver, and what
reaches a task is one block of queries and one chunk of cells at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftspark.llm.shared import written

#: Queries of a block, vectors of a chunk, and blocks in a file of queries.
BLOCK, CHUNK, FILE_BLOCKS = 512, 4096, 16
CELLS = 256
#: Candidates read at first, in units of k.
READ = 2
#: Scaled components from here on are not counted with.
LARGEST = 2**62
#: Candidates a task holds before it looks again which ones its bounds still allow.
HELD = 1_000_000


def scaled(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, x): components as floor(scale * x), held within LARGEST; rows that take no part are gone."""
    held = lambda x: F.greatest(F.least(x, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))
    parts = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    usable = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)
    return (
        vectors.where(usable & F.forall(parts, sound))
        .select(F.col(id_col).cast("long").alias("vec_id"), F.transform(parts, lambda x: F.floor(held(x * scale))).alias("x"))
    )


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def approximate(low: np.ndarray, width: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cells of integer components: cell c holds low + c * width to low + (c + 1) * width - 1."""
    return np.minimum((x - low) // width, CELLS - 1).astype(np.uint8)


def _ranges(ints: DataFrame) -> list:
    """Rows (place, low, high) of the components, in order; ValueError where one is LARGEST or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
            if lengths.min() != lengths.max() or (low is not None and len(low) != lengths[0]):
                raise ValueError("vectors of different numbers of components")
            x = _matrix(batch.column(0))
            low = x.min(0) if low is None else np.minimum(low, x.min(0))
            high = x.max(0) if high is None else np.maximum(high, x.max(0))
        if low is not None:
            columns = [pa.array(np.arange(len(low)), pa.int32()), pa.array(low), pa.array(high), pa.array([len(low)] * len(low), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["place", "low", "high", "d"])

    found = ints.select("x").mapInArrow(run, "place int, low long, high long, d int")
    rows = found.groupBy("place").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("d").alias("d"), F.max("d").alias("most")).orderBy("place").collect()
    if any(r["d"] != r["most"] for r in rows) or (rows and len(rows) != rows[0]["d"]):
        raise ValueError("vectors of different numbers of components")
    if any(max(abs(r["low"]), abs(r["high"])) >= LARGEST for r in rows):
        raise ValueError(f"components of {LARGEST} or more after scaling do not fit into 64 bits with their differences")
    return rows


def _packed(rows: DataFrame, size: int, code) -> DataFrame:
    """(ids, data): rows (id, x) by ``size`` as bytes, ``code`` of the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, n = [], [], 0

        def flush() -> pa.RecordBatch:
            columns = [pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([np.concatenate(parts).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["ids", "data"])

        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                ids.append(np.column_stack([part.column(i).to_numpy() for i in range(part.num_columns - 1)]))
                parts.append(code(_matrix(part.column(part.num_columns - 1))))
                n += part.num_rows
                if n >= size:
                    yield flush()
                    ids, parts, n = [], [], 0
        if n:
            yield flush()

    return rows.mapInArrow(run, "ids binary, data binary")


def _scan(low: np.ndarray, high: np.ndarray, width: np.ndarray, k: int):
    """A function over Arrow batches of pairs (chunk of cells, block of queries): candidates with bounds."""
    d, top = len(low), (width - 1).astype(np.float64)
    most = np.maximum(np.abs(low), np.abs(high)).astype(np.float64) + width
    # Of rounding: in d products and sums, of doubles that stand for whole numbers.
    rounding = (d + 16) * 2.0**-51

    class Block:
        def __init__(self, ids: bytes, data: bytes) -> None:
            self.rows, self.ids = np.frombuffer(ids, np.int64).reshape(-1, 2).T
            self.q = np.frombuffer(data, np.int64).reshape(-1, d).astype(np.float64)
            self.over, self.under = np.maximum(self.q, 0) @ top, np.minimum(self.q, 0) @ top
            self.slack = rounding * (np.abs(self.q) @ most)[:, None] + 1e-6
            self.best = np.full((len(self.ids), k), -np.inf)
            self.found: list[tuple] = []
            self.n = 0

        def take(self, vec: np.ndarray, floor_of: np.ndarray) -> None:
            base = self.q @ floor_of.T
            upper, lower = base + self.over[:, None], base + self.under[:, None]
            upper += self.slack
            lower -= self.slack
            own = self.ids[:, None] == vec[None, :]
            upper[own] = lower[own] = -np.inf
            both = np.concatenate([self.best, lower], axis=1)
            self.best = -np.partition(-both, k - 1, axis=1)[:, :k]
            at = self.best.min(axis=1)
            i, j = np.nonzero((upper >= at[:, None]) & ~own)
            self.found.append((i, vec[j], upper[i, j], lower[i, j]))
            self.n += len(i)
            if self.n > HELD:
                self.prune()

        def prune(self) -> tuple:
            i, vec, upper, lower = (np.concatenate(x) for x in zip(*self.found, strict=True))
            good = upper >= self.best.min(axis=1)[i]
            self.found = [(i[good], vec[good], upper[good], lower[good])]
            self.n = int(good.sum())
            return self.found[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[bytes, Block] = {}
        for batch in batches:
            for vec, cells, ids, data in zip(*(batch.column(c) for c in range(4)), strict=True):
                ids = ids.as_py()
                if ids not in blocks:
                    blocks[ids] = Block(ids, data.as_py())
                vec = np.frombuffer(vec.as_py(), np.int64)
                floor_of = low + np.frombuffer(cells.as_py(), np.uint8).reshape(-1, d).astype(np.int64) * width
                blocks[ids].take(vec, floor_of.astype(np.float64))
        for block in blocks.values():
            i, vec, upper, lower = block.prune()
            columns = [pa.array(block.rows[i]), pa.array(block.ids[i]), pa.array(vec), pa.array(upper), pa.array(lower)]
            yield pa.RecordBatch.from_arrays(columns, names=["q_row", "query_id", "vec_id", "upper", "lower"])

    return run


def _exact(pairs: DataFrame, ints: DataFrame, queries: DataFrame, kind: str) -> DataFrame:
    """(query_id, vec_id, score) of pairs (q_row, query_id, vec_id), from the exact vectors, in numbers of ``kind``."""
    wide = lambda c: c if kind == "long" else c.cast("decimal(19,0)")
    dot = F.aggregate(F.zip_with("x", "q", lambda a, b: (wide(a) * wide(b)).cast(kind)), F.lit(0).cast(kind), lambda acc, v: (acc + v).cast(kind))
    met = pairs.select("q_row", "query_id", "vec_id").join(ints, "vec_id").join(queries.select("q_row", F.col("x").alias("q")), "q_row")
    return met.select("query_id", "vec_id", dot.alias("score"))


def top_k(
    vectors: DataFrame,
    k: int = 10,
    query_every: int = 100,
    scale: int = 1024,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of every query.

    Queries are the rows whose id is divisible by ``query_every``; candidates are all rows
    with another id. Ties go to the smaller id.

    * Null vectors, vectors with a null, NaN or infinite component, empty ones and null ids take
      no part. Vectors of different lengths cannot be compared, and components of LARGEST or more
      after scaling are not counted with: an error says so. Where products of the components might
      not fit into 64 bits, scores are summed as decimals, and only a score among the k highest
      that does not fit is an error.
    * A row that repeats an id is one more candidate and is listed again. Queries that repeat
      an id share one result: the k best rows of both.
    * Fewer than k candidates give as many rows; an empty table gives none. Other columns are
      not looked at.
    """
    spark = vectors.sparkSession
    ints = scaled(vectors, id_col, vec_col, scale)
    ranges = _ranges(ints)
    if not ranges:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    low, high = np.array([r["low"] for r in ranges], np.int64), np.array([r["high"] for r in ranges], np.int64)
    width = (high - low) // CELLS + 1
    most = max(max(abs(r["low"]), abs(r["high"])) for r in ranges)
    kind = "long" if most * most * len(ranges) < 2**63 else "decimal(38,0)"

    queries = ints.where(F.col("vec_id") % query_every == 0).withColumn("q_row", F.monotonically_increasing_id())
    queries = written(queries, "va-queries")
    files = max(1, -(-queries.count() // (BLOCK * FILE_BLOCKS)))
    blocks = written(_packed(queries.select("q_row", "vec_id", "x").repartition(files), BLOCK, lambda x: x), "va-blocks")
    cells = written(_packed(ints.select("vec_id", "x"), CHUNK, lambda x: approximate(low, width, x)), "va-cells")
    # The stated queries against all rows, in blocks: a row for each block and chunk.
    paired = cells.crossJoin(blocks.withColumnsRenamed({"ids": "q_ids", "data": "q_data"}))
    bounds = "q_row long, query_id long, vec_id long, upper double, lower double"
    found = written(paired.mapInArrow(_scan(low, high, width, k), bounds), "va-bounds")

    by_query = lambda *order: F.row_number().over(W.partitionBy("query_id").orderBy(*order))
    least = found.withColumn("r", by_query(F.desc("lower"))).where(F.col("r") == k).select("query_id", F.col("lower").alias("bound"))
    near = found.join(least, "query_id", "left").where("bound is null or upper >= bound")
    near = near.groupBy("q_row", "query_id", "vec_id").agg(F.max("upper").alias("upper"))
    near = written(near.withColumn("place", by_query(F.desc("upper"), "vec_id", "q_row")), "va-near")
    first = written(_exact(near.where(F.col("place") <= READ * k), ints, queries, kind), "va-first")
    kth = first.withColumn("r", by_query(F.desc("score"))).where(F.col("r") == k).select("query_id", F.col("score").cast("double").alias("kth"))
    rest = near.where(F.col("place") > READ * k).join(kth, "query_id", "left").where("kth is null or upper >= kth * (1 - sign(kth) * 1e-15D)")  # a double near the score
    all_found = first.union(_exact(rest, ints, queries, kind))
    ranked = all_found.withColumn("rank", by_query(F.desc("score"), "vec_id")).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").cast("long").alias("score"))
