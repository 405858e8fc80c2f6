"""Exact top-k search by inner product with vector-approximation files.

Vectors lie in blocks. Next to its exact vectors each block holds an approximation
file: 4 bits a component that name the cell the component lies in, with the cells'
edges. A block and a block of queries meet once: scanning the cells gives a lower and
an upper bound of every score; then exact vectors are read in the order of their upper
bounds, until the k-th score found is above every bound left. Each such meeting gives
k rows for a query, and the best k of those are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hallmark.llm.tables import settled, step

BLOCK_ROWS = 4096
QUERY_ROWS = 1024
CELLS = 16
#: Vectors read at once, for all queries that have not ended.
READ = 64

PACKED = "width int, ids binary, data binary"
FOUND = "query_id long, query_row long, vec_id long, score long"


def whole_vectors(table: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, vector array<long>): components times `scale`, rounded down.

    Rows without an id, without a vector, or with a null or non-finite component are
    left out; so are empty vectors, which have no component to compare.
    """
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return (
        table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
        .where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite)
        .select("vec_id", F.transform("embedding", lambda x: F.floor(scale * x.cast("double"))).alias("vector"))
    )


def packed(vectors: DataFrame, rows: int) -> DataFrame:
    """Blocks of up to `rows` vectors of one width: (block, width, ids, data)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        held: dict[int, int] = {}

        def flush(width: int) -> pa.RecordBatch:
            ids = np.concatenate([x for x, _ in open_[width]])
            data = np.concatenate([y for _, y in open_.pop(width)])
            held.pop(width)
            return pa.RecordBatch.from_arrays(
                [pa.array([width], pa.int32()), pa.array([ids.tobytes()]), pa.array([data.tobytes()])],
                names=["width", "ids", "data"],
            )

        for batch in batches:
            for k in range(0, len(batch), rows):
                part = batch.slice(k, rows)
                ids, lists = part.column(0).to_numpy(zero_copy_only=False), part.column(1)
                sizes = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                begins = np.cumsum(sizes) - sizes
                for width in np.unique(sizes).tolist():
                    own = np.flatnonzero(sizes == width)
                    data = flat[begins[own][:, None] + np.arange(width)]
                    open_.setdefault(width, []).append((ids[own], data))
                    held[width] = held.get(width, 0) + len(own)
                    if held[width] >= rows:
                        yield flush(width)
        for width in list(open_):
            yield flush(width)

    return vectors.mapInArrow(pack, PACKED).withColumn("block", F.monotonically_increasing_id())


class ApproximationFile:
    """Cells of a block's vectors, and bounds of inner products from them."""

    def __init__(self, data: np.ndarray, cells: int = CELLS):
        low, high = data.min(axis=0), data.max(axis=0)
        step_ = np.maximum(1, -(-(high - low + 1) // cells))
        self.cells = ((data - low) // step_).astype(np.uint8)
        self.low, self.step = low.astype(np.float64), step_.astype(np.float64)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest possible score of each query with each vector.

        A component lies in [edge, edge + step - 1]; the rounding allowance keeps the
        bounds safe where scores are beyond the whole numbers of doubles.
        """
        edges = self.low + self.cells * self.step
        base = queries @ edges.T
        up = (np.maximum(queries, 0) * (self.step - 1)).sum(axis=1, keepdims=True)
        down = (np.minimum(queries, 0) * (self.step - 1)).sum(axis=1, keepdims=True)
        slack = 1e-9 * (np.abs(queries) @ (np.abs(self.low) + CELLS * self.step)).reshape(-1, 1)
        return base + down - slack, base + up + slack


def best_in_block(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, data: np.ndarray, k: int
) -> list[tuple[int, int, int]]:
    """(query number, vec_id, score) of each query's best k in a block, ties by vec_id."""
    lower, upper = ApproximationFile(data).bounds(queries.astype(np.float64))
    own = query_ids[:, None] == ids[None, :]
    lower[own] = upper[own] = -np.inf
    # The k-th highest lower bound is beaten by no vector whose upper bound is below it.
    at_least = np.partition(lower, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(queries), -np.inf)
    exact = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * data.shape[1] < 2.0**52
    reals = data.astype(np.float64) if exact else data
    found = []
    for q in range(len(queries)):
        able = np.flatnonzero((upper[q] >= at_least[q]) & (upper[q] > -np.inf))
        able = able[np.argsort(-upper[q][able], kind="stable")]
        bounds = upper[q][able]
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        vector = queries[q].astype(reals.dtype)
        for at in range(0, len(able), READ):
            if len(best) >= k and best[k - 1] > bounds[at]:
                break
            part = able[at : at + READ]
            best = np.concatenate((best, np.rint(reals[part] @ vector).astype(np.int64) if exact else reals[part] @ vector))
            best_ids = np.concatenate((best_ids, ids[part]))
            order = np.lexsort((best_ids, -best))[:k]
            best, best_ids = best[order], best_ids[order]
        found += [(q, int(i), int(s)) for i, s in zip(best_ids, best, strict=True)]
    return found


def exact_top_k(candidates: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of the highest inner product.

    Both tables have (vec_id, vector array<long>). A query's own id is no candidate.
    Ties go to the smaller vec_id. Candidates of another width than the query's take no
    part; a query that meets no candidate gives no row. Repeated query rows are one
    query, unless their vectors differ: then each is ranked by itself. A candidate that
    stands twice is found twice.
    """
    spark = candidates.sparkSession
    settled(spark)
    asked = step(queries.distinct())
    blocks = step(packed(candidates, BLOCK_ROWS))
    query_blocks = step(packed(asked.repartition(max(1, -(-asked.count() // QUERY_ROWS))), QUERY_ROWS))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                width = row["width"]
                query_ids = np.frombuffer(row["query_ids"], np.int64)
                asked_ = np.frombuffer(row["query_data"], np.int64).reshape(-1, width)
                ids = np.frombuffer(row["ids"], np.int64)
                data = np.frombuffer(row["data"], np.int64).reshape(-1, width)
                out = best_in_block(query_ids, asked_, ids, data, k)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(query_ids[q]) for q, _, _ in out], pa.int64()),
                        pa.array([row["query_block"] * QUERY_ROWS * 4 + q for q, _, _ in out], pa.int64()),
                        pa.array([i for _, i, _ in out], pa.int64()),
                        pa.array([s for _, _, s in out], pa.int64()),
                    ],
                    names=["query_id", "query_row", "vec_id", "score"],
                )

    # Every pair of a block and a query block of one width is a task's row of its own.
    block_ids = blocks.select("block", "width")
    query_ids = query_blocks.select(F.col("block").alias("query_block"), "width")
    pairs = block_ids.join(query_ids, "width").select("block", "query_block", "width")
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = (
        pairs.repartition(tasks)
        .join(blocks.drop("width"), "block")
        .join(
            query_blocks.select(
                F.col("block").alias("query_block"), F.col("ids").alias("query_ids"), F.col("data").alias("query_data")
            ),
            "query_block",
        )
        .select("width", "query_block", "query_ids", "query_data", "ids", "data")
        .repartition(tasks)
    )
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return (
        met.mapInArrow(meet, FOUND)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
