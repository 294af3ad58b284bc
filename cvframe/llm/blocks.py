"""A stated query set against all vectors, in blocks.

Vectors are dealt once into blocks of bounded size; the queries among them
are streamed to every block, tile by tile.  One task holds one block (and
what is built of it, once) and one tile, whatever the table, and returns at
most k rows for each query; a window over the blocks' winners gives the
result.  The shuffle carries the table once and the queries once a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cvframe.llm.common import quoted, written

QUERY_BLOCK = 2048          # queries of a tile
CANDIDATE_BLOCK = 32768     # vectors of a block
SPREAD_ROWS = 4096          # smaller blocks are not made for the sake of more tasks


def usable_vectors(df: DataFrame, id_col: str, vector_col: str, nonzero: bool) -> DataFrame:
    """(vec_id, v) of the rows that take part: an id and a vector without
    NULL or non-finite components (``nonzero``: not all zero).  Rows equal in
    id and vector count once; other vectors of an id are rows of their own."""
    v = F.col("v")
    good = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & (F.size(v) > 0)
    if nonzero:
        good = good & F.exists(v, lambda x: x != 0)
    rows = df.select(quoted(id_col).cast("long").alias("vec_id"), quoted(vector_col).alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(good)
    return rows.distinct()


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(-1, dim)


def blocks_of(spark: SparkSession, n: int, per_block: int) -> int:
    """Blocks for n rows: no larger than ``per_block``, and while they have
    ``SPREAD_ROWS`` rows as many as there are cores."""
    return max(1, -(-n // per_block), min(spark.sparkContext.defaultParallelism, -(-n // SPREAD_ROWS)))


def meet(rows: DataFrame, queries: DataFrame, blocks: int) -> DataFrame:
    """Every row in its block, every query in all, rows before queries.

    ``queries`` may have columns besides those of ``rows`` (vec_id, v, ..).
    A row's block follows from id and vector, so many vectors of one id are
    dealt out like any others."""
    extra = [c for c in queries.columns if c not in rows.columns]
    kinds = dict(queries.dtypes)
    own = rows.select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in extra], F.lit(False).alias("is_query"),
                      F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias("cb"))
    asked = queries.select(*rows.columns, *extra, F.lit(True).alias("is_query"),
                           F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("cb"))
    both = own.unionByName(asked).withColumn("dim", F.size("v"))
    return both.repartitionById(blocks, "cb").sortWithinPartitions("cb", "dim", "is_query", "vec_id")


def streamed(build: Callable, work: Callable, tile: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function over the rows of ``meet``: ``build`` gets the
    record batches of a block's rows of one vector length (ascending by id)
    and ``work`` what it made and at most ``tile`` queries of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            block_no, dim, is_query = (batch[c].to_numpy(zero_copy_only=False) for c in ("cb", "dim", "is_query"))
            change = np.flatnonzero((np.diff(block_no) != 0) | (np.diff(dim) != 0) | (np.diff(is_query.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *change], [*change, batch.num_rows]):
                if key != (here := (int(block_no[a]), int(dim[a]))):
                    key, parts, block = here, [], None
                some = batch.slice(a, b - a)
                if not is_query[a]:
                    parts.append(some)
                    continue
                if block is None and parts:
                    block, parts = build(parts), []
                if block is None:       # no row of this length in the block
                    continue
                for s in range(0, some.num_rows, tile):
                    out = work(block, some.slice(s, tile))
                    if out is not None and out.num_rows:
                        yield out

    return run


def search(vectors: DataFrame, is_query: Column, k: int, score_type: str,
           build: Callable[[np.ndarray, np.ndarray], Callable[[np.ndarray, np.ndarray], tuple]],
           query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each query's candidates.

    ``build(ids, matrix)`` makes the index of a block, a function of (query
    ids, query matrix) that returns arrays (query_id, vec_id, score) with at
    most k rows a query vector and without the query's own id; the vectors
    of one id share its ranks.  Vectors of another length than the query's
    are no candidates."""
    vectors = written(vectors, "vectors")
    n = vectors.count()
    kind = pa.int64() if score_type == "long" else pa.float64()

    def index(parts: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(parts)
        return build(rows["vec_id"].to_numpy(), matrix(rows["v"], rows["dim"][0].as_py()))

    def work(find, queries: pa.RecordBatch) -> pa.RecordBatch:
        found = find(queries["vec_id"].to_numpy(), matrix(queries["v"], queries["dim"][0].as_py()))
        return pa.record_batch([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], kind)],
                               names=["query_id", "vec_id", "score"])

    both = meet(vectors, vectors.where(is_query), blocks_of(vectors.sparkSession, n, candidate_block))
    found = both.mapInArrow(streamed(index, work, query_block), f"query_id long, vec_id long, score {score_type}")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def joined(parts: list[tuple], score_dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns of the parts (query id, candidate ids, scores)."""
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, score_dtype)
    return (np.concatenate([np.full(len(i), q, np.int64) for q, i, _ in parts]),
            np.concatenate([i for _, i, _ in parts]), np.concatenate([s for _, _, s in parts]))
