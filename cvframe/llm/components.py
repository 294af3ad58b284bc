"""Connected components as Spark jobs (alternating large and small stars)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cvframe.llm.common import written


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the edges of one batch by stars around their least node.

    Keeps the components of the batch's edges, so the union over all batches
    has the components of the whole graph, with fewer edges to shuffle."""
    for rb in batches:
        a, b = (rb.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(a):
            continue
        nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = flat[:len(a)], flat[len(a):]
        root = np.arange(len(nodes))
        while True:  # least label along edges, then pointer jumping
            low = np.minimum(root[x], root[y])
            new = root.copy()
            np.minimum.at(new, root[x], low)
            np.minimum.at(new, root[y], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        off = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[off]), pa.array(nodes[root[off]])], names=["u", "v"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def min_labels(links: DataFrame) -> DataFrame:
    """(node, label) for every node with a link to another node.

    ``links`` has columns a and b (BIGINT); loops and repeated links are
    harmless.  The label is the least node of the component.  Rounds go on
    until the edges no longer change; each is written to the shared folder."""
    edges = links.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    edges = written(edges.mapInArrow(_contract, "u long, v long").distinct(), "links")
    seen = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        edges = written(_small_star(_large_star(edges)), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
