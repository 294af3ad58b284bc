"""Hard negatives: wrong-label rows that score almost as high as a positive.

Scores are integer inner products of anchors with all rows.  Rows are dealt
into blocks of bounded bytes, once; the anchors are streamed to every block
in tiles.  A tile's score matrix is a Strassen product on int64: quadrants
are padded with zeros to even sizes, seven half-size products are combined
by exact additions, and small quadrants are multiplied directly.  (int64
additions and products wrap modulo 2^64, so sums inside the recursion cannot
spoil a result that fits.)

Two passes over the same blocks: the first keeps a heap of the best rows of
the anchor's own label, the second one heap per (anchor, positive) of the
best rows of other labels inside the positive's window.  Heaps are arrays of
(score, id), highest score first, ties to smaller ids; they merge within a
block from tile to tile and between blocks in a Spark window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cvframe.llm.blocks import blocks_of, meet, streamed
from cvframe.llm.common import quoted, written

SCALE = 256
LEAF = 32                    # quadrants this thin are multiplied directly
BLOCK_BYTES = 64 << 20       # vectors of a block
TILE_ANCHORS, TILE_ROWS = 512, 8192
LEAST, LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _even(m: np.ndarray) -> np.ndarray:
    """``m`` with a zero row or column where a size is odd."""
    return np.pad(m, [(0, n % 2) for n in m.shape]) if any(n % 2 for n in m.shape) else m


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b.T`` for int64 matrices with rows of equal length."""
    m, c = len(a), len(b)
    if min(m, c, a.shape[1]) <= leaf:
        return np.einsum("ik,jk->ij", a, b)
    a, b = _even(a), _even(b)
    i, j, k = len(a) // 2, len(b) // 2, a.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :k], a[:i, k:], a[i:, :k], a[i:, k:]
    b11, b12, b21, b22 = b[:j, :k], b[j:, :k], b[:j, k:], b[j:, k:]      # of the transposed matrix
    out = np.empty((2 * i, 2 * j), np.int64)
    c11, c12, c21, c22 = out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:]
    p = strassen(a11 + a22, b11 + b22, leaf)
    c11[:] = p
    c22[:] = p
    p = strassen(a21 + a22, b11, leaf)
    c21[:] = p
    c22 -= p
    p = strassen(a11, b12 - b22, leaf)
    c12[:] = p
    c22 += p
    p = strassen(a22, b21 - b11, leaf)
    c21 += p
    c11 += p
    p = strassen(a11 + a12, b22, leaf)
    c12 += p
    c11 -= p
    c22 += strassen(a21 - a11, b11 + b12, leaf)
    c11 += strassen(a12 - a22, b21 + b22, leaf)
    return out[:m, :c]


class Heaps:
    """The k first (score, id) of each owner: higher scores, then smaller ids."""

    def __init__(self, owners: int, k: int):
        self.score = np.full((owners, k), LEAST)
        self.id = np.full((owners, k), LAST)
        self.k = k

    def offer(self, owner: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Merges further entries (another heap's or a tile's)."""
        if not len(owner):
            return
        touched = np.unique(owner)
        held, slot = np.nonzero(self.score[touched] > LEAST)
        held = touched[held]
        owner = np.concatenate([held, owner])
        score = np.concatenate([self.score[held, slot], score])
        ids = np.concatenate([self.id[held, slot], ids])
        order = np.lexsort((ids, -score, owner))
        owner, score, ids = owner[order], score[order], ids[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        keep = place < self.k
        self.score[owner[keep], place[keep]] = score[keep]
        self.id[owner[keep], place[keep]] = ids[keep]

    def least(self) -> np.ndarray:
        """Score below which an entry cannot enter (LEAST while not full)."""
        return self.score[:, -1]

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        owner, slot = np.nonzero(self.score > LEAST)
        return owner, self.score[owner, slot], self.id[owner, slot]


def _offer_tile(heaps: Heaps, owners: np.ndarray, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
    """Offers a tile's allowed scores: row i belongs to ``owners[i]``.

    Only the k highest of a row and what ties with the k-th are sorted.  Ids
    ascend within a block, so a later equal score never displaces one."""
    allowed &= scores > heaps.least()[owners][:, None]
    k = heaps.k
    if scores.shape[1] > k:
        masked = np.where(allowed, scores, LEAST)
        allowed &= scores >= np.partition(masked, scores.shape[1] - k, axis=1)[:, -k][:, None]
    row, col = np.nonzero(allowed)
    heaps.offer(owners[row], scores[row, col], ids[col])


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(n, -1)


class _Block:
    """Rows of one block and vector length, ascending by id."""

    def __init__(self, parts: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        self.ids = rows["vec_id"].to_numpy()
        self.label = rows["label"].to_numpy()
        self.v = _matrix(rows["v"], rows.num_rows)
        self.largest = int(np.abs(self.v).max(initial=0))

    def tiles(self, anchors: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(scores, ids, same label, same id) of the anchors and successive rows."""
        a = _matrix(anchors["v"], anchors.num_rows)
        if int(np.abs(a).max(initial=0)) * self.largest * a.shape[1] >= 1 << 62:
            raise OverflowError("scaled vector components too large for a 64-bit inner product")
        own, label = anchors["vec_id"].to_numpy()[:, None], anchors["label"].to_numpy()[:, None]
        for s in range(0, len(self.ids), TILE_ROWS):
            part = slice(s, s + TILE_ROWS)
            yield strassen(a, self.v[part]), self.ids[part], label == self.label[part], own == self.ids[part]


def _positives(k: int):
    def work(block: _Block, anchors: pa.RecordBatch) -> pa.RecordBatch:
        heaps, owners = Heaps(anchors.num_rows, k), np.arange(anchors.num_rows)
        for scores, ids, same, own in block.tiles(anchors):
            _offer_tile(heaps, owners, scores, same & ~own, ids)
        owner, score, ids = heaps.entries()
        return pa.record_batch([anchors["vec_id"].take(owner), anchors["key"].take(owner), pa.array(ids), pa.array(score)],
                               names=["anchor_id", "key", "id", "score"])

    return streamed(_Block, work, TILE_ANCHORS)


def _negatives(k: int, low: int, high: int):
    def work(block: _Block, anchors: pa.RecordBatch) -> pa.RecordBatch:
        sizes = np.diff(anchors["positives"].offsets.to_numpy())
        flat = anchors["positives"].flatten()
        owner = np.repeat(np.arange(anchors.num_rows), sizes)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        positive = flat.field("score").to_numpy(zero_copy_only=False)
        bottom = -(-low * positive // high)      # smallest n with low * p <= high * n
        heaps = Heaps(len(owner), k)
        for scores, ids, same, own in block.tiles(anchors):
            for p in range(int(sizes.max(initial=0))):
                at = np.flatnonzero(place == p)
                s = scores[owner[at]]
                inside = ~(same | own)[owner[at]] & (s <= positive[at][:, None]) & (s >= bottom[at][:, None])
                _offer_tile(heaps, at, s, inside, ids)
        at, score, ids = heaps.entries()
        return pa.record_batch(
            [anchors["vec_id"].take(owner[at]), anchors["key"].take(owner[at]), pa.array(place[at], pa.int32()),
             flat.field("id").take(at), pa.array(positive[at]), pa.array(ids), pa.array(score)],
            names=["anchor_id", "key", "place", "positive_id", "positive_score", "id", "score"])

    return streamed(_Block, work, TILE_ANCHORS)


def mine(df: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, window: tuple[int, int] = (80, 100),
         id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE,
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(scale * x), x as double.  The positives of an
    anchor are the best ``positives`` rows of its label, the negatives of a
    positive of score p the best ``negatives`` rows of other labels with a
    score n such that low * p <= high * n <= high * p.  Higher scores come first,
    ties go to the smaller id.  An anchor without positives or a positive
    without negatives gives no rows; fewer than asked for give all.

    Rows with a NULL id, label or vector, an empty vector or NULL or
    non-finite components take no part.  A row repeated with id, label and vector counts once;
    rows that share only their id are rows (and anchors) of their own, but
    never each other's positives or negatives.  Vectors of another length
    than the anchor's are no candidates.  An empty table or no anchor gives
    no rows.  Only the three named columns are read, besides what
    ``is_anchor`` (over ``vec_id``) needs.  Scaled components so
    large that an inner product could leave 64 bits raise OverflowError."""
    v = F.col("x")
    good = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & (F.size(v) > 0)
    rows = df.select(quoted(id_col).cast("long").alias("vec_id"), quoted(label_col).cast("long").alias("label"),
                     quoted(vector_col).alias("x"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull()).where(good)
    rows = rows.distinct().select("vec_id", "label", F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))
    rows = written(rows, "vectors")
    n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    per_block = max(1, block_bytes // (8 * (dim or 1)))
    blocks = blocks_of(rows.sparkSession, n, per_block)

    anchors = rows.where(is_anchor).withColumn("key", F.xxhash64("label", "v"))
    found = meet(rows, anchors, blocks).mapInArrow(_positives(positives), "anchor_id long, key long, id long, score long")
    first = Window.partitionBy("anchor_id", "key").orderBy(F.col("score").desc(), "id")
    found = found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
    heaps = found.groupBy("anchor_id", "key").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("positives"))
    heaps = heaps.withColumnsRenamed({"anchor_id": "vec_id"})
    anchors = written(anchors.join(heaps, ["vec_id", "key"]), "anchors")

    hard = meet(rows, anchors, blocks).mapInArrow(
        _negatives(negatives, *window),
        "anchor_id long, key long, place int, positive_id long, positive_score long, id long, score long")
    best = Window.partitionBy("anchor_id", "key", "place").orderBy(F.col("score").desc(), "id")
    hard = hard.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return hard.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                       F.col("score").alias("negative_score"))


#: Rows of the query's contract: anchors are ids divisible by 100, ids divisible by 7 carry the next label.
ORACLE = """
WITH e AS (SELECT DISTINCT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
             list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS la, a.v AS va, c.vec_id, a.label = c.label AS same,
        CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM e a JOIN e c ON c.vec_id <> a.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id, la, va ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
w AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
        CAST(row_number() OVER (PARTITION BY p.anchor_id, p.la, p.va, p.place ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.la = p.la AND s.va = p.va AND NOT s.same
        AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score WHERE p.place <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM w WHERE rank <= 5
"""
