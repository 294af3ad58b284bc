"""Approximate nearest neighbours by inner product: a hash-prefix forest.

Every vector gets one long bit string per tree (signs of random projections
of the vector lifted to the unit sphere); a tree is the sorted array of its
strings.  A query descends each tree to its longest matching prefix (a
binary search per length), then all trees ascend together, one bit at a
time: the candidates of a level are the vectors that share a prefix of that
length with the query in some tree.  They are scored exactly.  The ascent
ends when a neighbour as good as the current k-th would have been met with
probability ``RECALL``: with angle a to the query it shares a prefix of l
bits in one of T trees with probability 1 - (1 - (1 - a / pi)^l)^T.  So easy
queries stop at long prefixes and hard ones go on, at any table size, with
no cap on candidates.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cvframe.llm.blocks import CANDIDATE_BLOCK, QUERY_BLOCK, joined, search, usable_vectors
from cvframe.llm.common import written

TREES = 128
BITS = 24
RECALL = 0.93
SEED = 20


class PrefixForest:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float, trees: int = TREES, bits: int = BITS, seed: int = SEED):
        """``longest``: the largest norm of the whole table, one lift for all blocks."""
        self.ids, self.vectors, self.trees, self.bits, self.longest = ids, vectors, trees, bits, longest
        self.planes = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, trees * bits)).astype(np.float32)
        scaled = vectors / longest
        rest = np.sqrt(np.maximum(0.0, 1.0 - (scaled * scaled).sum(1)))
        codes = self._codes(np.column_stack([scaled, rest]))
        self.row = np.argsort(codes, axis=1, kind="stable").astype(np.int32)
        self.code = np.take_along_axis(codes, self.row, 1)

    def _codes(self, lifted: np.ndarray) -> np.ndarray:
        """Bit strings as integers, (tree, vector)."""
        weights = (1 << np.arange(self.bits - 1, -1, -1)).astype(np.float32)    # exact below 2^24
        out = np.empty((self.trees, len(lifted)), np.int32)
        for a in range(0, len(lifted), 4096):
            signs = lifted[a:a + 4096].astype(np.float32) @ self.planes > 0
            out[:, a:a + 4096] = (signs.reshape(-1, self.trees, self.bits) @ weights).T
        return out

    def prefixes(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges [low, high) of equal prefixes, (length, query, tree)."""
        codes = self._codes(np.column_stack([queries, np.zeros(len(queries))]))
        low = np.empty((self.bits + 1, len(queries), self.trees), np.int32)
        high = np.empty_like(low)
        for t in range(self.trees):
            for length in range(self.bits + 1):
                drop = self.bits - length
                first = codes[t] >> drop << drop
                low[length, :, t] = np.searchsorted(self.code[t], first, "left")
                high[length, :, t] = np.searchsorted(self.code[t], first + (1 << drop), "left")
        return low, high

    def search(self, query: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, own: int, recall: float) -> tuple:
        """(ids, scores) of the k nearest found but ``own``; low, high: (length, tree)."""
        n = len(self.ids)
        met = np.zeros(n, bool)
        met[np.searchsorted(self.ids, own):np.searchsorted(self.ids, own, "right")] = True
        norm = float(np.sqrt(query @ query)) * self.longest
        rows, scores = np.empty(0, np.int64), np.empty(0)
        prev_low = prev_high = None
        base = np.arange(self.trees) * n
        flat = self.row.ravel()
        for length in range(self.bits, -1, -1):
            lo, hi = low[length].astype(np.int64), high[length].astype(np.int64)
            if prev_low is None:
                a, b = base + lo, base + hi
            else:
                a, b = np.concatenate([base + lo, base + prev_high]), np.concatenate([base + prev_low, base + hi])
            prev_low, prev_high = lo, hi
            size = b - a
            total = int(size.sum())
            if total:
                spots = np.repeat(a - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(total)
                hit = np.zeros(n, bool)
                hit[flat[spots]] = True
                new = np.flatnonzero(hit & ~met)
                met |= hit
                if len(new):
                    rows = np.concatenate([rows, new])
                    scores = np.concatenate([scores, self.vectors[new] @ query])
                    if len(rows) > 4 * k:      # all that can still be among the k best, ties included
                        limit = np.partition(scores, -k)[-k]
                        stay = scores >= limit - 1e-9 * norm
                        rows, scores = rows[stay], scores[stay]
            if len(rows) >= k:
                cosine = min(1.0, max(-1.0, float(np.partition(scores, -k)[-k]) / norm))
                agree = 1.0 - np.arccos(cosine) / np.pi
                if 1.0 - (1.0 - agree ** length) ** self.trees >= recall:
                    break
        # the sum from left to right: equal vectors get equal scores
        exact = np.cumsum(self.vectors[rows] * query, axis=1)[:, -1] if len(rows) else scores
        pick = np.lexsort((self.ids[rows], -exact))[:k]
        return self.ids[rows][pick], exact[pick]


def nearest(df: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding",
            trees: int = TREES, bits: int = BITS, recall: float = RECALL, seed: int = SEED,
            query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): nearest found by inner product.

    Scores are exact inner products in double precision of the stored
    vectors.  Rows with a NULL id, a NULL, empty or zero vector or NULL or
    non-finite components take no part; a row repeated with id and
    vector counts once.  Ties go to the smaller id, equal vectors tie
    exactly; fewer than k other rows give them all; an empty table or no
    query gives no rows.  Only the two named columns are read.  Every row is
    indexed; nothing is fitted (the projections come from ``seed``)."""
    vectors = written(usable_vectors(df, id_col, vector_col, True), "ann-vectors")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    longest = vectors.agg(F.sqrt(F.max(square))).first()[0] or 1.0

    def build(ids, matrix):
        forest = PrefixForest(ids, matrix, longest, trees, bits, seed)

        def find(query_ids, queries):
            parts = []
            for a in range(0, len(queries), 256):
                low, high = forest.prefixes(queries[a:a + 256])
                for i, (q, v) in enumerate(zip(query_ids[a:a + 256].tolist(), queries[a:a + 256])):
                    parts.append((q, *forest.search(v, low[:, i], high[:, i], k, q, recall)))
            return joined(parts, np.float64)

        return find

    return search(vectors, is_query, k, "double", build, query_block, candidate_block)
