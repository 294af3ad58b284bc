"""Exact top-k by an impact-ordered, score-at-a-time index.

Components are integers.  For each dimension the index holds postings sorted
by value; equal values form a segment.  For one query the impact of a
segment is the product of the query's component and the value, so segments
are taken from the top of a dimension where the component is positive and
from the bottom where it is negative.  Segments of all dimensions are
processed together by descending quantised impact, adding to the documents'
accumulators.  After level t every posting not yet seen has an impact below
t, which bounds each document's final score from above.  The search stops
when the bound proves that few documents can still be among the k best (at
level 0 at the latest, when only negative impacts are left), and those are
scored exactly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from cvframe.llm.blocks import CANDIDATE_BLOCK, QUERY_BLOCK, joined, search, usable_vectors

SCALE = 256
LEVELS = (4, 16, 64, 256)    # quantised impacts: the largest one divided by these, then 0
FEW = 32                     # stop early once n / FEW documents are possible


class ImpactIndex:
    def __init__(self, ids: np.ndarray, values: np.ndarray):
        """``ids`` ascending; ``values`` integers, one row per id."""
        self.ids, self.values = ids, values
        self.n, self.dim = values.shape
        order = np.argsort(values, axis=0, kind="stable")
        self.doc = np.ascontiguousarray(order.T).astype(np.int32).ravel()
        self.value = np.ascontiguousarray(np.take_along_axis(values, order, 0).T)

    def top(self, query: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best but ``own``, ties to smaller ids."""
        other = np.ones(self.n, bool)
        other[np.searchsorted(self.ids, own):np.searchsorted(self.ids, own, "right")] = False
        if not other.any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        dims = np.flatnonzero(query)
        up = query > 0
        acc, seen = np.zeros(self.n), np.zeros(self.n, np.int64)
        done = np.zeros(self.dim, np.int64)          # postings taken from the end of each dimension
        best = max((int(query[d]) * int(self.value[d, -1 if up[d] else 0]) for d in dims), default=0)
        possible = other
        for level in [*(t for t in (best // x for x in LEVELS) if t > 0), 0]:
            starts, stops = [], []
            for d in dims:
                # segments with query * value >= level
                if up[d]:
                    new = self.n - int(np.searchsorted(self.value[d], -(-level // int(query[d])), "left"))
                    starts.append(d * self.n + self.n - max(new, done[d]))
                    stops.append(d * self.n + self.n - done[d])
                else:
                    new = int(np.searchsorted(self.value[d], level // int(query[d]) if level % int(query[d]) == 0
                                              else -(-level // int(query[d])) - 1, "right"))
                    starts.append(d * self.n + done[d])
                    stops.append(d * self.n + max(new, done[d]))
                done[d] = max(new, done[d])
            starts, sizes = np.array(starts), np.array(stops) - np.array(starts)
            total = int(sizes.sum()) if len(dims) else 0
            if total:
                at = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(total)
                doc = self.doc[at]
                impact = np.repeat(query[dims].astype(np.float64), sizes) * self.value.ravel()[at]
                acc += np.bincount(doc, impact, self.n)
                seen += np.bincount(doc, minlength=self.n)
            # unseen postings have impact <= level - 1
            bound = acc + (len(dims) - seen) * (level - 1)
            m = min(k, int(other.sum()))
            lead = np.argpartition(np.where(other, bound, -np.inf), -m)[-m:]
            limit = int((self.values[lead] @ query).min())     # k-th best score is at least this
            possible = other & (bound >= limit)
            if np.count_nonzero(possible) * FEW <= self.n:
                break
        rows = np.flatnonzero(possible)
        scores = self.values[rows] @ query
        pick = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows][pick], scores[pick]


def top_k(df: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = SCALE, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): exact integer inner products.

    Components become floor(scale * x), x as double.  Rows with a NULL id, a
    NULL or empty vector or NULL or non-finite components take no part; a row
    repeated with id and vector counts once.  Ties go to the
    smaller id; fewer than k other rows give them all; an empty table or no
    query gives no rows.  Only the two named columns are read."""

    def build(ids, vectors):
        index = ImpactIndex(ids, np.floor(scale * vectors).astype(np.int64))

        def find(query_ids, queries):
            whole = np.floor(scale * queries).astype(np.int64)
            return joined([(q, *index.top(v, k, q)) for q, v in zip(query_ids.tolist(), whole)], np.int64)

        return find

    return search(usable_vectors(df, id_col, vector_col, False), is_query, k, "long", build, query_block, candidate_block)


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM e q JOIN e c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
