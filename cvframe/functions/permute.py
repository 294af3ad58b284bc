"""A keyed permutation of positions: a Feistel network that walks its cycle.

Position ``j`` of ``n`` is split into two halves of ``b`` bits (the least
``b >= 1`` with ``4^b >= n``); four rounds mix one half into the other with
words of an md5 key.  That permutes ``0 .. 4^b - 1``; applying it until the
result is below ``n`` permutes ``0 .. n - 1``.  Nothing is sorted, and no
hash is taken per position: one key per row decides, so any engine with
integer arithmetic can restate it (``permutation_sql``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUNDS = 4
ADD, MULTIPLY = 40503, 739982445       # of the round function, modulo 2^32
POSITIONS = 1 << 17                    # worked on together (some 20 MB)


def key_words(key: Column) -> Column:
    """The four 32-bit words of a key, from its md5."""
    h = F.md5(key.cast("binary"))
    return F.array(*[F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(ROUNDS)])


def _network(x: np.ndarray, bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    mask = (1 << bits) - 1
    left, right = x >> bits, x & mask
    for r in range(ROUNDS):
        t = (right * ADD + keys[r]) & 0xFFFFFFFF
        left, right = right, left ^ ((((t ^ (t >> 15)) * MULTIPLY & 0xFFFFFFFF) >> 12) & mask)
    return (left << bits) | right


def permuted_positions(sizes: np.ndarray, keys: np.ndarray, at_once: int = POSITIONS) -> np.ndarray:
    """Row after row, for each output position the input position it takes;
    ``keys`` has a row of words per row.  Positions do not depend on each
    other: ``at_once`` of them are worked on together, whatever the rows."""
    half = np.maximum(1, (np.frexp((sizes - 1).astype(np.float64))[1].astype(np.int64) + 1) // 2)
    end, words = np.cumsum(sizes), np.ascontiguousarray(keys.T)
    out = np.empty(int(sizes.sum()), np.int32 if sizes.max(initial=0) < 1 << 31 else np.int64)
    for a in range(0, len(out), at_once):
        b = min(a + at_once, len(out))
        rows = np.arange(np.searchsorted(end, a, "right"), np.searchsorted(end, b - 1, "right") + 1)
        row = np.repeat(rows, np.minimum(end[rows], b) - np.maximum(end[rows] - sizes[rows], a))
        part = np.arange(a, b) - (end - sizes)[row]
        todo = np.arange(b - a)
        while len(todo):
            at = row[todo]
            x = _network(part[todo], half[at], words[:, at])
            part[todo] = x
            todo = todo[x >= sizes[at]]
        out[a:b] = part
    return out


@F.arrow_udf(T.ArrayType(T.StringType()))
def permuted(values: pa.Array, keys: pa.Array) -> pa.Array:
    """The array's elements in permuted order; NULL stays NULL."""
    null = pc.is_null(values)
    sizes = np.asarray(pc.fill_null(pc.list_value_length(values), 0)).astype(np.int64)
    flat = values.flatten()
    words = np.asarray(keys.flatten(), dtype=np.int64).reshape(-1, ROUNDS)
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    at = permuted_positions(sizes, words)
    at += np.repeat(offsets[:-1], sizes)
    return pa.ListArray.from_arrays(pa.array(offsets), flat.take(pa.array(at)), mask=null if null.true_count else None)


def permutation_sql(rows: str, name: str, id_col: str, key: str) -> str:
    """DuckDB CTEs (the statement needs WITH RECURSIVE): ``name`` with
    (id, j, x), output position j takes input position x; ``rows`` is a
    relation with the id and ``tokens``, ``key`` the key's SQL text."""
    words = ", ".join(f"('0x' || substr(md5({key}), {1 + 8 * i}, 8))::BIGINT AS k{i}" for i in range(ROUNDS))
    keep = f"{id_col}, n, b, {', '.join(f'k{i}' for i in range(ROUNDS))}, j"

    def network(src: str) -> str:
        q = f"SELECT {keep}, x >> b AS l, x & ((1::BIGINT << b) - 1) AS r FROM {src}"
        for i in range(ROUNDS):
            q = f"SELECT {keep}, l, r, (r * {ADD} + k{i}) & 4294967295 AS t FROM ({q})"
            q = (f"SELECT {keep}, r AS l, xor(l, ((((xor(t, t >> 15) * {MULTIPLY}) & 4294967295) >> 12) & ((1::BIGINT << b) - 1))) AS r "
                 f"FROM ({q})")
        return f"SELECT {keep}, (l << b) | r AS x FROM ({q})"

    return f"""{name}_n AS (SELECT {id_col}, CAST(len(tokens) AS BIGINT) AS n, {words} FROM {rows}),
{name}_b AS (SELECT *, CAST(list_min(list_filter(range(1, 17), lambda i: (1::BIGINT << (2 * i)) >= n)) AS BIGINT) AS b FROM {name}_n),
{name}_j AS (SELECT *, j AS x FROM (SELECT *, unnest(range(n)) AS j FROM {name}_b)),
{name}_w AS ({network(f'{name}_j')} UNION ALL {network(f'{name}_w WHERE x >= n')}),
{name} AS (SELECT {id_col}, j, x FROM {name}_w WHERE x < n)"""
