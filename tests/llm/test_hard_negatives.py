"""Hard negatives: the Strassen product, heaps, and whole results by brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cvframe.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, is_anchor, k=5, m=5, low=80, high=100):
    """Contract by its words; rows are (id, vector, label)."""
    good = {(i, lab, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, lab in rows
            if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for ai, al, av in good:
        if not is_anchor(ai):
            continue
        scored = [(-sum(x * y for x, y in zip(av, v)), i, lab) for i, lab, v in good if i != ai and len(v) == len(av)]
        for p, pi, _ in sorted(s for s in scored if s[2] == al)[:k]:
            inside = sorted((n, i) for n, i, lab in scored if lab != al and low * -p <= high * -n <= high * -p)
            out += [(ai, pi, r + 1, i, -p, -n) for r, (n, i) in enumerate(inside[:m])]
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    out = H.mine(df, F.col("vec_id") % 3 == 0, **kw)
    return sorted(map(tuple, out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


SHAPES = [(1, 1, 1), (3, 5, 7), (33, 40, 35), (64, 64, 64), (70, 81, 129)]


@pytest.mark.parametrize("shape,leaf", [(s, k) for s in SHAPES for k in (1, 4, 32) if k > 1 or max(s) < 50])
def test_strassen_is_exact(shape, leaf):
    m, c, d = shape
    r = np.random.default_rng(m)
    a, b = r.integers(-2**20, 2**20, (m, d)), r.integers(-2**20, 2**20, (c, d))
    assert (H.strassen(a, b, leaf) == a @ b.T).all()


def test_heaps_merge_in_any_order():
    r = np.random.default_rng(5)
    owner, score, ids = r.integers(0, 4, 200), r.integers(-3, 3, 200), r.permutation(200)
    want = H.Heaps(4, 6)
    want.offer(owner, score, ids)
    parts = np.array_split(r.permutation(200), 7)
    got = H.Heaps(4, 6)
    for p in parts:
        single = H.Heaps(4, 6)
        single.offer(owner[p], score[p], ids[p])
        got.offer(*single.entries())
    assert (got.score == want.score).all() and (got.id == want.id).all()
    for o in range(4):
        best = sorted((-s, i) for w, s, i in zip(owner, score, ids) if w == o)[:6]
        assert list(zip(-got.score[o], got.id[o])) == best


@pytest.mark.parametrize("block_bytes", [1 << 20, 8 * 5 * 16])
def test_whole_result_by_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(H, "TILE_ANCHORS", 7)
    monkeypatch.setattr(H, "TILE_ROWS", 11)
    r = np.random.default_rng(3)
    rows = [(i, r.normal(0, 0.4, 5).round(2).tolist(), int(r.integers(0, 3))) for i in range(90)]
    rows += [(200 + i, [0.5, 0.5, 0.5, 0.5, 0.5], i % 2) for i in range(40)]       # ties: one hot vector
    rows += [rows[3], (6, [0.1] * 5, 2), (6, [0.1] * 5, 1), (9, [0.0] * 5, 0)]      # repeated row, ids with several rows
    rows += [(500 + i, [-0.9, 0.0, 0.0, 0.1 * i, 0.0], i % 3) for i in range(6)]
    rows += [(600, [1.0, 2.0], 1), (601, [1.0, 2.0], 1), (602, [1.0, 1.9], 0), (603, [3.0, 1.0], 0)]   # another length
    rows += [(700, None, 1), (701, [0.5, None, 0.5, 0.5, 0.5], 1), (702, [0.5, math.nan, 0.5, 0.5, 0.5], 1),
             (703, [math.inf] * 5, 1), (None, [0.5] * 5, 1), (704, [0.5] * 5, None), (705, [], 1)]
    want = brute(rows, lambda i: i % 3 == 0)
    assert want and mined(spark, rows, block_bytes=block_bytes) == want


def test_few_rows_and_none(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(3, [1.0], 1)]) == []                                            # no other row
    assert mined(spark, [(3, [1.0], 1), (4, [1.0], 1)]) == []                              # no negative
    assert mined(spark, [(3, [1.0], 1), (4, [1.0], 1), (5, [1.0], 2)]) == [(3, 4, 1, 5, 65536, 65536)]
    # a negative positive has an empty window, a zero one takes zeros
    assert mined(spark, [(3, [1.0], 1), (4, [-1.0], 1), (5, [-1.0], 2)]) == []
    assert mined(spark, [(3, [1.0], 1), (4, [0.0], 1), (5, [0.0], 2)]) == [(3, 4, 1, 5, 0, 0)]


def test_clashing_columns(spark):
    rows = [(3, [1.0], 1), (4, [1.0], 1), (5, [1.0], 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    df = df.selectExpr("*", "1 AS v", "2 AS x", "3 AS score", "4 AS id", "5 AS key", "6 AS cb", "7 AS dim", "8 AS is_anchor", "9 AS `a.b`")
    assert H.mine(df, F.col("vec_id") == 3).count() == 1


def test_too_large_components_are_refused():
    import pyarrow as pa

    batch = pa.record_batch([pa.array([1]), pa.array([1]), pa.array([[1 << 40]], pa.list_(pa.int64()))], names=["vec_id", "label", "v"])
    with pytest.raises(OverflowError):
        next(H._Block([batch]).tiles(batch))
