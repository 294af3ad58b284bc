import numpy as np
import pytest
from pyspark.sql import functions as F

from cvframe.llm import impact_topk, prefix_forest
from cvframe.llm.impact_topk import ImpactIndex

SCHEMA = "vec_id long, embedding array<float>, rank int, score double"
ODD = [(None, [1.0] * 4), (901, None), (902, [1.0, None, 0.0, 0.0]), (903, [float("nan")] * 4), (904, [float("inf"), 0, 0, 0]), (905, [])]


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 0.5) for i, v in rows], SCHEMA)


def brute(vectors, k, step, exact=True):
    out = {}
    for q, v in vectors.items():
        if q % step == 0:
            own = [(-(float(np.cumsum(np.float64(v) * w)[-1])), c) for c, w in vectors.items() if c != q and len(w) == len(v)]
            out[q] = [(c, -s) for s, c in sorted(own)[:k]]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], float(r["score"])))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_index_against_brute_force():
    rng = np.random.default_rng(0)
    for low, high, dim in ((-5, 6, 6), (0, 3, 3), (-300, 300, 30), (-2, 1, 4)):
        x = rng.integers(low, high, (150, dim))
        ids = np.arange(150) * 3
        index = ImpactIndex(ids, x)
        for q in range(0, 150, 11):
            scores = x @ x[q]
            order = [i for i in np.lexsort((ids, -scores)) if i != q][:7]
            got = index.top(x[q], 7, q * 3)
            assert got[0].tolist() == ids[order].tolist() and got[1].tolist() == scores[order].tolist()


@pytest.mark.parametrize("blocks", [(2048, 32768), (3, 20)])
def test_exact_top_k(spark, blocks):
    rng = np.random.default_rng(1)
    data = {i: rng.normal(size=4) for i in range(120)}
    data |= {200 + i: np.array([0.5, 0.5, -0.25, 0]) for i in range(40)} | {300: np.zeros(4), 310: np.ones(3), 311: -np.ones(3)}
    rows = list(data.items()) + ODD + [(7, data[7])]      # a repeated row counts once
    got = result(impact_topk.top_k(frame(spark, rows).repartition(4), F.col("vec_id") % 10 == 0, 5,
                                   query_block=blocks[0], candidate_block=blocks[1]))
    whole = {i: np.floor(256 * np.float64(np.float32(v))) for i, v in data.items()}
    assert got == brute(whole, 5, 10)


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    data = {i: rng.normal(size=8) for i in range(400)}
    data |= {500 + i: data[40] * 3 for i in range(60)}     # equal vectors tie; norms differ
    rows = list(data.items()) + ODD + [(600, [0.0] * 8)]
    got = result(prefix_forest.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, 20, candidate_block=150))
    want = brute({i: np.float64(np.float32(v)) for i, v in data.items()}, 20, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    recall = np.mean([len({c for c, _ in got[q]} & {c for c, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9
    assert got[40] == want[40]
    exact = {q: dict(brute({i: np.float64(np.float32(v)) for i, v in data.items()}, 999, 20)[q]) for q in list(want)[:3]}
    assert all(exact[q][c] == s for q in exact for c, s in got[q])


def test_recall_on_the_table(spark, sf_small):
    df = spark.read.parquet(f"{sf_small}/embeddings.parquet")
    got = result(prefix_forest.nearest(df, F.col("vec_id") % 20 == 0, 20))
    want = brute({r["vec_id"]: np.float64(np.float32(r["embedding"])) for r in df.collect()}, 20, 20)
    assert np.mean([len({c for c, _ in got[q]} & {c for c, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_few_and_none(spark):
    two = frame(spark, [(0, [1, 0]), (1, [0, 1])])
    assert result(impact_topk.top_k(two, F.col("vec_id") == 0, 5)) == {0: [(1, 0.0)]}
    assert result(prefix_forest.nearest(two, F.col("vec_id") == 0, 20)) == {0: [(1, 0.0)]}
    none = frame(spark, [(9, [1, 0])]).limit(0)
    assert impact_topk.top_k(none, F.col("vec_id") == 0, 5).collect() == []
    assert prefix_forest.nearest(none, F.col("vec_id") == 0, 5).collect() == []
    assert impact_topk.top_k(frame(spark, [(0, [1, 0])]), F.col("vec_id") == 0, 5).collect() == []


@pytest.mark.parametrize("search", [impact_topk.top_k, prefix_forest.nearest])
def test_every_vector_of_an_id_counts(spark, search):
    rows = [(0, [1, 0]), (0, [1, 0]), (1, [2, 0]), (1, [3, 0]), (1, [3, 0]), (2, [1, 1]), (10, [0, 1]), (10, [0, 2])]
    got = search(frame(spark, rows), F.col("vec_id") % 10 == 0, 9).select("query_id", "vec_id", "score").collect()
    scale = 256 ** 2 if search is impact_topk.top_k else 1
    kept = sorted({(i, tuple(v)) for i, v in rows})
    want = [(q, c, scale * (a * x + b * y)) for q, (a, b) in kept for c, (x, y) in kept if q % 10 == 0 and c != q]
    want = [w for q in (0, 10) for w in sorted((w for w in want if w[0] == q), key=lambda w: (-w[2], w[1]))[:9]]
    assert sorted((r[0], r[1], float(r[2])) for r in got) == sorted((q, c, float(s)) for q, c, s in want)
