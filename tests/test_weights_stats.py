"""Label weights, losses and the exact Wilcoxon test."""

import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cvframe.operators import stats as J
from cvframe.operators import weights as W


def test_pos_weight_guards(spark):
    gold = spark.createDataFrame(
        [(i, int(i < 2), 0, 1, int(i % 2 == 0)) for i in range(8)], "post_id long, a int, b int, c int, d int")
    splits = spark.createDataFrame([(i, 0, 0, "TRAIN") for i in range(8)],
                                   "post_id long, repeat int, fold int, split string")
    w = {r["dim"]: r["weight"] for r in W.pos_weights(gold, splits, ["a", "b", "c", "d"]).collect()}
    assert w["a"] == pytest.approx(3.0)  # 6 neg / 2 pos
    assert w["b"] == 1.0  # zero positives
    assert w["c"] == 1.0  # only positives
    assert w["d"] == pytest.approx(1.0)  # balanced


def brute_p(diffs):
    """Two-sided exact p from enumerating all sign assignments."""
    d = [x for x in diffs if x != 0]
    n = len(d)
    if n == 0:
        return None
    a = sorted(abs(x) for x in d)
    ranks = {}
    for v in set(a):
        idx = [i + 1 for i, x in enumerate(a) if x == v]
        ranks[v] = sum(idx) / len(idx)
    r = [ranks[abs(x)] for x in d]
    wp = sum(ri for ri, x in zip(r, d) if x > 0)
    wm = sum(ri for ri, x in zip(r, d) if x < 0)
    t = min(wp, wm)
    cnt = sum(1 for signs in itertools.product([0, 1], repeat=n) if sum(ri for ri, s in zip(r, signs) if s) <= t + 1e-9)
    return min(1.0, 2 * cnt / 2 ** n), wp, wm


def test_wilcoxon_matches_brute_force(spark):
    rnd = random.Random(11)
    rows, expect = [], {}
    for g in range(25):
        n = rnd.randint(1, 10)
        a = [rnd.choice([1.0, 2.0, 3.0, 4.0]) for _ in range(n)]  # ties and zero differences
        b = [rnd.choice([1.0, 2.0, 3.0, 4.0]) for _ in range(n)]
        for i, (x, y) in enumerate(zip(a, b)):
            rows.append((f"m{g}", "A", "B", i, 0, x, y))
        expect[f"m{g}"] = brute_p([x - y for x, y in zip(a, b)])
    pairs = spark.createDataFrame(rows, "metric string, approach_a string, approach_b string, repeat int, fold int, "
                                        "value_a double, value_b double")
    out = {r["metric"]: r for r in J.wilcoxon(pairs).collect()}
    for m, e in expect.items():
        if e is None:
            assert out[m]["n"] == 0 and out[m]["p_value"] is None
        else:
            assert out[m]["p_value"] == pytest.approx(e[0], abs=1e-12)
            assert out[m]["w_plus"] == pytest.approx(e[1]) and out[m]["w_minus"] == pytest.approx(e[2])


def test_wilcoxon_all_zero_and_significance(spark):
    rows = [("m", "A", "B", i, 0, 1.0, 1.0) for i in range(5)]
    pairs = spark.createDataFrame(rows, "metric string, approach_a string, approach_b string, repeat int, fold int, "
                                        "value_a double, value_b double")
    r = J.significant_pairs(J.wilcoxon(pairs), 0.5).first()
    assert r["n"] == 0 and r["p_value"] is None and r["significant"] is None


def test_approach_pairs_unordered(spark):
    runs = spark.createDataFrame([(a, 0, 0, "mean_F1", v) for a, v in [("x", 1.0), ("y", 2.0), ("z", 3.0)]],
                                 "approach string, repeat int, fold int, metric string, value double")
    p = J.approach_pairs(runs).select("approach_a", "approach_b").collect()
    assert sorted(tuple(r) for r in p) == [("x", "y"), ("x", "z"), ("y", "z")]


@pytest.mark.parametrize("n", [25, 60, 61, 150])
def test_exact_at_every_n(spark, n):
    """The whole null distribution, counted with integers of any size."""
    rnd = random.Random(n)
    rows = [("m", "A", "B", i, 0, rnd.choice([1.0, 2.0, 3.5]) + 0.2, rnd.choice([1.0, 2.0, 3.5])) for i in range(n)]
    pairs = spark.createDataFrame(rows, "metric string, approach_a string, approach_b string, repeat int, fold int, "
                                        "value_a double, value_b double")
    r = J.wilcoxon(pairs).first()
    d = [a - b for *_, a, b in rows if a != b]
    ad = sorted(abs(x) for x in d)
    rank2 = {v: 2 * ad.index(v) + ad.count(v) + 1 for v in set(ad)}
    counts = {0: 1}
    for x in d:
        new = dict(counts)
        for k, c in counts.items():
            new[k + rank2[abs(x)]] = new.get(k + rank2[abs(x)], 0) + c
        counts = new
    t2 = min(sum(rank2[abs(x)] for x in d if x > 0), sum(rank2[abs(x)] for x in d if x < 0))
    p = min(1.0, 2 * sum(c for k, c in counts.items() if k <= t2) / 2 ** len(d))
    assert r["n_pairs"] == n and r["n"] == len(d) and r["p_value"] == pytest.approx(p, rel=1e-9)


def test_two_thousand_runs_in_seconds():
    n = 2000
    ranks = 2 * np.arange(1, n + 1)
    total = int(ranks.sum())
    start = time.perf_counter()
    half = J.lower_tail(ranks, total // 2)
    low = J.lower_tail(ranks, total // 2 - total // 40)
    assert time.perf_counter() - start < 60
    # the distribution is symmetric; far from the centre it follows the normal law closely
    assert 0.5 < half < 0.51
    sd = math.sqrt((ranks.astype(float) ** 2).sum()) / 2
    z = (total // 2 - total // 40 + 1 - total / 2) / sd
    assert low == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), rel=0.01)


def test_lower_tail_is_exact():
    for ranks in ([3, 1, 1], [2, 4, 6, 8], [5], [2] * 700):
        counts = {0: 1}
        for r in ranks:
            counts = {k: counts.get(k, 0) + counts.get(k - r, 0) for k in {*counts, *(x + r for x in counts)}}
        for t in range(0, sum(ranks) + 1, max(1, sum(ranks) // 7)):
            want = sum(c for k, c in counts.items() if k <= t) / 2 ** len(ranks)
            assert J.lower_tail(np.array(ranks), t) == pytest.approx(want, rel=1e-12)
