"""Joint training: whole results against a dense restatement, cells alone and
together, restart, step selection, one-pass scoring."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cvframe.operators import metrics as M
from cvframe.operators import splits as S
from cvframe.operators import training as TR
from cvframe.operators import weights as W

LABELS = ["a", "b"]
NF = 64


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(7)
    words = [f"w{i}" for i in range(40)]
    data = []
    for i in range(160):
        a, b = int(r.random() < 0.5), int(r.random() < 0.2)
        text = " ".join([*r.choice(words, 12), *(["good"] * 3 * a), *(["bad", "awful"] * b)])
        data.append((i, text, a, b if i % 17 else None))
    data += [(900, None, 1, 0), (901, "", 0, 1)]
    df = spark.createDataFrame(data, "post_id long, text string, a int, b int")
    bits = S.cell_bits(df.select("post_id", F.col("a"), F.coalesce("b", F.lit(0)).alias("b")), dims=LABELS)
    return TR.training_rows(df, bits, LABELS, num_features=NF)


def dense(rows):
    got = rows.orderBy("post_id").collect()
    x = np.zeros((len(got), NF + 1))
    for i, r in enumerate(got):
        x[i, r["terms"]] = r["weights"]
    x[:, -1] = 1
    cells = np.array([r["cells"] for r in got])
    gold, known = (np.array([[r[c] >> k & 1 for k in range(2)] for r in got], bool) for c in ("gold", "known"))
    return [r["post_id"] for r in got], x, cells, gold, known


def f1(y, p):
    scores = []
    for c in (True, False):
        tp, fp, fn = ((y == c) & (p == c)).sum(), ((y != c) & (p == c)).sum(), ((y == c) & (p != c)).sum()
        if tp + fp + fn:
            scores.append(2 * tp / (2 * tp + fp + fn))
    return sum(scores) / len(scores)


def restated(x, cells, gold, known, cell, k, weight, steps, decay):
    """One cell and label, trained alone on dense matrices: weights of every step."""
    split = cells >> 2 * (cell[0] * 5 + cell[1]) & 3
    train = split == 1
    n = train.sum()
    t = x[train]
    scale = np.log((n + 1) / ((t != 0).sum(0) + 1))
    scale[-1] = 1
    mean = scale * t.mean(0)
    mean[-1] = 0
    z = x * scale - mean
    on = train & known[:, k]
    y = gold[:, k]
    w = np.where(y, weight, 1.0)[on] / on.sum()
    shortest = 1 / (0.25 * max(weight, 1) * max(1.0, (z[train] ** 2).mean(0).sum()) + decay)
    shrink = np.full(NF + 1, decay)
    shrink[-1] = 0

    def loss_of(v):
        m = z[on] @ v
        return (w * (np.logaddexp(0, m) - y[on] * m)).sum() + 0.5 * (shrink * v * v).sum(), \
            z[on].T @ (w * (1 / (1 + np.exp(-m)) - y[on])) + shrink * v

    at = np.zeros(NF + 1)
    loss, g = loss_of(at)
    rate, recent, out = shortest, [loss], []
    for _ in range(steps):
        tried = at - rate * g
        loss, slope = loss_of(tried)
        if loss <= max(recent[-TR.RECENT:]) or rate <= shortest:
            s, d = tried - at, slope - g
            rate = np.clip(s @ s / (s @ d) if s @ d > 0 else np.inf, shortest, 1 / decay)
            at, g, recent = tried, slope, [*recent, loss]
        else:
            rate = max(rate / 4, shortest)
        out.append(at)
    return z, out


WEIGHTS = {(r, f, "b"): 4.0 for r in range(5) for f in range(5)}


def test_every_cell_equals_its_restatement(rows):
    ids, x, cells, gold, known = dense(rows)
    model = TR.train(rows, LABELS, WEIGHTS, num_features=NF, steps=9, every=3, decay=1e-2)
    history = {(r["repeat"], r["fold"], r["step"]): r["score"] for r in model.history.collect()}
    best = {(r["repeat"], r["fold"]): r["best_step"] for r in model.best.collect()}
    assert len(history) == 25 * 3 and len(best) == 25
    scored = {(r["repeat"], r["fold"], r["post_id"]): (r["split"], r["logit_0"], r["logit_1"])
              for r in TR.predict(model, rows).collect()}
    seen = 0
    for cell in TR.ALL_CELLS:
        split = cells >> 2 * (cell[0] * 5 + cell[1]) & 3
        runs = [restated(x, cells, gold, known, cell, k, (1.0, 4.0)[k], 9, 1e-2) for k in range(2)]
        for step in (3, 6, 9):
            per_label = [f1(gold[(split == 2) & known[:, k], k], (z @ w[step - 1] > 0)[(split == 2) & known[:, k]])
                         for k, (z, w) in enumerate(runs)]
            assert history[(*cell, step)] == pytest.approx(np.mean(per_label), abs=1e-9)
        top = max((3, 6, 9), key=lambda s: (history[(*cell, s)], -s))
        assert best[cell] == top
        for i, post in enumerate(ids):
            if split[i] == 1:
                assert (*cell, post) not in scored
                continue
            got = scored[(*cell, post)]
            seen += 1
            assert got[0] == {2: "VALID", 3: "TEST"}[split[i]]
            assert got[1:] == pytest.approx([z[i] @ w[top - 1] for z, w in runs], rel=1e-6, abs=1e-8)
    assert seen == len(scored)


def test_a_cell_alone_gets_the_same_weights(rows):
    together = TR.train(rows, LABELS, WEIGHTS, num_features=NF, steps=4, every=2)
    alone = TR.train(rows, ["a"], cells=[(3, 1)], num_features=NF, steps=4, every=4)
    rows_b = rows.withColumn("gold", F.expr("gold >> 1")).withColumn("known", F.expr("known >> 1"))
    second = TR.train(rows_b, ["b"], WEIGHTS, cells=[(3, 1)], num_features=NF, steps=4, every=4)
    at = TR.ALL_CELLS.index((3, 1)) * 2
    step = {(r["repeat"], r["fold"]): r["best_step"] for r in together.best.collect()}[3, 1]
    if step == 4:
        assert together.coefficients[:, at] == pytest.approx(alone.coefficients[:, 0], abs=1e-10)
        assert together.coefficients[:, at + 1] == pytest.approx(second.coefficients[:, 0], abs=1e-10)
    assert alone.coefficients.shape == (NF + 1, 1)


def test_a_restarted_run_ends_the_same(spark, rows, tmp_path):
    kw = dict(num_features=NF, every=2, cells=[(0, 0), (4, 4)])
    whole = TR.train(rows, LABELS, steps=6, **kw)
    folder = str(tmp_path / "run")
    TR.train(rows, LABELS, steps=2, folder=folder, **kw)
    again = TR.train(rows, LABELS, steps=6, folder=folder, **kw)
    assert (again.coefficients == whole.coefficients).all()
    key = ["repeat", "fold", "step"]
    assert again.history.orderBy(key).collect() == whole.history.orderBy(key).collect()
    # an append that did not get far is not a step
    spark.read.parquet(folder).where("step = 6 AND block < 0").withColumn("step", F.lit(8)).write.mode("append").parquet(folder)
    assert TR._saved_steps(spark, folder, TR.Shape(((0, 0), (4, 4)), tuple(LABELS), NF)) == [2, 4, 6]
    with pytest.raises(ValueError, match="another run"):
        TR.train(rows, LABELS, steps=6, folder=folder, decay=0.5, **kw)


def test_clamped_weights_are_those_of_the_operator(spark):
    df = spark.createDataFrame([(i, int(i % 7 == 0), int(i % 3 > 0)) for i in range(90)], "post_id long, a int, b int")
    splits = S.assign_splits(df, dims=LABELS)
    for r in W.pos_weights(df, splits, LABELS).collect():
        n, p = np.array([float(r["n_pos"] + r["n_neg"])]), np.array([float(r["n_pos"])])
        assert TR.clamped_weights(n, p)[0] == r["weight"]
    assert TR.clamped_weights(np.array([5.0, 0.0, 4.0]), np.array([0.0, 0.0, 3.0])).tolist() == [1.0, 1.0, 1.0]


def test_it_learns(rows, spark):
    model = TR.train(rows, LABELS, "clamped", num_features=NF)
    scored = TR.predict(model, rows, ("TEST",), ["post_id", "gold", "known"])
    pred = scored.selectExpr("'x' AS approach", "repeat", "fold", "CAST(gold & 1 AS INT) AS a",
                             "CASE WHEN known & 2 > 0 THEN CAST(gold >> 1 AS INT) END AS b",
                             "CAST(logit_0 > 0 AS INT) AS pred_a", "CAST(logit_1 > 0 AS INT) AS pred_b")
    mean = {r["dim"]: r["f"] for r in M.macro_prf(M.confusion_counts(pred, dims=LABELS)).groupBy("dim").agg(F.avg("macro_f1").alias("f")).collect()}
    assert mean["a"] > 0.85 and mean["b"] > 0.85        # a constant gets 0.35 and 0.45


def test_constant_labels_and_empty_tables(spark, rows):
    same = rows.withColumn("gold", F.lit(1).cast("long")).withColumn("known", F.lit(3).cast("long"))
    model = TR.train(same, LABELS, num_features=NF, cells=[(0, 0)], steps=3)
    out = TR.predict(model, same).collect()
    assert all(r["logit_0"] > 0 > r["logit_1"] for r in out)
    none = TR.train(rows.where("false"), LABELS, num_features=NF, cells=[(0, 0)], steps=2)
    assert not none.coefficients.any() and TR.predict(none, rows.where("false")).count() == 0


def test_a_long_text_is_scaled_in_one_go(spark):
    n = 30_000
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)) + " w7" * 4), (2, "")], "post_id long, text string")
    out = TR.term_features(df, num_features=1 << 20)
    # the sum of squares is not part of what is done for each term
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"lambda \w+#\w+ / [^,]*aggregate\(", plan)
    got = {r["post_id"]: r for r in out.collect()}
    w = np.array(got[1]["weights"])
    assert len(w) > 0.98 * n - 1000 and (w * w).sum() == pytest.approx(1, abs=1e-4)
    assert got[2]["weights"] == [] == got[2]["terms"]


def test_blocks_multiply_as_dense_matrices():
    r = np.random.default_rng(8)
    x = np.where(r.random((40, 30)) < 0.2, r.random((40, 30)), 0).astype(np.float32).astype(float)
    x[5] = x[39] = x[:, 3] = 0
    lists = [np.flatnonzero(row).astype(np.int32) for row in x]
    batch = pa.record_batch([pa.array(lists, pa.list_(pa.int32())), pa.array([row[t] for row, t in zip(x, lists)], pa.list_(pa.float32()))],
                            names=["terms", "weights"])
    for at in (slice(0, 40), slice(4, 6), slice(5, 6), slice(11, 40)):
        block = TR.Rows(batch.slice(at.start, at.stop - at.start), 30)
        whole = np.column_stack([x[at], np.ones(at.stop - at.start)])
        c, per_row = r.normal(size=(31, 4)), r.normal(size=(at.stop - at.start, 4))
        assert block.times(c) == pytest.approx(whole @ c)
        one, two = np.ones((31, 4)), np.ones((31, 8))
        block.add_to(one, per_row)
        block.add_to(two, per_row, lambda w: np.stack([w, w * w]))
        assert one == pytest.approx(1 + whole.T @ per_row)
        assert two == pytest.approx(1 + np.hstack([whole.T @ per_row, (whole * whole).T @ per_row]))
        # nothing as large as rows x terms is built
        assert all(getattr(v, "size", 0) <= max(len(block.terms), len(whole)) for v in vars(block).values())


def test_limits():
    with pytest.raises(ValueError, match="too large"):
        TR.Shape(tuple(TR.ALL_CELLS), tuple("abcdefgh"), 1 << 22)


def test_cell_bits_hold_every_split(spark):
    df = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(57)], "post_id long, a int, b int")
    long = S.assign_splits(df, dims=LABELS)
    bits = S.cell_bits(df, dims=LABELS)
    want = sorted(map(tuple, long.select("post_id", "repeat", "fold", "split").collect()))
    got = sorted((r["post_id"], c, f, {1: "TRAIN", 2: "VALID", 3: "TEST"}[r["cells"] >> 2 * (c * 5 + f) & 3])
                 for r in bits.collect() for c in range(5) for f in range(5))
    assert got == want
    part = bits.where(S.in_split(F.col("cells"), 2, 3, "VALID")).select("post_id")
    assert sorted(r[0] for r in part.collect()) == sorted(i for i, c, f, s in want if (c, f, s) == (2, 3, "VALID"))
    wide = S.assign_splits_wide(df, dims=LABELS).select("post_id", S.wide_bits().alias("cells"))
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, bits.select("post_id", "cells").collect()))
    with pytest.raises(ValueError, match="31 cells"):
        S.cell_bits(df, dims=LABELS, k=10)


def test_null_labels_are_a_group_of_their_own(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else 1, i % 2) for i in range(60)], "post_id long, a int, b int")
    per = S.assign_splits(df, dims=LABELS).where("split = 'TEST'").groupBy("repeat", "fold").count().collect()
    assert len(per) == 25 and all(r["count"] == 12 for r in per)
    assert S.iterative_stratify(df, dims=LABELS).where("fold IS NULL").count() == 0
