"""Macro P/R/F1 against a direct re-implementation of the averaging rule,
plus the hand-written edge cases."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from cvframe.functions.link import argmax2, threshold
from cvframe.operators import metrics as M


def macro_ref(y, p):
    """Average over classes present in y or p; undefined ratios are 0."""
    labels = sorted(set(y) | set(p))
    P = R = F1 = 0.0
    for c in labels:
        tp = sum(1 for a, b in zip(y, p) if a == c and b == c)
        fp = sum(1 for a, b in zip(y, p) if a != c and b == c)
        fn = sum(1 for a, b in zip(y, p) if a == c and b != c)
        P += tp / (tp + fp) if tp + fp else 0.0
        R += tp / (tp + fn) if tp + fn else 0.0
        F1 += 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0
    n = len(labels)
    return P / n, R / n, F1 / n


def run_macro(spark, y, p):
    df = spark.createDataFrame([(0, a, b) for a, b in zip(y, p)], "k int, y int, p int")
    conf = M.confusion_counts(df, keys=["k"], dims=["y"], gold_fmt="y", pred_fmt="p")
    r = M.macro_prf(conf).first()
    return r["precision"], r["recall"], r["macro_f1"]


CASES = [
    ([0, 0, 0, 0], [0, 0, 0, 0]),  # label never seen and never predicted -> 1.0
    ([1, 1, 1], [1, 1, 1]),
    ([0, 1, 0, 1], [1, 0, 1, 0]),
    ([0, 0, 1], [0, 0, 0]),  # never predicted positive: precision of class 1 undefined -> 0
    ([0, 0, 0], [1, 0, 0]),
]


@pytest.mark.parametrize("y,p", CASES)
def test_macro_edge_cases(spark, y, p):
    got = run_macro(spark, y, p)
    assert got == pytest.approx(macro_ref(y, p))


def test_macro_random(spark):
    rnd = random.Random(3)
    rows, expect = [], {}
    for k in range(30):
        n = rnd.randint(1, 12)
        y = [rnd.randint(0, 1) for _ in range(n)]
        p = [rnd.randint(0, 1) for _ in range(n)]
        rows += [(k, a, b) for a, b in zip(y, p)]
        expect[k] = macro_ref(y, p)
    df = spark.createDataFrame(rows, "k int, y int, p int")
    out = M.macro_prf(M.confusion_counts(df, keys=["k"], dims=["y"], gold_fmt="y", pred_fmt="p")).collect()
    for r in out:
        assert (r["precision"], r["recall"], r["macro_f1"]) == pytest.approx(expect[r["k"]])


def test_threshold_half_goes_to_zero(spark):
    df = spark.createDataFrame([(0.0,), (1e-12,), (-1e-12,)], "x double")
    got = [r[0] for r in df.select(threshold(F.col("x"))).collect()]
    assert got == [0, 1, 0]


def test_argmax_tie_goes_to_first(spark):
    df = spark.createDataFrame([(0.3, 0.3), (0.1, 0.2), (0.2, 0.1)], "a double, b double")
    got = [r[0] for r in df.select(argmax2(F.col("a"), F.col("b"))).collect()]
    assert got == [0, 1, 0]


def test_best_checkpoint_first_wins(spark):
    h = spark.createDataFrame(
        [("a", 0, 0, 250, 0.5), ("a", 0, 0, 500, 0.7), ("a", 0, 0, 750, 0.7), ("a", 0, 0, 1000, 0.1)],
        "approach string, repeat int, fold int, step int, score double")
    r = M.best_checkpoint(h).first()
    assert r["best_step"] == 500 and r["best_score"] == 0.7


def test_run_records_wide(spark):
    rows = [("a", 0, 0, d, 0.5, 0.5, 0.5) for d in ["x", "y"]]
    pl = spark.createDataFrame(rows, "approach string, repeat int, fold int, dim string, precision double, "
                                     "recall double, macro_f1 double")
    rec = M.run_records(pl, dims=["x", "y"]).first()
    assert rec["eval_x_macroF1"] == 0.5 and rec["eval_mean_F1"] == 0.5


def test_null_and_nan_are_left_out_and_counted(spark):
    preds = spark.createDataFrame([("a", 1, 2.0), ("a", 2, float("nan")), ("a", 3, None), ("a", 4, -1.0)],
                                  "approach string, post_id long, logit_0 double")
    p01 = {r["post_id"]: r["pred_x"] for r in M.predicted_labels(preds, ["x"]).collect()}
    assert p01 == {1: 1, 2: None, 3: None, 4: 0}
    gold = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, None), (5, 1)], "post_id long, x int")
    splits = spark.createDataFrame([(i, 0, 0, "TEST") for i in range(1, 6)], "post_id long, repeat int, fold int, split string")
    conf = M.confusion_counts(M.test_rows(M.predicted_labels(preds, ["x"]), gold, splits), dims=["x"]).first()
    assert (conf["tp"], conf["fp"], conf["fn"], conf["tn"]) == (1, 0, 0, 0)
    gap = M.unscored(preds, splits).first()
    assert (gap["n_posts"], gap["n_missing"], gap["n_invalid"]) == (5, 1, 2)


def test_variants_are_scored_apart(spark, sf_small):
    """Three variants in one job equal three separate runs."""
    from cvframe.operators import grid as K
    from cvframe.operators import splits as S
    from cvframe.operators import weights as W
    from cvframe.plans import fixtures as fx
    from cvframe.plans.evaluate import per_label_metrics
    from cvframe.sources.corpus_io import union_variants

    docs = fx.table(spark, sf_small, "documents", ["doc_id", "source", "text"])
    frames = {v: fx.corpus_from_documents(docs, v).drop("issue", "post_text") for v in ("full", "majority", "conservative")}
    by = ["dataset_version"]
    gold = union_variants(frames)
    preds = fx.preds(spark, sf_small).filter("approach = 0")
    splits = S.assign_splits(gold, by=by, keep_code=True).cache()

    def tables(g, s, b):
        w = W.pos_weights(g, s, by=b)
        return {"weights": w, "majority": K.majority_baseline(g, s, by=b), "random": K.random_baseline(g, s, by=b),
                "metrics": per_label_metrics(preds, g, s, by=b), "bce": W.bce_loss(preds, g, s, w, by=b),
                "ce": W.cross_entropy(preds, g, s, by=b), "mse": W.mse_loss(preds, g, s, by=b), "grid": K.cv_grid(s, ["a"], by=b)}

    def rows(df):
        cols = sorted(df.columns)
        return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect())

    together = tables(gold, splits, by)
    plain = splits.drop(S.CODE)
    joined = tables(gold, plain, by)
    for v in ("full", "conservative"):
        alone = tables(frames[v], S.assign_splits(frames[v], keep_code=True), [])
        for name, df in alone.items():
            want = rows(df)
            assert want == rows(together[name].filter(F.col(by[0]) == v).drop(*by)), (v, name)
            if name in ("weights", "metrics", "random"):    # the label join gives the same as the codes
                assert want == rows(joined[name].filter(F.col(by[0]) == v).drop(*by)), (v, name)
    cell = S.split_rows(gold, plain, 0, 0, "TRAIN", by=by).filter("dataset_version = 'full'").count()
    assert cell == S.assign_splits(frames["full"]).filter("repeat = 0 AND fold = 0 AND split = 'TRAIN'").count()
    splits.unpersist()
