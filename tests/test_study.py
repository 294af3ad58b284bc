"""The three study stages end to end on study-format inputs."""

import tempfile

from pyspark.sql import functions as F

from cvframe.operators import metrics as M
from cvframe.operators import splits as S
from cvframe.plans import fixtures as fx
from cvframe.plans import study
from cvframe.plans.evaluate import per_label_metrics
from cvframe.schema import RENAME_LABELS, snake
from cvframe.sources import corpus_io as C
from cvframe.sources import runs_io as RIO


def test_prepare_evaluate_compare(spark, sf_small):
    root = tempfile.mkdtemp(prefix="cvframe-study-")
    docs = fx.table(spark, sf_small, "documents", ["doc_id", "source", "text"])
    old_names = {snake(new): old for old, new in RENAME_LABELS.items()}
    paths = {}
    for v in ("full", "majority"):
        c = C.display_names(fx.corpus_from_documents(docs, v))
        c = c.withColumnsRenamed({snake_new_disp: old for snake_new_disp, old in
                                  [(dict(zip([snake(x) for x in c.columns], c.columns))[k], o)
                                   for k, o in old_names.items()]})
        paths[v] = f"{root}/{v}.csv"
        C.write_corpus_csv(c, paths[v])
    prepared = study.prepare_study(spark, paths, f"{root}/prepared")
    assert prepared.count() == 2 * docs.count()
    assert "fold4_4" in prepared.columns and "intelligibility" in prepared.columns

    maj = prepared.filter(F.col("dataset_version") == "majority")
    preds = fx.preds(spark, sf_small)
    rec = study.evaluate_study(maj, preds)
    # same numbers as the per-operator plan on the same data
    g = fx.gold(spark, sf_small)
    ref = M.run_records(per_label_metrics(preds, g, S.test_split(g)))
    cols = rec.columns
    assert rec.exceptAll(ref.select(*cols)).count() == 0 and rec.count() == ref.count() == 75

    RIO.write_runs(rec, f"{root}/runs")
    out = study.compare_study(RIO.read_runs(spark, f"{root}/runs"))
    board = out["leaderboard"].collect()
    assert [r["approach"] for r in board] == [0, 1, 2] or [r["rank"] for r in board] == [1, 2, 3]
    sig = out["significance"].collect()
    assert len(sig) == 3 * 15  # 3 pairs x (14 label F1 + mean F1)
    assert all(r["n"] > 0 for r in sig)
    lines = out["latex"].collect()
    assert len(lines) == 4 + 3 + 2

    binary = study.evaluate_study(maj, preds, kind="binary")
    assert "eval_appropriateness_macroF1" in binary.columns and binary.count() == 75
    fixed = study.evaluate_study(maj, preds, repair="reference")
    assert fixed.count() == 75


def test_cli_compare_writes_report(spark):
    import os

    root = tempfile.mkdtemp(prefix="cvframe-cli-")
    wide = spark.createDataFrame(
        [(a, r, f, 0.5 + 0.1 * i + 0.001 * (r * 5 + f)) for i, a in enumerate(["x", "y"]) for r in range(5)
         for f in range(5)], "approach string, repeat int, fold int, eval_mean_F1 double")
    RIO.write_runs(wide, f"{root}/runs")
    study.main(["compare", "--runs", f"{root}/runs", "--out", f"{root}/report"])
    board = spark.read.parquet(f"{root}/report/leaderboard").orderBy("rank").collect()
    assert [r["approach"] for r in board] == ["y", "x"]
    sig = spark.read.parquet(f"{root}/report/significance").first()
    assert sig["n"] == 25 and sig["significant"]
    assert any(n.startswith("part-") for n in os.listdir(f"{root}/report/table.tex"))


def test_two_logits_missing_predictions_and_cell_models(spark, sf_small):
    import pytest

    prepared = study.prepare_corpus(
        fx.corpus(spark, sf_small).withColumn("dataset_version", F.lit("v"))).cache()
    gold = prepared.select("post_id", "appropriateness")
    y = F.col("appropriateness").cast("double")
    perfect = gold.select(F.lit("p").alias("approach"), "post_id", (1 - y).alias("logit_0"), y.alias("logit_1"))
    rec = study.evaluate_study(prepared, perfect, kind="binary")
    assert rec.count() == 25 and all(r["eval_appropriateness_macroF1"] == 1.0 for r in rec.collect())
    half = perfect.filter("post_id % 2 = 0")
    with pytest.raises(ValueError, match="have no prediction"):
        study.evaluate_study(prepared, half, kind="binary")
    assert study.evaluate_study(prepared, half, kind="binary", allow_missing=True).count() == 25
    # one model per cell: each cell sees its own scores only
    cells = S.assign_splits(fx.gold(spark, sf_small)).filter("split = 'TEST'")
    wrong = (F.col("repeat") == 1) & (F.col("fold") == 2)
    own = cells.join(gold, "post_id").select(
        F.lit("c").alias("approach"), "repeat", "fold", "post_id", *[
            F.when(wrong, v).otherwise(w).alias(n) for n, v, w in (("logit_0", y, 1 - y), ("logit_1", 1 - y, y))])
    got = {(r["repeat"], r["fold"]): r["eval_appropriateness_macroF1"] for r in study.evaluate_study(prepared, own, kind="binary").collect()}
    assert got[1, 2] == 0.0 and all(v == 1.0 for k, v in got.items() if k != (1, 2))
    prepared.unpersist()


def test_report_without_its_headline_is_refused(spark):
    import pytest

    runs = spark.createDataFrame([("x", 0, 0, "loss", 1.0)], "approach string, repeat int, fold int, metric string, value double")
    with pytest.raises(ValueError, match="mean_F1"):
        study.compare_study(runs)


def test_train_stage_fits_all_labels_of_all_cells(spark, sf_small):
    """The whole study: prepared corpus -> 14 labels x 25 cells -> run records."""
    root = tempfile.mkdtemp(prefix="cvframe-train-")
    posts = fx.corpus(spark, sf_small).withColumn("dataset_version", F.lit("v"))
    prepared = study.prepare_corpus(posts)
    prepared.write.parquet(f"{root}/prepared")
    study.main(["train", "--prepared", f"{root}/prepared", "--variant", "v", "--out", f"{root}/fit", "--num-features", "256",
                "--steps", "2", "--every", "1"])
    preds = spark.read.parquet(f"{root}/fit/preds")
    n = posts.count()
    assert preds.count() == 5 * n and len([c for c in preds.columns if c.startswith("logit_")]) == 14
    history = spark.read.parquet(f"{root}/fit/history")
    assert history.count() == 50 and history.where("score NOT BETWEEN 0 AND 1").count() == 0
    rec = study.evaluate_study(spark.read.parquet(f"{root}/prepared").where("dataset_version = 'v'"), preds)
    assert rec.count() == 25
    binary = study.train_study(spark.read.parquet(f"{root}/prepared"), f"{root}/one", kind="binary", num_features=64, steps=1, every=1)
    assert [c for c in binary.columns if c.startswith("logit_")] == ["logit_0"] and binary.count() == 5 * n


def test_several_variants_are_evaluated_apart(spark, sf_small):
    root = tempfile.mkdtemp(prefix="cvframe-by-")
    docs = fx.table(spark, sf_small, "documents", ["doc_id", "source", "text"])
    both = C.union_variants({v: fx.corpus_from_documents(docs, v) for v in ("full", "conservative")})
    prepared = study.prepare_corpus(both)
    prepared.write.parquet(f"{root}/prepared")
    preds = fx.preds(spark, sf_small)
    preds.write.parquet(f"{root}/preds")
    study.main(["evaluate", "--prepared", f"{root}/prepared", "--variant", "full", "--variant", "conservative", "--preds", f"{root}/preds",
                "--out", f"{root}/runs"])
    prepared = spark.read.parquet(f"{root}/prepared")
    for v in ("full", "conservative"):
        alone = study.evaluate_study(prepared.where(F.col("dataset_version") == v), preds)
        got = {(r["approach"], r["repeat"], r["fold"], r["metric"]): r["value"] for r in RIO.read_runs(spark, f"{root}/runs/{v}").collect()}
        want = alone.select("approach", "repeat", "fold", "eval_mean_F1").collect()
        assert len(want) == 75
        assert all(abs(got[str(r["approach"]), r["repeat"], r["fold"], "mean_F1"] - r["eval_mean_F1"]) < 1e-12 for r in want)
