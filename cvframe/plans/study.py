"""The study's four stages as Spark jobs, callable from Python or the shell.

* ``prepare``  corpus variants (CSV, study format) -> per-variant 5 x 5
               stratified splits, ``arg_issue``, current label names ->
               partitioned parquet (one folder per variant).
* ``train``    the prepared corpus -> TEST logits of every cell's own model
               (all cells and labels in one fit) and the VALID history.
* ``evaluate`` a prediction table ``(approach, post_id, logit_0..)`` and the
               prepared corpus -> TEST metrics of every run -> run records in
               the partitioned or the study's layout (``eval_<label>_
               {precision,recall,macroF1}``, ``eval_mean_*``).
* ``compare``  run records (partitioned or the study's folder layout) ->
               leaderboard, LaTeX table and paired exact Wilcoxon tests.

Each stage writes its outputs to the given (shared) paths; nothing but
small result tables reaches the driver.

    python -m cvframe.plans.study prepare --variant full=a.csv --variant majority=b.csv --out prepared/
    python -m cvframe.plans.study train --prepared prepared/ --variant majority --out fit/
    python -m cvframe.plans.study evaluate --prepared prepared/ --variant majority --preds preds/ --out runs/
    python -m cvframe.plans.study compare --runs runs/ --layout partitioned --out report/
"""

from __future__ import annotations

import argparse
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cvframe.operators import runs as R
from cvframe.operators import scoring as G
from cvframe.operators import stats as J
from cvframe.operators.metrics import CELL, confusion_counts, macro_prf, predicted_labels, run_records, test_rows, unscored
from cvframe.operators.splits import wide_bits
from cvframe.operators.training import EVERY, NUM_FEATURES, STEPS, train_cells
from cvframe.plans.prepare import prepare_corpus, write_prepared
from cvframe.schema import KFOLD_SEEDS, LABEL_COLS, N_FOLDS
from cvframe.session import written
from cvframe.sources import corpus_io as C
from cvframe.sources import runs_io as RIO


def prepare_study(spark: SparkSession, variants: Mapping[str, str], out: str, fmt: str = "parquet") -> DataFrame:
    """Stage 1: read every variant CSV (by header name), split, write."""
    corpus = C.read_variants(spark, variants, by_name=True, split=True)
    prepared = prepare_corpus(corpus)
    write_prepared(prepared, out, fmt=fmt)
    return spark.read.format(fmt).load(out) if fmt != "csv" else spark.read.options(**C.READ_OPTIONS).csv(out)


def train_study(prepared: DataFrame, out: str, kind: str = "multilabel", approach: str = "logistic", text_col: str = "arg_issue",
                dims: Sequence[str] = LABEL_COLS, **kw) -> DataFrame:
    """Fits every cell of one prepared variant and scores its TEST posts.

    ``kind='binary'``: the root label alone, unweighted; ``'multilabel'``: all
    labels, positives weighted per cell.  Writes ``out/preds`` (what
    ``evaluate`` reads), ``out/history`` (VALID score of each saved step),
    ``out/best`` and the optimiser's states in ``out/steps``; run again with
    the same ``out`` it goes on where it stopped."""
    labels = list(dims[:1] if kind == "binary" else dims)
    bits = prepared.select("post_id", wide_bits().alias("cells"))
    weights = None if kind == "binary" else "clamped"
    preds, model = train_cells(prepared, bits, labels, weights, approach, text_col, folder=f"{out}/steps", **kw)
    preds.write.mode("overwrite").parquet(f"{out}/preds")
    model.history.write.mode("overwrite").parquet(f"{out}/history")
    model.best.write.mode("overwrite").parquet(f"{out}/best")
    return prepared.sparkSession.read.parquet(f"{out}/preds")


def _test_cells_from_wide(prepared: DataFrame, id_col: str = "post_id", by: Sequence[str] = ()) -> DataFrame:
    """``(by.., id, repeat, fold, 'TEST')``: per repeat, the one cell whose split
    column says TEST - five rows per post, never the 25-cell long form."""
    def test_fold(r: int) -> str:
        whens = " ".join(f"WHEN `fold{r}_{f}` = 'TEST' THEN {f}" for f in range(N_FOLDS))
        return f"CASE {whens} END"

    entries = ", ".join(f"named_struct('repeat', {r}, 'fold', {test_fold(r)}, 'split', 'TEST')"
                        for r in range(len(KFOLD_SEEDS)))
    return prepared.selectExpr(*[f"`{b}`" for b in by], f"`{id_col}`", f"inline(array({entries}))").filter(F.col("fold").isNotNull())


def evaluate_study(prepared: DataFrame, preds: DataFrame, kind: str = "multilabel", repair: str | None = None,
                   dims: Sequence[str] = LABEL_COLS, allow_missing: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Stage 2: wide run records for every approach and cell on TEST.

    ``by`` columns of ``prepared`` (``dataset_version``) evaluate several
    variants in one plan: each is scored on its own splits and labels, with
    its own predictions if those carry the columns, and the records do.

    ``kind='binary'`` scores the root label: with columns ``logit_0`` and
    ``logit_1`` alone these are the two classes' logits, else ``logit_0`` is
    one score x that stands for ``(-x, x)``.  ``repair`` in {None,
    'reference', 'corrected'} applies the hierarchy repair before scoring
    (the study's opt-in flag).  Predictions may carry ``repeat`` and ``fold``
    (one model per cell); they then meet their own cell only.

    A TEST post without a prediction, or with a NULL or NaN logit, is refused
    unless ``allow_missing``: the scores would look complete."""
    by = list(by)
    splits = _test_cells_from_wide(prepared, by=by)
    gold = prepared.select(*by, "post_id", *dims)
    if not allow_missing:
        gaps = unscored(preds, splits, by=by).filter("n_missing > 0 OR n_invalid > 0").limit(1).collect()
        if gaps:
            g = gaps[0]
            raise ValueError(f"run {g['approach']} {g['repeat']}.{g['fold']}: of {g['n_posts']} TEST posts {g['n_missing']} have "
                             f"no prediction and {g['n_invalid']} a NULL or NaN logit")
    keys = [c for c in (*by, "approach", "repeat", "fold", "post_id") if c in preds.columns]
    if kind == "binary":
        dims = dims[:1]
        logits = [c for c in preds.columns if c.startswith("logit_")]
        pair = "logit_1" if sorted(logits) == ["logit_0", "logit_1"] else None
        p01 = G.binary_label(preds.select(*keys, *logits), "logit_0", pair) \
            .select(*keys, F.col("label").alias(f"pred_{dims[0]}"))
    elif repair:
        p01 = G.repair(preds, repair, dims)
    else:
        p01 = predicted_labels(preds, dims)
    per_label = macro_prf(confusion_counts(test_rows(p01, gold, splits, dims=dims, by=by), keys=[*by, *CELL], dims=dims))
    return run_records(per_label, keys=[*by, *CELL], dims=dims)


def compare_study(runs: DataFrame, kind: str = "multilabel", alpha: float = 0.5) -> dict[str, DataFrame]:
    """Stage 3 on the long run table: the study's report (16 columns, or 4 for
    binary) as a ranked leaderboard of means, population std of every metric,
    LaTeX frame + rows, and significance of every approach pair on every F1
    metric.  A label metric that no record has shows as missing; records
    without the report's first metric, which ranks the board, are refused."""
    metrics = R.study_metric_names(kind)
    head = metrics[0]
    if runs.filter(F.col("metric") == head).isEmpty():
        raise ValueError(f"the run records have no {head}, which ranks the report")
    wide = R.study_report(runs, kind)
    board = R.leaderboard(wide, head)
    latex = R.latex_table(R.latex_lines(R.leaderboard(wide, head, digits=12), metrics, best="textbf"), ["approach", *metrics])
    tests = J.significant_pairs(J.wilcoxon(J.approach_pairs(R.f1_metrics(runs))), alpha)
    return {"leaderboard": board, "std": R.summarise(runs, "std"), "latex": latex, "significance": tests}


def main(argv: Sequence[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="cvframe.plans.study")
    sub = ap.add_subparsers(dest="stage", required=True)
    p1 = sub.add_parser("prepare")
    p1.add_argument("--variant", action="append", required=True, help="name=path.csv")
    p1.add_argument("--out", required=True)
    pt = sub.add_parser("train")
    pt.add_argument("--prepared", required=True)
    pt.add_argument("--variant", default="majority")
    pt.add_argument("--kind", default="multilabel", choices=["multilabel", "binary"])
    pt.add_argument("--approach", default="logistic")
    pt.add_argument("--text", default="arg_issue")
    pt.add_argument("--num-features", type=int, default=NUM_FEATURES)
    pt.add_argument("--steps", type=int, default=STEPS)
    pt.add_argument("--every", type=int, default=EVERY)
    pt.add_argument("--out", required=True)
    p2 = sub.add_parser("evaluate")
    p2.add_argument("--prepared", required=True)
    p2.add_argument("--variant", action="append", help="several: records go to out/<variant>")
    p2.add_argument("--preds", required=True, help="parquet (approach, post_id, logit_0..logit_13)")
    p2.add_argument("--kind", default="multilabel", choices=["multilabel", "binary"])
    p2.add_argument("--repair", default=None, choices=[None, "reference", "corrected"])
    p2.add_argument("--layout", default="partitioned", choices=["partitioned", "study"])
    p2.add_argument("--allow-missing", action="store_true")
    p2.add_argument("--out", required=True)
    p3 = sub.add_parser("compare")
    p3.add_argument("--runs", required=True)
    p3.add_argument("--layout", default="partitioned", choices=["partitioned", "study"])
    p3.add_argument("--kind", default="multilabel", choices=["multilabel", "binary"])
    p3.add_argument("--alpha", type=float, default=0.5)
    p3.add_argument("--out", required=True)
    a = ap.parse_args(argv)

    spark = SparkSession.builder.appName(f"cvframe-{a.stage}").getOrCreate()
    if a.stage == "prepare":
        prepare_study(spark, dict(v.split("=", 1) for v in a.variant), a.out)
    elif a.stage == "train":
        prepared = spark.read.parquet(a.prepared).filter(F.col("dataset_version") == a.variant)
        train_study(prepared, a.out, a.kind, a.approach, a.text, num_features=a.num_features, steps=a.steps, every=a.every)
    elif a.stage == "evaluate":
        variants = a.variant or ["majority"]
        prepared = spark.read.parquet(a.prepared).filter(F.col("dataset_version").isin(variants))
        write = RIO.write_runs if a.layout == "partitioned" else RIO.write_study_runs
        records = evaluate_study(prepared, spark.read.parquet(a.preds), a.kind, a.repair, allow_missing=a.allow_missing, by=["dataset_version"])
        records = written(records, "study-records")          # one row per variant and run
        for v in variants:
            write(records.filter(F.col("dataset_version") == v).drop("dataset_version"), f"{a.out}/{v}" if len(variants) > 1 else a.out)
    else:
        out = compare_study(RIO.read_runs(spark, a.runs, a.layout), a.kind, alpha=a.alpha)
        out["leaderboard"].write.mode("overwrite").parquet(f"{a.out}/leaderboard")
        out["std"].write.mode("overwrite").parquet(f"{a.out}/std")
        out["significance"].write.mode("overwrite").parquet(f"{a.out}/significance")
        RIO.write_latex(out["latex"], f"{a.out}/table.tex")


if __name__ == "__main__":
    main()
