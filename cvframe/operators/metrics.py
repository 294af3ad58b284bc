"""Classification metrics for every approach x cell x label in one plan (M1-M5).

Evaluation is aggregate-first: the wide per-row 0/1 pairs are summed into
``tp/fp/fn/tn`` per label with a map-side partial aggregate, so the shuffle
carries a few counters per task, and only the tiny result is reshaped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cvframe.operators.splits import CODE
from cvframe.schema import LABEL_COLS

CELL = ["approach", "repeat", "fold"]


def predicted_labels(preds: DataFrame, dims: Sequence[str] = LABEL_COLS, prefix: str = "logit_") -> DataFrame:
    """Replace ``logit_k`` columns by 0/1 ``pred_<dim>`` columns (strict > 0).
    A NULL or NaN logit gives a NULL prediction."""
    keep = [f"`{c}`" for c in preds.columns if not c.startswith(prefix)]
    return preds.selectExpr(*keep, *[f"CASE WHEN {prefix}{k} > 0 AND NOT isnan({prefix}{k}) THEN 1 WHEN {prefix}{k} <= 0 THEN 0 "
                                     f"END AS pred_{d}" for k, d in enumerate(dims)])


def test_rows(preds01: DataFrame, gold: DataFrame, splits: DataFrame, split: str = "TEST",
              id_col: str = "post_id", dims: Sequence[str] = LABEL_COLS, by: Sequence[str] = ()) -> DataFrame:
    """Predictions with the gold labels and the cells in which the post is in
    ``split``; ``by`` columns (e.g. ``dataset_version``) are part of the key
    of ``gold`` and ``splits`` (and of the predictions if they have them).

    Splits that carry the labelset code meet the predictions as one row per
    post with an array of its cells, exploded after the join: the predictions
    are shuffled once, and the labels come from the code.  Posts without a
    prediction make no row; count them with :func:`unscored`."""
    cells = splits.filter(F.col("split") == split)
    on = [*[b for b in by if b in preds01.columns], id_col]
    # predictions of one model per cell meet their own cell's rows only
    own = [c for c in ("repeat", "fold") if c in preds01.columns]
    if CODE in splits.columns and not own:
        posts = cells.groupBy(*by, id_col, CODE).agg(F.collect_list(F.struct("repeat", "fold")).alias("_cells"))
        rows = posts.join(preds01, on).select("*", F.inline("_cells")).drop("_cells")
        n = len(dims)
        bits = [f"CAST(shiftright({CODE}, {n - 1 - i}) & 1 AS INT) AS `{d}`" for i, d in enumerate(dims)]
        return rows.selectExpr(*[f"`{c}`" for c in rows.columns if c != CODE], *bits)
    return cells.select(*by, id_col, "repeat", "fold").join(gold, [*by, id_col]).join(preds01, [*on, *own])


def unscored(preds: DataFrame, splits: DataFrame, approaches: DataFrame | None = None, split: str = "TEST",
             id_col: str = "post_id", prefix: str = "logit_", by: Sequence[str] = ()) -> DataFrame:
    """Per run how many ``split`` posts have no prediction and how many have a
    NULL or NaN logit: ``(by..., approach, repeat, fold, n_posts, n_missing,
    n_invalid)``.  ``approaches`` (one column) defaults to those in ``preds``."""
    logits = [c for c in preds.columns if c.startswith(prefix)]
    bad = F.expr(" OR ".join(f"(`{c}` IS NULL OR isnan(`{c}`))" for c in logits) or "false")
    names = approaches if approaches is not None else preds.select("approach").distinct()  # one row per approach
    names = names.agg(F.collect_set("approach").alias("_a"))
    cells = splits.filter(F.col("split") == split).select(*by, id_col, "repeat", "fold")
    want = cells.join(F.broadcast(names)).select(*cells.columns, F.explode("_a").alias("approach"))
    on = [*[b for b in by if b in preds.columns], id_col, "approach", *[c for c in ("repeat", "fold") if c in preds.columns]]
    have = preds.select(*on, bad.alias("_bad"))
    j = want.join(have, on, "left")
    return j.groupBy(*by, *CELL).agg(
        F.count(F.lit(1)).alias("n_posts"), F.count_if(F.col("_bad").isNull()).alias("n_missing"),
        F.count_if(F.col("_bad")).alias("n_invalid"))


# --------------------------------------------------------------------------- M1
def confusion_counts(rows: DataFrame, keys: Sequence[str] = CELL, dims: Sequence[str] = LABEL_COLS,
                     gold_fmt: str = "{}", pred_fmt: str = "pred_{}") -> DataFrame:
    """``(keys..., dim, tp, fp, fn, tn)`` from wide 0/1 gold and prediction
    columns.  A pair with a NULL label or prediction counts nowhere."""
    # per label: known pairs, positives, predicted positives and true positives;
    # fp, fn and tn follow from them (fewer aggregate buffers)
    aggs = []
    for d in dims:
        y, p = f"`{gold_fmt.format(d)}`", f"`{pred_fmt.format(d)}`"
        aggs += [F.expr(f"count({y} + {p})").alias(f"_n_{d}"),
                 F.expr(f"sum(CAST(CASE WHEN {p} IS NOT NULL THEN {y} END AS BIGINT))").alias(f"_y_{d}"),
                 F.expr(f"sum(CAST(CASE WHEN {y} IS NOT NULL THEN {p} END AS BIGINT))").alias(f"_p_{d}"),
                 F.expr(f"sum(CAST({y} * {p} AS BIGINT))").alias(f"_t_{d}")]
    wide = rows.groupBy(*keys).agg(*aggs).na.fill(0, [f"_{x}_{d}" for x in "nypt" for d in dims])
    entries = ", ".join(
        f"named_struct('dim', '{d}', 'tp', _t_{d}, 'fp', _p_{d} - _t_{d}, 'fn', _y_{d} - _t_{d}, "
        f"'tn', _n_{d} - _y_{d} - _p_{d} + _t_{d})" for d in dims)
    return wide.selectExpr(*[f"`{k}`" for k in keys], f"inline(array({entries}))")


# --------------------------------------------------------------------------- M2
def _ratio(num: str, den: str) -> str:
    return f"CASE WHEN ({den}) = 0 THEN 0.0D ELSE CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) END"


def _macro(x1: str, x0: str) -> str:
    p1, p0 = "(tp + fp + fn > 0)", "(tn + fp + fn > 0)"
    n = f"(CAST({p1} AS INT) + CAST({p0} AS INT))"
    return (f"CASE WHEN {n} > 0 THEN ((CASE WHEN {p1} THEN {x1} ELSE 0.0D END) + "
            f"(CASE WHEN {p0} THEN {x0} ELSE 0.0D END)) / {n} END")


def macro_prf(conf: DataFrame) -> DataFrame:
    """Macro precision / recall / F1 over the classes present in gold or
    prediction; an undefined ratio counts as 0.  A label never seen and never
    predicted has only class 0 present and scores 1.0."""
    keep = [f"`{c}`" for c in conf.columns if c not in ("tp", "fp", "fn", "tn")]
    return conf.selectExpr(
        *keep,
        _macro(_ratio("tp", "tp + fp"), _ratio("tn", "tn + fn")) + " AS precision",
        _macro(_ratio("tp", "tp + fn"), _ratio("tn", "tn + fp")) + " AS recall",
        _macro(_ratio("2 * tp", "2 * tp + fp + fn"), _ratio("2 * tn", "2 * tn + fn + fp")) + " AS macro_f1",
    )


# --------------------------------------------------------------------------- M3
def mean_over_labels(per_label: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Unweighted mean of P, R and macro F1 over the labels of each run."""
    return per_label.groupBy(*keys).agg(
        F.avg("precision").alias("mean_precision"),
        F.avg("recall").alias("mean_recall"),
        F.avg("macro_f1").alias("mean_f1"),
    )


# --------------------------------------------------------------------------- M4
def run_records(per_label: DataFrame, keys: Sequence[str] = CELL, dims: Sequence[str] = LABEL_COLS) -> DataFrame:
    """One wide record per run: ``eval_<dim>_{precision,recall,macroF1}`` and
    ``eval_mean_{precision,recall,F1}`` (explicit pivot values)."""
    wide = per_label.groupBy(*keys).pivot("dim", list(dims)).agg(
        F.first("precision").alias("precision"), F.first("recall").alias("recall"),
        F.first("macro_f1").alias("macro_f1"),
    )
    cols = [f"`{k}`" for k in keys]
    cols += [f"`{d}_{m}` AS eval_{d}_{out}" for d in dims
             for m, out in (("precision", "precision"), ("recall", "recall"), ("macro_f1", "macroF1"))]
    for m, out in (("precision", "precision"), ("recall", "recall"), ("macro_f1", "F1")):
        cols.append(f"({' + '.join(f'`{d}_{m}`' for d in dims)}) / {float(len(dims))}D AS eval_mean_{out}")
    return wide.selectExpr(*cols)


# --------------------------------------------------------------------------- M5
def best_checkpoint(history: DataFrame, keys: Sequence[str] = CELL, step: str = "step", score: str = "score",
                    greater_is_better: bool = True) -> DataFrame:
    """Best evaluated step per run; on equal scores the earliest step wins."""
    s = F.col(score) if greater_is_better else -F.col(score)
    order = F.struct(s.alias("s"), (-F.col(step)).alias("t"))
    return history.groupBy(*keys).agg(
        F.max_by(F.col(step), order).alias("best_step"),
        F.max_by(F.col(score), order).alias("best_score"),
        F.count(F.lit(1)).alias("n_evals"),
    )
