"""Flagship plan (K8): TEST metrics of every approach x cell x label, averaged
over the runs and ranked, as a single Spark job.

preds ⋈ splits(TEST)   -- one row per post with its labelset code and cells
  -> confusion counts per (approach, repeat, fold, label)   -- partial agg
  -> macro P/R/F1 -> mean over runs -> leaderboard
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cvframe.operators.metrics import CELL, confusion_counts, macro_prf, predicted_labels, test_rows
from cvframe.schema import LABEL_COLS


def per_label_metrics(preds: DataFrame, gold: DataFrame, splits: DataFrame, dims: Sequence[str] = LABEL_COLS,
                      preds01: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., approach, repeat, fold, dim, precision, recall, macro_f1)`` on TEST."""
    p01 = preds01 if preds01 is not None else predicted_labels(preds, dims)
    rows = test_rows(p01, gold, splits, dims=dims, by=by)
    return macro_prf(confusion_counts(rows, keys=[*by, *CELL], dims=dims))


def leaderboard_from_metrics(per_label: DataFrame, dims: Sequence[str] = LABEL_COLS, digits: int = 4) -> DataFrame:
    """Mean over runs of each label's macro F1 and of their mean, ranked by
    the mean (descending; ties by approach)."""
    wide = per_label.groupBy("approach").pivot("dim", list(dims)).agg(F.avg("macro_f1"))
    mean = f"({' + '.join(f'`{d}`' for d in dims)}) / {float(len(dims))}D"
    out = wide.selectExpr("approach", f"{mean} AS mean_f1", *[f"`{d}` AS {d}_f1" for d in dims])
    # one row per approach: a global window over this table is tiny
    return out.selectExpr(
        "row_number() OVER (ORDER BY mean_f1 DESC, approach ASC) AS rank",
        "approach",
        *[f"round({c}, {digits}) AS {c}" for c in ["mean_f1", *[f"{d}_f1" for d in dims]]],
    )


def cv_evaluate(preds: DataFrame, gold: DataFrame, splits: DataFrame, dims: Sequence[str] = LABEL_COLS) -> DataFrame:
    return leaderboard_from_metrics(per_label_metrics(preds, gold, splits, dims), dims)
