"""Rare-label weights and losses (W1, L1-L3), for every cell at once.

Per-cell quantities are one grouped aggregate over labelset codes (no
per-cell loop, no join with the labels).  The weight table has ``cells x labels`` rows - a fixed bound - so joining it back is a
broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cvframe.functions.link import logsumexp2_sql, softplus_sql
from cvframe.operators.metrics import CELL, test_rows
from cvframe.operators.splits import CODE
from cvframe.schema import LABEL_COLS

CELL_KEYS = ["repeat", "fold"]


def _label_sums(dims: Sequence[str], count: str, value) -> list:
    """Positive and known rows per label, NULL labels in neither."""
    out = []
    for i, d in enumerate(dims):
        v = value(i, d)
        out += [F.expr(f"sum(CASE WHEN {v} = 1 THEN {count} ELSE 0 END)").alias(f"_p_{d}"),
                F.expr(f"sum(CASE WHEN {v} IS NOT NULL THEN {count} ELSE 0 END)").alias(f"_k_{d}")]
    return out


def train_label_counts(gold: DataFrame, splits: DataFrame, dims: Sequence[str] = LABEL_COLS,
                       split: str = "TRAIN", id_col: str = "post_id", by: Sequence[str] = ()) -> DataFrame:
    """``(by..., repeat, fold, dim, n_pos, n_neg)`` over the ``split`` rows of
    each cell; a NULL label counts on neither side.

    Splits that carry the labelset code need no labels: rows are counted per
    (cell, code), a map-side aggregate with a tiny result, and decoded there.
    Otherwise the labels are joined on the id (and ``by``)."""
    keys = [*by, *CELL_KEYS]
    rows = splits.filter(F.col("split") == split)
    if CODE in splits.columns:
        n = len(dims)
        coded = rows.groupBy(*keys, CODE).agg(F.count(F.lit(1)).alias("_n"))
        wide = coded.groupBy(*keys).agg(*_label_sums(dims, "_n", lambda i, d: f"(shiftright({CODE}, {n - 1 - i}) & 1)"))
    else:
        joined = rows.select(*by, id_col, *CELL_KEYS).join(gold, [*by, id_col])
        wide = joined.groupBy(*keys).agg(*_label_sums(dims, "1", lambda i, d: f"`{d}`"))
    entries = ", ".join(f"named_struct('dim', '{d}', 'n_pos', _p_{d}, 'n_neg', _k_{d} - _p_{d})" for d in dims)
    return wide.selectExpr(*[f"`{k}`" for k in keys], f"inline(array({entries}))")


def pos_weights(gold: DataFrame, splits: DataFrame, dims: Sequence[str] = LABEL_COLS, by: Sequence[str] = ()) -> DataFrame:
    """``neg/pos`` per cell and label, kept only when ``1 <= w < inf``
    (i.e. ``pos > 0`` and ``neg >= pos``); otherwise 1.0.  Guarded so no
    division by zero is ever evaluated."""
    c = train_label_counts(gold, splits, dims, by=by)
    return c.withColumn("weight", F.expr(
        "CASE WHEN n_pos > 0 AND n_neg >= n_pos THEN CAST(n_neg AS DOUBLE) / CAST(n_pos AS DOUBLE) ELSE 1.0D END"))


def _wide_weights(weights: DataFrame, dims: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    keys = [*by, *CELL_KEYS]
    return weights.groupBy(*keys).pivot("dim", list(dims)).agg(F.first("weight")).select(
        *keys, *[F.col(d).alias(f"w_{d}") for d in dims]
    )


def bce_loss(preds: DataFrame, gold: DataFrame, splits: DataFrame, weights: DataFrame,
             dims: Sequence[str] = LABEL_COLS, prefix: str = "logit_", by: Sequence[str] = ()) -> DataFrame:
    """L1: weighted binary cross-entropy with logits on TEST, per run:
    mean over rows x labels of ``w*y*softplus(-x) + (1-y)*softplus(x)``."""
    # the weights have cells x labels rows: a fixed bound, so a broadcast
    rows = test_rows(preds, gold, splits, dims=dims, by=by).join(F.broadcast(_wide_weights(weights, dims, by)), [*by, *CELL_KEYS])
    terms = [f"w_{d} * CAST({d} AS DOUBLE) * {softplus_sql(f'-{prefix}{k}')} + "
             f"(1D - CAST({d} AS DOUBLE)) * {softplus_sql(f'{prefix}{k}')}" for k, d in enumerate(dims)]
    loss = f"sum({' + '.join(terms)}) / (count(1) * {len(dims)})"
    return rows.groupBy(*by, *CELL).agg(F.expr(loss).alias("bce_loss"))


def cross_entropy(preds: DataFrame, gold: DataFrame, splits: DataFrame, label: str = LABEL_COLS[0],
                  logit0: str = "logit_0", logit1: str | None = None, by: Sequence[str] = (),
                  dims: Sequence[str] = LABEL_COLS) -> DataFrame:
    """L2: two-class cross-entropy on TEST: mean of ``logsumexp(x0, x1) - x_y``.

    With ``logit1`` the table holds both classes' logits (``logit0`` is
    class 0's); without it one score ``x`` stands for ``(-x, x)``."""
    rows = test_rows(preds, gold, splits, dims=dims, by=by)
    x0, x1 = (logit0, logit1) if logit1 else (f"(-{logit0})", logit0)
    expr = f"avg({logsumexp2_sql(x0, x1)} - CASE WHEN {label} = 1 THEN {x1} ELSE {x0} END)"
    return rows.groupBy(*by, *CELL).agg(F.expr(expr).alias("ce_loss"))


def mse_loss(preds: DataFrame, gold: DataFrame, splits: DataFrame, dims: Sequence[str] = LABEL_COLS,
             prefix: str = "logit_", by: Sequence[str] = ()) -> DataFrame:
    """L3: mean squared error of raw outputs against 0/1 labels on TEST."""
    rows = test_rows(preds, gold, splits, dims=dims, by=by)
    terms = [f"pow({prefix}{k} - CAST({d} AS DOUBLE), 2)" for k, d in enumerate(dims)]
    loss = f"sum({' + '.join(terms)}) / (count(1) * {len(dims)})"
    return rows.groupBy(*by, *CELL).agg(F.expr(loss).alias("mse_loss"))
