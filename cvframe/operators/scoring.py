"""Scores to labels (G1-G6): linear head, sigmoid, threshold, argmax and the
hierarchy repair.  The head is one matrix product per Arrow batch, the rest
per-row native expressions; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cvframe.functions.link import argmax2
from cvframe.operators.metrics import predicted_labels
from cvframe.schema import LABEL_COLS, ROOT, TREE


def linear_head(coef: Sequence[Sequence[float]], bias: Sequence[float]):
    """G1 as a function of an ``ARRAY<DOUBLE>`` column: the outputs ``W.v + b``
    as an array.  A batch of vectors is one matrix product, at any width; a
    NULL vector, one with a NULL component or of another width gives NULL."""
    w, b = np.asarray(coef, np.float64).T.copy(), np.asarray(bias, np.float64)
    outputs = T.ArrayType(T.DoubleType())

    @F.arrow_udf(outputs)
    def head(vectors: pa.Array) -> pa.Array:
        width = np.asarray(pc.fill_null(pc.list_value_length(vectors), -1))
        nulls = np.asarray(pc.is_null(vectors.flatten()))
        owner = np.repeat(np.arange(len(width)), np.maximum(width, 0))
        ok = (width == len(w)) & (np.bincount(owner, nulls, len(width)) == 0)
        x = vectors.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(w))
        y = (x @ w + b).ravel()
        size = np.where(ok, len(b), 0)
        offsets = pa.array(np.append(0, np.cumsum(size)).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(y), mask=pa.array(~ok))

    return head


def score_linear(df: DataFrame, vec_col: str, coef, bias, prefix: str = "logit_") -> DataFrame:
    """``vec_col`` replaced by one column per output; ``coef`` is model state."""
    keep = [f"`{c}`" for c in df.columns if c != vec_col]
    out = df.select(*keep, linear_head(coef, bias)(F.col(vec_col).cast("array<double>")).alias("_y"))
    return out.selectExpr(*keep, *[f"_y[{k}] AS {prefix}{k}" for k in range(len(bias))])


def probabilities(df: DataFrame, dims: Sequence[str] = LABEL_COLS, prefix: str = "logit_") -> DataFrame:
    """``prob_<dim> = sigmoid(logit)``."""
    keep = [f"`{c}`" for c in df.columns if not c.startswith(prefix)]
    return df.selectExpr(*keep, *[f"1D / (1D + exp(-{prefix}{k})) AS prob_{d}" for k, d in enumerate(dims)])


#: ``pred_<dim>`` = 1 iff logit > 0 (probability strictly above 0.5).
thresholded = predicted_labels


def binary_label(df: DataFrame, logit0: str = "logit_0", logit1: str | None = None, out: str = "label") -> DataFrame:
    """Class of the larger logit; equal logits give class 0.

    With ``logit1`` the table holds both classes' logits (``logit0`` is
    class 0's); without it one score ``x`` stands for ``(-x, x)``.  A NULL or
    NaN logit gives a NULL label."""
    x0, x1 = (F.col(logit0), F.col(logit1)) if logit1 else (-F.col(logit0), F.col(logit0))
    known = x0.isNotNull() & x1.isNotNull() & ~F.isnan(x0) & ~F.isnan(x1)
    return df.withColumn(out, F.when(known, argmax2(x0, x1)))


def _first_max(xs: Sequence[str]) -> list[str]:
    """Per candidate (SQL text): is it the first maximum (ties -> lowest index)?"""
    flags = []
    for j, xj in enumerate(xs):
        conds = [f"{xj} > {xs[i]}" for i in range(j)] + [f"{xj} >= {xs[i]}" for i in range(j + 1, len(xs))]
        flags.append(" AND ".join(conds) if conds else "TRUE")
    return flags


def repair(df: DataFrame, mode: str = "reference", dims: Sequence[str] = LABEL_COLS, prefix: str = "logit_",
           tree: dict[str, list[str]] = TREE, root: str = ROOT) -> DataFrame:
    """Make thresholded predictions consistent with the label tree.

    * root 0 -> everything 0; parent 0 -> its children 0;
    * parent 1 with no child predicted -> the most probable child is set
      (first maximum; logits are compared - same order as probabilities);
    * root 1 with no parent predicted is left as is.

    ``mode='reference'`` reproduces the study's slip for three-child parents:
    the third candidate is compared through its 0/1 prediction (always 0
    there) instead of its probability, so it is never chosen and the pick is
    the first child unless the second is strictly more probable.
    ``mode='corrected'`` compares all children's scores.

    A NULL or NaN logit gives a NULL prediction, and so does whatever depends
    on it: labels below it, and the children of a parent if it is unknown
    whether one of them is predicted.  What a known 0 above decides stays 0.

    Written as one projection of SQL expressions: per-row, codegen'd, no UDF.
    """
    if mode not in ("reference", "corrected"):
        raise ValueError(mode)
    k_of = {d: k for k, d in enumerate(dims)}
    logit = {d: f"`{prefix}{k_of[d]}`" for d in dims}
    pred = {d: f"(CASE WHEN {x} > 0 AND NOT isnan({x}) THEN 1 WHEN {x} <= 0 THEN 0 END)" for d, x in logit.items()}
    out = {root: pred[root]}
    for parent, kids in tree.items():
        gate = f"(CASE WHEN {pred[root]} = 0 OR {pred[parent]} = 0 THEN 0 ELSE {pred[root]} * {pred[parent]} END)"
        out[parent] = gate
        any_kid = f"greatest({', '.join(pred[c] for c in kids)}) = 1"
        unknown = " OR ".join(f"{pred[c]} IS NULL" for c in kids)
        scores = [logit[c] for c in kids]
        if mode == "reference" and len(kids) >= 3:
            # third slot holds a 0 prediction where a probability is meant:
            # any probability (>= 0) beats or ties it, so only the first two
            # candidates can win
            flags = _first_max(scores[:2]) + ["FALSE"] * (len(kids) - 2)
        else:
            flags = _first_max(scores)
        for c, fl in zip(kids, flags):
            out[c] = (f"CASE WHEN {gate} = 0 THEN 0 WHEN {gate} = 1 THEN CASE WHEN {any_kid} THEN {pred[c]} "
                      f"WHEN NOT ({unknown}) THEN CASE WHEN {fl} THEN 1 ELSE 0 END END END")
    keep = [f"`{c}`" for c in df.columns if not c.startswith(prefix)]
    return df.selectExpr(*keep, *[f"CAST({out[d]} AS INT) AS pred_{d}" for d in dims])


def is_consistent(dims: Sequence[str] = LABEL_COLS, fmt: str = "pred_{}", tree=TREE, root: str = ROOT) -> Column:
    """True when every set child has its parent set and every set parent has
    the root set (the invariant :func:`repair` establishes)."""
    c = F.lit(True)
    for parent, kids in tree.items():
        c = c & (F.col(fmt.format(parent)) <= F.col(fmt.format(root)))
        for k in kids:
            c = c & (F.col(fmt.format(k)) <= F.col(fmt.format(parent)))
    return c
