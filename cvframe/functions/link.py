"""Link functions and numerically stable loss terms as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def softplus(x: Column) -> Column:
    """``log(1 + exp(x))`` without overflow: ``max(x,0) + log1p(exp(-|x|))``."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def threshold(logit: Column) -> Column:
    """0/1 label from a logit.  Strictly positive logit -> 1, so p = 0.5 -> 0
    (round-half-to-even of the probability)."""
    return F.when(logit > 0, F.lit(1)).otherwise(F.lit(0))


def argmax2(x0: Column, x1: Column) -> Column:
    """Class of the larger of two logits; a tie goes to class 0."""
    return F.when(x1 > x0, F.lit(1)).otherwise(F.lit(0))


def logsumexp2(a: Column, b: Column) -> Column:
    m = F.greatest(a, b)
    return m + F.log(F.exp(a - m) + F.exp(b - m))


# SQL-text forms (one JVM parse per expression instead of one call per node)
def softplus_sql(x: str) -> str:
    return f"(greatest({x}, 0D) + log1p(exp(-abs({x}))))"


def logsumexp2_sql(a: str, b: str) -> str:
    return f"(greatest({a}, {b}) + ln(exp({a} - greatest({a}, {b})) + exp({b} - greatest({a}, {b}))))"
