"""Paired significance between approaches (J1-J4): exact Wilcoxon
signed-rank test on the per-run scores.

Pairs are formed by an equi-join on ``(metric, repeat, fold)`` with
``a < b``: each join group holds one row per approach, so its size is the
number of compared approaches, not a data size.  Ranks come from windows
over each pair's (at most ``#runs``) differences, and the exact null distribution
is counted per pair in an Arrow-fed vectorised loop.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAIR = ["metric", "approach_a", "approach_b"]


def approach_pairs(runs: DataFrame) -> DataFrame:
    """``(metric, approach_a, approach_b, repeat, fold, value_a, value_b)``
    for every unordered pair present in the same run cell."""
    a = runs.select("metric", "repeat", "fold", F.col("approach").alias("approach_a"), F.col("value").alias("value_a"))
    b = runs.select("metric", "repeat", "fold", F.col("approach").alias("approach_b"), F.col("value").alias("value_b"))
    return a.join(b, ["metric", "repeat", "fold"]).filter(F.col("approach_a") < F.col("approach_b"))


def signed_ranks(pairs: DataFrame) -> DataFrame:
    """Non-zero differences with doubled mid-ranks ``r2`` (integers)."""
    d = pairs.withColumn("d", F.col("value_a") - F.col("value_b")).filter(F.col("d") != 0)
    d = d.withColumn("ad", F.abs("d"))
    rk = F.rank().over(Window.partitionBy(*PAIR).orderBy("ad"))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*PAIR, "ad"))
    return d.withColumn("r2", (F.lit(2) * rk + ties - F.lit(1)).cast("int"))


def signed_rank(pairs: DataFrame) -> DataFrame:
    """Per pair ``n_pairs`` (runs present on both sides; a run missing on
    one side makes no pair, so compare it with the number of runs), ``n``
    (non-zero differences), ``w_plus``, ``w_minus``,
    ``t_stat = min(w_plus, w_minus)`` and the doubled ranks (for J3).
    Pairs whose differences are all zero keep ``n = 0``."""
    r = signed_ranks(pairs)
    per = r.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("d") > 0, F.col("r2")).otherwise(0)).alias("_w2p"),
        F.sum(F.when(F.col("d") < 0, F.col("r2")).otherwise(0)).alias("_w2m"),
        F.collect_list("r2").alias("_ranks"),
    )
    allp = pairs.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n_pairs"))
    j = allp.join(per, PAIR, "left")
    return j.select(
        *PAIR,
        "n_pairs",
        F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"),
        (F.coalesce(F.col("_w2p"), F.lit(0)) / 2.0).alias("w_plus"),
        (F.coalesce(F.col("_w2m"), F.lit(0)) / 2.0).alias("w_minus"),
        (F.least(F.coalesce(F.col("_w2p"), F.lit(0)), F.coalesce(F.col("_w2m"), F.lit(0))) / 2.0).alias("t_stat"),
        F.coalesce(F.col("_ranks"), F.array().cast("array<int>")).alias("_ranks"),
    )


RESCALE = 512       # ranks after which counts are scaled down, so they stay in DOUBLE range


def lower_tail(ranks: np.ndarray, t: int) -> float:
    """P(W <= t) of the sum W of the ranks whose fair coin shows heads.

    Counts subsets by their sum, one rank at a time, smallest first and only
    up to ``t``: work and memory follow the statistic, not the whole range."""
    counts = np.zeros(t + 1)
    counts[0] = 1.0
    reach, halved = 0, 0
    ordered = np.sort(ranks)
    for i, r in enumerate(ordered.tolist(), 1):
        reach = min(t, reach + r)
        if r <= t:
            counts[r:reach + 1] += counts[:reach + 1 - r].copy()
        if i % RESCALE == 0:
            counts[:reach + 1] *= 2.0 ** -RESCALE
            halved += RESCALE
    return float(counts.sum() * 2.0 ** (halved - len(ordered)))


@F.pandas_udf(T.DoubleType())
def _lower_tails(ranks: pd.Series, t2: pd.Series) -> pd.Series:
    return pd.Series([lower_tail(np.asarray(r, np.int64), int(t)) for r, t in zip(ranks, t2)], dtype="float64")


def wilcoxon(pairs: DataFrame) -> DataFrame:
    """Two-sided exact p-value, ``min(1, 2 P(W <= T))`` under the
    (conditional, mid-rank) null distribution at every n; zero differences
    dropped; ``n = 0`` gives NULL.  A pair takes n * T additions and T
    numbers (8 MB at n = 1,000), in one vectorised loop over its ranks."""
    s = signed_rank(pairs)
    t2 = (F.col("t_stat") * 2).cast("bigint")
    p = F.when(F.col("n") > 0, F.least(F.lit(1.0), F.lit(2.0) * _lower_tails("_ranks", t2)))
    return s.withColumn("p_value", p).drop("_ranks")


def significant_pairs(tests: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Flag ``p <= alpha`` (the study prints this with alpha 0.5)."""
    return tests.withColumn("significant", F.col("p_value") <= F.lit(float(alpha)))
