"""Experiment grid, ablations and baselines (K3, K4, K6, K7).

The study ran one process per (approach, repeat, fold) from shell loops;
here the grid is data: cells are grouping keys of one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cvframe.functions.text import strip_text
from cvframe.operators.metrics import confusion_counts, macro_prf
from cvframe.operators.splits import CODE
from cvframe.operators.text import shuffled_text
from cvframe.operators.weights import CELL_KEYS, train_label_counts
from cvframe.schema import LABEL_COLS

# approach name -> (with issue prefix, shuffled tokens), as in the study's ablation
ABLATIONS = {"with_issue": (True, False), "wo_issue": (False, False), "shuffle": (True, True)}


def cv_grid(splits: DataFrame, approaches: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """K3: every approach x cell with its TRAIN/VALID/TEST sizes.

    Split sizes are one grouped aggregate (25 rows per ``by`` value);
    approaches are a literal array exploded onto them - no join."""
    sizes = splits.groupBy(*by, *CELL_KEYS).agg(
        *[F.count(F.when(F.col("split") == s, 1)).alias(f"n_{s.lower()}") for s in ("TRAIN", "VALID", "TEST")]
    )
    return sizes.select(F.explode(F.array(*[F.lit(a) for a in approaches])).alias("approach"), "*")


def ablations(corpus: DataFrame, seed=42, id_col: str = "post_id",
              variants: dict[str, tuple[bool, bool]] | None = None) -> DataFrame:
    """K4: ``(approach, id, text)`` - the model input of each ablation, all
    from one pass over the corpus."""
    entries = []
    for name, (with_issue, shuffled) in (variants or ABLATIONS).items():
        text = F.concat(F.col("issue"), F.lit(" "), F.col("post_text")) if with_issue else F.col("post_text")
        text = shuffled_text(text, seed, F.col(id_col)) if shuffled else strip_text(text)
        entries.append(F.struct(F.lit(name).alias("approach"), text.alias("text")))
    return corpus.select(id_col, F.inline(F.array(*entries))).select("approach", id_col, "text")


def _evaluate_cells(rows: DataFrame, dims: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return macro_prf(confusion_counts(rows, keys=[*by, *CELL_KEYS], dims=dims))


def majority_baseline(gold: DataFrame, splits: DataFrame, dims: Sequence[str] = LABEL_COLS,
                      id_col: str = "post_id", by: Sequence[str] = ()) -> DataFrame:
    """K6: per cell and label predict TRAIN's majority class (ties -> 0),
    scored on TEST: ``(by..., repeat, fold, dim, majority, precision, recall,
    macro_f1)``.

    A constant prediction needs only the label counts of TRAIN and TEST, two
    tables of cells x labels rows; no post-level join."""
    keys = [*by, *CELL_KEYS, "dim"]
    maj = train_label_counts(gold, splits, dims, "TRAIN", id_col, by).select(
        *keys, (F.col("n_pos") > F.col("n_neg")).cast("int").alias("majority"))
    test = train_label_counts(gold, splits, dims, "TEST", id_col, by)
    conf = test.join(maj, keys).selectExpr(
        *[f"`{k}`" for k in keys], "majority", "n_pos * majority AS tp", "n_neg * majority AS fp",
        "n_pos * (1 - majority) AS fn", "n_neg * (1 - majority) AS tn")
    return macro_prf(conf)


def random_labels(df: DataFrame, seed="random", dims: Sequence[str] = LABEL_COLS, id_col: str = "post_id") -> DataFrame:
    """K7 predictions: uniform 0/1 per (post, label) from the parity of a
    keyed md5 digit."""
    return df.select(id_col, *_random_bits(seed, dims, id_col))


def _random_bits(seed, dims: Sequence[str], id_col: str) -> list:
    def bit(d: str):
        h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"), F.lit(d)))
        return (F.conv(F.substring(h, 1, 1), 16, 10).cast("int") % 2).alias(f"pred_{d}")

    return [bit(d) for d in dims]


def random_baseline(gold: DataFrame, splits: DataFrame, seed="random", dims: Sequence[str] = LABEL_COLS,
                    id_col: str = "post_id", by: Sequence[str] = ()) -> DataFrame:
    """K7: random predictions scored on TEST of every cell.  The bits are a
    function of the id, computed beside the labels; nothing is joined for
    them, and nothing at all if the splits carry the labelset code."""
    test = splits.filter(F.col("split") == "TEST")
    if CODE in splits.columns:
        n = len(dims)
        bits = [F.expr(f"CAST(shiftright({CODE}, {n - 1 - i}) & 1 AS INT)").alias(d) for i, d in enumerate(dims)]
        rows = test.select(*by, *CELL_KEYS, *bits, *_random_bits(seed, dims, id_col))
    else:
        labels = gold.select(*by, id_col, *dims, *_random_bits(seed, dims, id_col))
        rows = test.select(*by, id_col, *CELL_KEYS).join(labels, [*by, id_col])
    return _evaluate_cells(rows, dims, by)
