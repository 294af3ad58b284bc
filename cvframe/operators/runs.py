"""Run aggregation and reporting.

Input is the long run table ``(approach, repeat, fold, metric, value)`` -
one row per finished run and metric - so every report is a grouped
aggregate or an explicit-value pivot over it.  These tables have one row
per (approach, metric) at most; the few global windows below run over
them, never over corpus-sized data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN_KEYS = ["approach", "repeat", "fold"]


def summarise(runs: DataFrame, how: str = "mean") -> DataFrame:
    """R1 (``mean``) / R2 (``std``, population): per (approach, metric)."""
    if how == "mean":
        agg = F.avg("value")
    elif how == "std":
        agg = F.stddev_pop("value")
    else:
        raise ValueError(how)
    return runs.groupBy("approach", "metric").agg(agg.alias("value"), F.count(F.lit(1)).alias("n_runs"))


def f1_metrics(runs: DataFrame, needle: str = "F1") -> DataFrame:
    """Keep metrics whose name contains ``needle`` (substring, as the
    study does, so ``mean_F1`` is kept too)."""
    return runs.filter(F.col("metric").contains(needle))


def pivot_runs(long: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("approach",),
               value: str = "value") -> DataFrame:
    """One row per key, one column per metric (explicit pivot values)."""
    return long.groupBy(*keys).pivot("metric", list(metrics)).agg(F.first(value))


def report_columns(wide: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fixed, ordered report columns."""
    return wide.select(*cols)


def leaderboard(wide: DataFrame, by: str, digits: int = 4, key: str = "approach") -> DataFrame:
    """Sort by ``by`` descending (NULLs last, ties by key), round, rank."""
    vals = [c for c in wide.columns if c != key]
    return wide.selectExpr(f"row_number() OVER (ORDER BY `{by}` DESC NULLS LAST, `{key}` ASC) AS rank", f"`{key}`",
                           *[f"round(`{c}`, {digits}) AS `{c}`" for c in vals])


def two_places(c: Column) -> Column:
    """Decimal rounding to 2 places through an exact 6-place decimal."""
    return c.cast("decimal(18,6)").cast("decimal(18,2)")


def mark_best(summary: DataFrame, digits: int = 2) -> DataFrame:
    """Flag the best approach(es) per metric at the displayed precision."""
    r = two_places(F.col("value")) if digits == 2 else F.round("value", digits)
    w = Window.partitionBy("metric")
    return summary.withColumn("shown", r.cast("double")).withColumn(
        "is_best", F.col("shown") == F.max("shown").over(w)
    )


def latex_lines(board: DataFrame, cols: Sequence[str], key: str = "approach", order: str = "rank",
                missing: str = "--", best: str | None = None) -> DataFrame:
    """One LaTeX body line per row: escaped name, values ``0.00``; a NULL
    cell shows ``missing`` and keeps its column.  ``best`` names a LaTeX
    command (``textbf``) put around each column's best value(s) as displayed
    (R4); the window is over the report's rows, one per approach."""
    name = F.regexp_replace(F.col(key), "_", r"\\_")

    def cell(c: str) -> Column:
        shown = two_places(F.col(c))
        text = shown.cast("string")
        if best:
            top = F.max(shown).over(Window.partitionBy(F.lit(0)))
            text = F.when(shown == top, F.concat(F.lit(f"\\{best}{{"), text, F.lit("}"))).otherwise(text)
        return F.coalesce(text, F.lit(missing))

    cells = [name] + [cell(c) for c in cols]
    return board.select(F.col(order), F.concat(F.concat_ws(" & ", *cells), F.lit(r" \\")).alias("line"))


def latex_table(lines: DataFrame, header: Sequence[str]) -> DataFrame:
    """Whole table text as ``(part, i, line)`` rows: header (part 0), body
    (part 1, in rank order), footer (part 2).  The frame lines are constants;
    the body stays a DataFrame."""
    spark = lines.sparkSession
    head = [
        r"\begin{tabular}{l" + "r" * (len(header) - 1) + "}",
        r"\toprule",
        " & ".join(h.replace("_", r"\_") for h in header) + r" \\",
        r"\midrule",
    ]
    foot = [r"\bottomrule", r"\end{tabular}"]
    fixed = [(0, i, s) for i, s in enumerate(head)] + [(2, i, s) for i, s in enumerate(foot)]
    frame = spark.createDataFrame(fixed, "part int, i int, line string")
    body = lines.select(F.lit(1).alias("part"), F.col("rank").cast("int").alias("i"), "line")
    return frame.unionByName(body)


def score_vectors(runs: DataFrame) -> DataFrame:
    """Per (approach, metric) the run scores ordered by (repeat, fold)."""
    g = runs.groupBy("approach", "metric").agg(
        F.sort_array(F.collect_list(F.struct("repeat", "fold", "value"))).alias("_v")
    )
    return g.select("approach", "metric", F.transform("_v", lambda x: x["value"]).alias("scores"))


def study_metric_names(kind: str = "multilabel") -> list[str]:
    """Metrics of the study's report in its order: the mean first, then one
    macro F1 per label; the binary report has macro F1, precision and recall
    of the root label."""
    from cvframe.schema import LABEL_COLS

    if kind == "binary":
        return [f"{LABEL_COLS[0]}_{m}" for m in ("macroF1", "precision", "recall")]
    return ["mean_F1", *[f"{d}_macroF1" for d in LABEL_COLS]]


def study_report(runs: DataFrame, kind: str = "multilabel", how: str = "mean") -> DataFrame:
    """P7 + P9 + R1: the study's report, one row per approach and its fixed
    columns in report order (16 for multilabel, 4 for binary)."""
    metrics = study_metric_names(kind)
    return report_columns(pivot_runs(summarise(runs, how), metrics), ["approach", *metrics])
