"""Corpus preparation (the study's first stage) as one Spark job.

variants (S2) -> 5 x 5 stratified splits per variant (D2-D4, ``by``
dataset_version) -> wide split columns (D4 export) -> ``arg_issue`` (P3) ->
current label names (P2) -> partitioned sink (S3).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cvframe.operators.splits import assign_splits_wide
from cvframe.schema import LABEL_COLS
from cvframe.sources.corpus_io import rename_labels, with_arg_issue, write_corpus


def faulty_rows(corpus: DataFrame, id_col: str = "post_id", by: Sequence[str] = ()) -> DataFrame:
    """One row: ids that occur more than once per ``by`` group (a split table
    keyed by id cannot represent them) and rows without issue or text (the
    model input would be NULL)."""
    per_id = corpus.groupBy(*by, id_col).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("issue").isNull() | F.col("post_text").isNull()).alias("_null"))
    return per_id.agg(F.count_if(F.col("_n") > 1).alias("duplicate_ids"), F.coalesce(F.sum("_null"), F.lit(0)).alias("null_rows"))


def prepare_corpus(corpus: DataFrame, by: Sequence[str] = ("dataset_version",), id_col: str = "post_id",
                   dims: Sequence[str] = LABEL_COLS, name: str = "fold{repeat}_{fold}",
                   check: bool = True) -> DataFrame:
    """Corpus rows with ``arg_issue`` and one split column per cell.

    ``check`` counts faulty rows first (ids and NULL flags are shuffled, no
    text) and refuses a corpus that has any."""
    by = list(by)
    corpus = rename_labels(corpus)
    if check:
        faults = faulty_rows(corpus, id_col, by).first()
        if faults["duplicate_ids"]:
            raise ValueError(f"duplicate ids in corpus ({faults['duplicate_ids']}): split assignment would be ambiguous")
        if faults["null_rows"]:
            raise ValueError(f"{faults['null_rows']} rows have no issue or no text")
    wide = assign_splits_wide(corpus.select(*by, id_col, *dims), id_col=id_col, dims=dims, name=name, by=by)
    return with_arg_issue(corpus).join(wide, [*by, id_col])


def write_prepared(prepared: DataFrame, path: str, fmt: str = "parquet", by: Sequence[str] = ("dataset_version",)):
    """S3 for the prepared corpus (one folder per variant)."""
    write_corpus(prepared, path, fmt=fmt, partition_by=list(by))
