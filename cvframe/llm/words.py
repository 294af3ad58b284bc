"""Words of whole texts as row numbers of a table that grows as needed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cvframe.llm.common import id_remainder, quoted, table

BATCH_BYTES = 4 << 20      # text handled at once
KNOWN_WORDS = 200_000      # words remembered by one worker; forgetting only costs time


class _Rows(dict):
    """word -> row; an unknown word gets the next row."""

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self)
        return row


class WordTable:
    """``describe`` gives one row of numbers per word; rows are remembered."""

    def __init__(self, describe: Callable[[list[str]], np.ndarray], limit: int = KNOWN_WORDS):
        self.describe, self.limit = describe, limit
        self.known, self.rows = _Rows(), None

    def rows_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(rows of all words in order, number of words per text).

        Words are runs of anything but white space; NULL counts as empty."""
        if len(self.known) > self.limit:
            self.known, self.rows = _Rows(), None
        before = len(self.known)
        words = [(t or "").split() for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        get = self.known.__getitem__
        flat = np.fromiter((get(w) for ws in words for w in ws), np.int64, int(sizes.sum()))
        if len(self.known) > before:
            new = list(self.known)[before:] if before else list(self.known)
            rows = self.describe(new)
            self.rows = rows if self.rows is None else np.concatenate([self.rows, rows])
        return flat, sizes


def text_slices(batch: pa.RecordBatch, column: int, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` text bytes (one row at least)."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    a = 0
    while a < len(size):
        n = max(1, int(np.searchsorted(np.cumsum(size[a:]), limit, "right")))
        yield batch.slice(a, n)
        a += n


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of rows; empty stretches give zero."""
    out = np.zeros((len(sizes), *values.shape[1:]), np.float64)
    some = np.flatnonzero(sizes)
    if len(some):
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])[some]
        out[some] = np.add.reduceat(values, starts, axis=0, dtype=np.float64)
    return out


def labelled(docs: DataFrame, sf_dir: str, label: str, divisor: int, held: int, limit: int,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label) of at most ``limit`` documents to learn from.

    Rows whose crc32(id as text) mod ``divisor`` is ``held`` are left out, as
    are NULL labels, NULL ids and ids that ``docs`` does not have.  An id with
    several labels takes the smallest.  Beyond the limit the ids with the
    smallest hashes are taken, so the choice does not depend on order.  Ids
    alone are shuffled for that; the chosen labels (16 bytes each, at most
    ``limit`` rows) are broadcast, and texts stay where they are."""
    labels = table(docs.sparkSession, sf_dir, "labels").select(
        F.col("doc_id").cast("long").alias("_label_id"), F.col(label).cast("int").alias("label"))
    labels = labels.where(F.col("_label_id").isNotNull() & F.col("label").isNotNull()
                          & (id_remainder(F.col("_label_id"), divisor) != held))
    labels = labels.groupBy("_label_id").agg(F.min("label").alias("label"))
    there = docs.select(quoted(id_col).cast("long").alias("_label_id"))
    labels = labels.join(there, "_label_id", "left_semi")
    chosen = labels.orderBy(F.xxhash64("_label_id"), "_label_id").limit(limit)
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text"))
    return rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("_label_id")).select("doc_id", "text", "label")
