"""Corpus sources and sinks (S1-S3) and corpus-level reshapes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cvframe.schema import DIMS, LABEL_COLS, RENAME_LABELS, corpus_schema, snake

# Every value comes back as it was: blanks at either end stay, an empty text
# is a quoted empty field and NULL an unquoted one (as in the study's files).
# The reader's NULL mark is what an unquoted empty field turns into inside the
# parser; it must differ from the empty text, so it is a lone NUL character.
CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "mode": "FAILFAST",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "emptyValue": '""', "nullValue": ""}
READ_OPTIONS = {**CSV_OPTIONS, "emptyValue": "", "nullValue": "\x00"}
WRITE_OPTIONS = {k: v for k, v in CSV_OPTIONS.items() if k != "mode"}


def read_corpus(spark: SparkSession, path: str, schema=None, by_name: bool = False, split: bool = False) -> DataFrame:
    """Header CSV whose text fields may hold quotes and newlines.

    Positional (default): the explicit corpus schema is applied column by
    column.  ``by_name=True``: the header is used instead - label columns
    may carry display names (``Emotional Intensity``) or the old names
    (``Clarity``); they are renamed to canonical snake_case, cast to INT,
    and an unnamed leading index column is dropped.

    ``split=True`` reads each file in many tasks (:func:`csv_records`); the
    reader's own way takes one task a file, since a line feed may be text.
    """
    reader = spark.read.options(**READ_OPTIONS)
    if not by_name:
        schema = schema or corpus_schema()
        return _parsed(csv_records(spark, path), schema) if split else reader.schema(schema).csv(path)
    raw = reader.option("inferSchema", "false").csv(path)       # its header alone is read here
    if split:
        raw = _parsed(csv_records(spark, path), raw.schema)
    names = {c: snake(RENAME_LABELS.get(c, c)) for c in raw.columns}
    cols = []
    for c, n in names.items():
        if c.startswith("_c") or c == "" or c.lower() == "unnamed: 0":
            continue
        col = F.col(f"`{c}`")
        if n == "post_id":
            col = col.cast("bigint")
        elif n in LABEL_COLS:
            col = col.cast("double").cast("int")
        cols.append(col.alias(n))
    return raw.select(*cols)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``(record,)``: the CSV records of UTF-8 files without their headers,
    however many lines a record has; a file is read split by split.

    Quotes are doubled inside quoted fields, so a line begins a record where
    the number of quotes before it is even.  Each split counts its quotes,
    and how many records begin in it if an even or an odd number came before;
    running sums over the splits (one row each) settle which, and number the
    records; lines of one record then meet by its number."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("n"), "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    block = Window.partitionBy("file", "at").orderBy("n")
    upto = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("q", quotes.cast("bigint"))
    lines = lines.withColumn("odd", (F.sum("q").over(upto) - F.col("q")) % 2)
    starts = [F.sum((F.col("odd") == k).cast("bigint")).over(upto).alias(f"s{k}") for k in (0, 1)]
    lines = lines.select("file", "at", "n", "value", "q", "odd", *starts)
    blocks = lines.groupBy("file", "at").agg(F.sum("q").alias("q"), F.max("s0").alias("s0"), F.max("s1").alias("s1"))
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("begin", F.coalesce(F.sum("q").over(before), F.lit(0)) % 2)
    blocks = blocks.withColumn("first", F.coalesce(
        F.sum(F.when(F.col("begin") == 0, F.col("s0")).otherwise(F.col("s1"))).over(before), F.lit(0)))
    numbered = lines.join(blocks.select("file", "at", "begin", "first"), ["file", "at"], "left")
    # lines before the first record of a split end the last record of the splits before it
    here = F.when(F.col("begin") == 0, F.col("s0")).otherwise(F.col("s1"))
    numbered = numbered.select("file", (F.col("first") + here - 1).alias("record"), F.struct("at", "n", "value").alias("line"))
    whole = numbered.groupBy("file", "record").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["value"]), "\n")
    whole = whole.where("record > 0").select(F.regexp_replace(text, "\r$", "").alias("record"))
    return whole.where("record <> ''")


def _parsed(records: DataFrame, schema) -> DataFrame:
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    options = {k: v for k, v in READ_OPTIONS.items() if k != "header"}
    return records.select(F.from_csv("record", ddl, options).alias("r")).select("r.*")


def write_corpus_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV sink with the same quoting rules (no index column is written)."""
    df.write.mode(mode).options(**WRITE_OPTIONS).csv(path)


def read_variants(spark: SparkSession, paths: Mapping[str, str], **kw) -> DataFrame:
    """The agreement variants as one table with ``dataset_version``."""
    frames = [read_corpus(spark, p, **kw).withColumn("dataset_version", F.lit(v)) for v, p in paths.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def union_variants(frames: Mapping[str, DataFrame]) -> DataFrame:
    """S2 for frames already in hand."""
    items = list(frames.items())
    out = items[0][1].withColumn("dataset_version", F.lit(items[0][0]))
    for v, f in items[1:]:
        out = out.unionByName(f.withColumn("dataset_version", F.lit(v)))
    return out


def write_corpus(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ("dataset_version",),
                 mode: str = "overwrite") -> None:
    """S3: corpus (optionally with split columns), partitioned by variant so
    readers of one variant prune the others."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.options(**WRITE_OPTIONS).csv(path)
    else:
        w.format(fmt).save(path)


# ------------------------------------------------------------------ reshapes
def label_vector(df: DataFrame, dims: Sequence[str] = LABEL_COLS, out: str = "labels") -> DataFrame:
    """The label columns as one ordered ``ARRAY<INT>``."""
    return df.withColumn(out, F.array(*[F.col(d).cast("int") for d in dims]))


def rename_labels(df: DataFrame, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Old label names to the current ones (display or snake_case)."""
    m = dict(mapping) if mapping is not None else {
        **RENAME_LABELS, **{snake(k): snake(v) for k, v in RENAME_LABELS.items()}}
    return df.withColumnsRenamed({k: v for k, v in m.items() if k in df.columns})


def with_arg_issue(df: DataFrame, out: str = "arg_issue") -> DataFrame:
    """``issue || ' ' || post_text``; a NULL on either side gives NULL
    (the study would fail on such a row); count them with :func:`null_text_rows`."""
    return df.withColumn(out, F.concat(F.col("issue"), F.lit(" "), F.col("post_text")))


def null_text_rows(df: DataFrame, col: str = "arg_issue") -> DataFrame:
    return df.agg(F.count(F.when(F.col(col).isNull(), 1)).alias("null_rows"))


def chosen_text(with_issue: bool) -> Column:
    return F.concat(F.col("issue"), F.lit(" "), F.col("post_text")) if with_issue else F.col("post_text")


def choose_text(df: DataFrame, with_issue: bool, out: str = "text") -> DataFrame:
    """The model input text, with or without the issue prefix."""
    return df.withColumn(out, chosen_text(with_issue))


def melt(df: DataFrame, ids: Sequence[str], dims: Sequence[str] = LABEL_COLS, var: str = "dim",
         value: str = "y") -> DataFrame:
    """Wide labels to long ``(ids..., dim, y)``."""
    return df.unpivot(list(ids), list(dims), var, value)


def display_names(df: DataFrame, dims: Sequence[str] = LABEL_COLS) -> DataFrame:
    """Canonical columns back to the study's display names (for export)."""
    disp = dict(zip(LABEL_COLS, DIMS))
    return df.withColumnsRenamed({d: disp[d] for d in dims if d in df.columns})
