"""Run-record sources and sinks.

A run record is one flat JSON object of metrics per (approach, repeat,
fold).  Two directory layouts are read and written:

* ``partitioned``: ``root/approach=a/repeat=r/fold=f/part-*.json``;
* ``study``: ``root/<approach>/fold<f>/fold<r>.<f>/test_results.json``.  Only
  files of exactly that name are read (a trainer leaves other JSON files
  beside them, some with the same metrics); approach, repeat and fold come
  from each file's own path, never from a loop position.

Metrics have one naming everywhere: ``<label>_{precision,recall,macroF1}``
with the label in snake case and ``mean_{F1,precision,recall}``, each behind
``eval_`` inside a record.  The study's display names (``Emotional
Intensity``) are mapped on the way in and back on the way out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cvframe.schema import DISPLAY, snake

RECORD_FILE = "test_results.json"
STUDY_PATH = r"/([^/]+)/fold\d+/fold(\d+)\.(\d+)/[^/]+$"
KEYS = ["approach", "repeat", "fold"]
MEASURES = ("precision", "recall", "macroF1")


def metric_name(name: str) -> str:
    """One naming: a display label before the measure becomes snake case."""
    label, _, measure = name.rpartition("_")
    return f"{snake(label)}_{measure}" if measure in MEASURES and label != "mean" else name


def study_metric_name(name: str) -> str:
    """The study's key of a metric: snake case back to the display label."""
    label, _, measure = name.rpartition("_")
    return f"{DISPLAY[label]}_{measure}" if measure in MEASURES and label in DISPLAY else name


def write_runs(wide: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON record per run, partitioned by approach / repeat / fold."""
    wide.write.mode(mode).partitionBy(*KEYS).json(path)


def _local_or_remote(root: str):
    from pyarrow import fs

    parts = urlsplit(root)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), "/" + unquote(parts.path).lstrip("/")
    return fs.FileSystem.from_uri(root)


def write_study_runs(wide: DataFrame, root: str) -> DataFrame:
    """S5 in the study's layout and key names; returns the files written.

    Each task writes its records to the shared folder, a file at a time under
    a name of its own attempt that is renamed when complete, so a second copy
    of a task cannot pass on a half-written file; a run that is written again
    replaces its file.  Outside local mode the folder needs a scheme (a plain
    path would be each executor's own disk)."""
    if not urlsplit(root).scheme and not wide.sparkSession.sparkContext.master.startswith("local"):
        raise ValueError(f"{root} names no file system; executors would each write to their own disk")
    metrics = [c for c in wide.columns if c not in KEYS]
    keys = {c: ("eval_" + study_metric_name(c[5:])) if c.startswith("eval_") else c for c in metrics}

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, top = _local_or_remote(root.rstrip("/"))
        for pdf in frames:
            done = []
            for row in pdf.to_dict("records"):
                folder = f"{top}/{row['approach']}/fold{int(row['fold'])}/fold{int(row['repeat'])}.{int(row['fold'])}"
                fs.create_dir(folder, recursive=True)
                record = {keys[c]: row[c] for c in metrics if row[c] is not None and row[c] == row[c]}
                mine = f"{folder}/_{TaskContext.get().taskAttemptId()}-{RECORD_FILE}"
                with fs.open_output_stream(mine) as out:
                    out.write(json.dumps(record, indent=4).encode())
                fs.move(mine, f"{folder}/{RECORD_FILE}")
                done.append((row["approach"], int(row["repeat"]), int(row["fold"])))
            yield pd.DataFrame(done, columns=KEYS)

    files = wide.withColumn("approach", F.col("approach").cast("string")).mapInPandas(write, "approach string, repeat int, fold int")
    return wide.sparkSession.createDataFrame(files.collect(), "approach string, repeat int, fold int")  # one row per run


def read_runs_wide(spark: SparkSession, root: str, layout: str = "partitioned", schema=None, unique: bool = True) -> DataFrame:
    """S4 (wide): every record with its ``approach`` (text), ``repeat``, ``fold``.

    A run found twice is refused (``unique=False`` keeps both): it would count
    double in every mean and test."""
    if layout == "partitioned":
        found = schema or spark.read.json(root).schema
        # a folder name is text: left to inference, approach 007 would become 7
        kinds = {"approach": T.StringType(), "repeat": T.IntegerType(), "fold": T.IntegerType()}
        fields = [f for f in found.fields if f.name not in kinds] + [T.StructField(k, t) for k, t in kinds.items()]
        r = spark.read.schema(T.StructType(fields)).json(root)
    elif layout == "study":
        reader = spark.read.option("multiLine", "true")
        if schema is not None:
            reader = reader.schema(schema)
        r = reader.json(f"{root.rstrip('/')}/*/fold*/fold*.*/{RECORD_FILE}")
        p = F.col("_metadata.file_path")
        name = F.url_decode(F.regexp_replace(F.regexp_extract(p, STUDY_PATH, 1), r"\+", "%2B"))
        r = r.select(
            name.alias("approach"),
            F.regexp_extract(p, STUDY_PATH, 2).cast("int").alias("repeat"),
            F.regexp_extract(p, STUDY_PATH, 3).cast("int").alias("fold"),
            *[F.col(f"`{c}`") for c in r.columns],
        )
    else:
        raise ValueError(layout)
    if unique:
        twice = r.groupBy(*KEYS).count().filter("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"run {twice[0]['approach']} {twice[0]['repeat']}.{twice[0]['fold']} has {twice[0]['count']} records")
    return r


def runs_long(wide: DataFrame, prefix: str = "eval_", strip_prefix: bool = True) -> DataFrame:
    """Wide records to the long run table ``(approach, repeat, fold, metric, value)``.

    Every numeric key is kept under its one name (missing keys become NULL
    rows, dropped)."""
    metrics = [c for c in wide.columns if c not in KEYS and c != "_metadata"]
    if prefix:
        metrics = [c for c in metrics if c.startswith(prefix)]
    entries = F.array(
        *[F.struct(F.lit(metric_name(c[len(prefix):] if strip_prefix and prefix else c)).alias("metric"),
                   F.col(f"`{c}`").cast("double").alias("value")) for c in metrics]
    )
    return wide.select(*KEYS, F.inline(entries)).filter(F.col("value").isNotNull())


def read_runs(spark: SparkSession, root: str, layout: str = "partitioned", prefix: str = "eval_") -> DataFrame:
    """The long run table in one scan of the directory tree."""
    return runs_long(read_runs_wide(spark, root, layout), prefix)


def write_latex(table: DataFrame, path: str) -> None:
    """``(part, i, line)`` rows (a table of one line per approach plus a
    fixed frame) as one ordered text file."""
    table.coalesce(1).sortWithinPartitions("part", "i").select("line").write.mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, line)`` of a text file of one part, in file order."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.split(F.regexp_replace("value", r"\n$", ""), "\n"))).toDF("line_no", "line")
