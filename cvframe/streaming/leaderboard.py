"""Incremental run aggregation with Structured Streaming.

The study compares approaches only after all 25 runs per approach have
finished and written their records.  The same mean-over-runs (R1) can be
kept up to date while runs land: the run-record folder is a streaming file
source, each record is unpivoted to ``(approach, repeat, fold, metric,
value)`` and a streaming aggregate keeps sum and count per (approach,
metric).  The result table is small (approaches x metrics); every trigger
rewrites it as a parquet table in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cvframe.session import scratch_dir
from cvframe.sources.runs_io import runs_long


def run_record_schema(metrics: list[str], prefix: str = "eval_") -> T.StructType:
    """Schema of partitioned run records (partition columns included)."""
    return T.StructType(
        [T.StructField(f"{prefix}{m}", T.DoubleType(), True) for m in metrics]
        + [T.StructField("approach", T.StringType(), True), T.StructField("repeat", T.IntegerType(), True),
           T.StructField("fold", T.IntegerType(), True)]
    )


def mean_runs_stream(spark: SparkSession, root: str, schema: T.StructType, prefix: str = "eval_",
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of ``(approach, metric, value, n_runs)``."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    records = reader.json(root)
    long = runs_long(records, prefix)
    return long.groupBy("approach", "metric").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n_runs"))


def run_until_caught_up(spark: SparkSession, root: str, schema: T.StructType, out: str | None = None,
                        prefix: str = "eval_", max_files_per_trigger: int | None = None) -> str:
    """Process every record present now (``availableNow``), keeping the
    running leaderboard at ``out``; returns the table path.  Re-running with
    the same ``out`` resumes from its checkpoint and adds only new records."""
    out = out or scratch_dir(spark, "stream-mean-runs")
    agg = mean_runs_stream(spark, root, schema, prefix, max_files_per_trigger)

    def publish(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/table")

    q = (agg.writeStream.outputMode("complete").foreachBatch(publish)
         .option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return f"{out}/table"
