"""The streaming run leaderboard picks up records as they land."""

import tempfile

from cvframe.sources import runs_io as RIO
from cvframe.streaming import run_record_schema, run_until_caught_up


def test_incremental_mean(spark):
    root = tempfile.mkdtemp(prefix="cvframe-stream-")
    src, out = root + "/runs", root + "/board"
    first = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 0, 1, 3.0), ("b", 0, 0, 5.0)],
                                  "approach string, repeat int, fold int, eval_mean_F1 double")
    RIO.write_runs(first, src, mode="append")
    schema = run_record_schema(["mean_F1"])
    table = run_until_caught_up(spark, src, schema, out=out)
    got = {r["approach"]: (r["value"], r["n_runs"]) for r in spark.read.parquet(table).collect()}
    assert got == {"a": (2.0, 2), "b": (5.0, 1)}
    second = spark.createDataFrame([("b", 1, 0, 7.0)], "approach string, repeat int, fold int, eval_mean_F1 double")
    RIO.write_runs(second, src, mode="append")
    table = run_until_caught_up(spark, src, schema, out=out)
    got = {r["approach"]: (r["value"], r["n_runs"]) for r in spark.read.parquet(table).collect()}
    assert got == {"a": (2.0, 2), "b": (6.0, 2)}
