"""Structured Streaming versions of the run aggregation (the study itself
is batch-only; these keep the same results up to date as runs finish)."""

from cvframe.streaming.leaderboard import mean_runs_stream, run_record_schema, run_until_caught_up  # noqa: F401
