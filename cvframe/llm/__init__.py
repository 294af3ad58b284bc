"""Operators of a training-data pipeline, written as Spark jobs.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
