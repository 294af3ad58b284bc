"""Helpers shared by the operators: reading, shared scratch tables, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cvframe.session import written  # noqa: F401

#: Words are runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (compared as Spark does)."""
    taken = {c.lower() for c in df.columns}
    name, i = base, 0
    while name.lower() in taken:
        i += 1
        name = f"{base}_{i}"
    return name


def quoted(name: str) -> Column:
    """A top-level column whatever its name holds (dots, blanks)."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor`` (NULL id: NULL)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(divisor)
