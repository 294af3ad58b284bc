"""Hash-keyed randomness.

Every random choice in the library is a pure function of ``md5(key ':' id)``
so that a run is reproducible on any cluster layout and checkable by an
independent SQL engine.  ``rand``/``shuffle``/``xxhash64`` are never used
for anything that has to be reproduced.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_DIGITS = 6
UNIT_RANGE = 16**UNIT_DIGITS  # 16777216


def sql_str(v) -> str:
    """A SQL string literal."""
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def keyed_md5_sql(key_sql: str, id_sql: str) -> str:
    return f"md5(concat(CAST({key_sql} AS STRING), ':', CAST({id_sql} AS STRING)))"


def unit_hash_sql(key_sql: str, id_sql: str, digits: int = UNIT_DIGITS) -> str:
    return f"CAST(conv(substring({keyed_md5_sql(key_sql, id_sql)}, 1, {digits}), 16, 10) AS BIGINT)"


def bernoulli_sql(key: str, id_sql: str, p: float) -> str:
    """SQL text of :func:`bernoulli` (one expression, parsed JVM-side)."""
    return f"CAST({unit_hash_sql(sql_str(key), id_sql)} < {float(UNIT_RANGE * p)!r} AS INT)"


def _lit_or_col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(str(x))


def keyed_md5(key, id_col) -> Column:
    """``md5(key || ':' || id)`` as a 32-char lower-case hex string."""
    idc = id_col if isinstance(id_col, Column) else F.col(id_col)
    return F.md5(F.concat(_lit_or_col(key).cast("string"), F.lit(":"), idc.cast("string")))
