"""Distributed ordered index.

``row_number() over (partition by P order by G, h, id) - 1`` where ``h`` is a
hex md5 string.  A window with a thin (or empty) ``P`` collapses into a few
tasks, and one huge group ``G`` (say, the all-zero labelset holding half of
the corpus) would do the same.  Instead:

1. split every ``(P, G)`` group into ``16**digits`` buckets by the leading
   hex digits of ``h`` (buckets are ordered the same way as ``h``);
2. ``row_number`` *within* ``(P, G, bucket)``: the one shuffle of the rows;
3. a bucket's size is its last rank, so the sizes come from the same
   shuffled rows (the exchange is reused) and nothing is counted beforehand;
4. offsets in two levels: a running sum over the totals per ``(P, G)`` (at
   most ``|G|`` rows per ``P``) and one over the buckets of each ``(P, G)``
   (at most ``16**digits`` rows per window), so no window task holds the
   whole size table;
5. rank plus offset.

``digits=3`` (4096 buckets per group) keeps a group holding 10^10 rows at a
few million rows per window task.  The offset table is joined on the keys
the window is partitioned by, so the big side is shuffled exactly once; AQE
broadcasts the offsets when their measured size is small and falls back to
a co-partitioned join otherwise.

Both uses of the shuffled rows must ask for the same columns, or Spark
would prune one of them and shuffle twice: everything but keys and hash
travels in one struct, which is also the window's last sort key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_COL = "_bkt"


def running_offsets(
    counts: DataFrame,
    partition_cols: Sequence[str],
    group_cols: Sequence[str],
    bucket_col: str,
    count_cols: Sequence[str],
    offset_cols: Sequence[str],
    group_order: Sequence[Column] | None = None,
) -> DataFrame:
    """Adds, per count column, the sum of that column over all rows that come
    earlier in ``(group order, bucket)`` order within ``P``.

    Two levels: the running sum over the buckets of the row's own group
    (``16**digits`` rows) plus the running sum over group totals (``|G|`` rows
    per ``P``).  A group's total is its last running sum.  ``group_order``
    (by default the group columns) may hold expressions over P and G; they
    are computed once per group."""
    groups = [*partition_cols, *group_cols]
    own = Window.partitionBy(*groups).orderBy(bucket_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = counts.select("*", *[F.sum(c).over(own).alias(f"_s_{c}") for c in count_cols])
    within = [(F.col(f"_s_{c}") - F.col(c)).alias(o) for c, o in zip(count_cols, offset_cols)]
    if not group_cols:
        return summed.select(*counts.columns, *within)
    totals = summed.groupBy(*groups).agg(*[F.max(f"_s_{c}").alias(f"_t_{c}") for c in count_cols])
    order = [F.col(g) for g in group_cols] if group_order is None else list(group_order)
    totals = totals.select("*", *[x.alias(f"_k{i}") for i, x in enumerate(order)])
    before = Window.partitionBy(*partition_cols).orderBy(*[f"_k{i}" for i in range(len(order))]).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    totals = totals.select(*groups, *[(F.sum(f"_t_{c}").over(before) - F.col(f"_t_{c}")).alias(f"_g_{c}") for c in count_cols])
    # left joins here and below: every key is there, and an inner join would
    # add IsNotNull filters to one use of the shuffled rows only
    both = summed.join(totals, groups, "left")
    return both.select(*counts.columns, *[(F.col(f"_s_{c}") - F.col(c) + F.col(f"_g_{c}")).alias(o)
                                          for c, o in zip(count_cols, offset_cols)])


def ordered_index(
    df: DataFrame,
    partition_cols: Sequence[str],
    group_cols: Sequence[str],
    hash_col: str,
    id_col: str,
    out_col: str = "pos",
    digits: int = 3,
    group_order: Sequence[Column] | None = None,
) -> DataFrame:
    """Adds ``out_col`` = 0-based position in ``(G, hash, id)`` order within ``P``
    (``group_order``: expressions over P and G to order the groups by).
    Rows equal in hash and id are ordered by their other columns."""
    keys = [*partition_cols, *group_cols, BUCKET_COL]
    lead = [id_col] if id_col not in keys else []
    row = F.struct(*lead, *[F.col(c) for c in df.columns if c not in keys and c not in (id_col, hash_col)])
    d = df.withColumn(BUCKET_COL, F.substring(F.col(hash_col), 1, digits)).select(*keys, hash_col, row.alias("_row"))
    # the struct decides among equal hashes only: comparing it is slow
    ranked = d.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(hash_col, "_row")).cast("bigint"))
    sizes = ranked.groupBy(*keys).agg(F.max("_rn").alias("_n"))
    offsets = running_offsets(sizes, partition_cols, group_cols, BUCKET_COL, ["_n"], ["_off"], group_order).drop("_n")
    j = ranked.join(offsets, keys, "left")
    cols = [F.col(f"_row.`{c}`").alias(c) if c not in keys and c != hash_col else F.col(c) for c in df.columns]
    return j.select(*cols, (F.col("_off") + F.col("_rn") - F.lit(1)).cast("bigint").alias(out_col))
