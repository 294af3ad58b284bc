"""Mixing sources to target weights by systematic sampling (native).

Targets are a water-filling over the small table of sources; documents are
then taken along one deterministic order per source, each with the same
expected number of copies, and a document is emitted once per integer its
running sum of expected copies (plus the source's offset) crosses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cvframe.llm.common import WORD_PATTERN, fresh, quoted, written

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 7


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> plus ``target``.

    Sources by code point, NULL last, get the weights in turn.  Everything is
    shared in proportion to weight; a source whose share reaches
    ``max_epochs`` times its size stops there and the excess is shared among
    the others.  In ascending order of cap / weight the share per unit of
    weight, (total - caps before) / (weights from here on), rises while
    sources are capped and falls afterwards, so its maximum is the final
    level and each target is min(cap, level * weight).

    The windows run over one row per source (an aggregate), never documents.
    """
    by_source = Window.orderBy(F.col("source").isNull(), F.col("source"))
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.row_number().over(by_source) - 1) % n + 1).cast("int"))
    cap = F.col("source_size") * F.lit(max_epochs)
    t = totals.select("source", "source_size", weight.alias("w"), cap.alias("cap"))
    everything = Window.partitionBy()
    rising = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    t = t.select(
        "*",
        F.sum("source_size").over(everything).alias("all_size"),
        F.sum("w").over(everything).alias("all_w"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
        F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("w_before"),
    )
    level = F.max((F.col("all_size") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before"))).over(everything)
    t = t.select("source", "source_size", "w", "cap", level.alias("level"))
    return t.select("source", "source_size",
                    F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        size_col: str | None = None, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """All rows and columns of ``docs`` plus size, source_size, target, copies.

    ``size_col`` names an existing word count; otherwise the words of the
    text are counted (NULL or empty text: 0 words, expected copies as any
    other document of its source, 0 words taken).  Added columns that clash
    with existing ones get a numeric suffix; the returned frame's last four
    columns are always size, source_size, target and copies in this order.

    Within a source documents stand by size (largest first), md5 of the id,
    id and a hash of the row, so the taken words miss the target by less than
    the largest document, and reruns agree.  Repeated rows are separate
    documents; NULL ids and NULL sources are values of their own.  An empty
    table gives an empty result.

    The place in that order is a sum of three counts: documents of larger
    size (a window over distinct sizes), documents of the same size in
    earlier md5 buckets (a window over 256 bucket counts) and a row number
    within the bucket, so no window task holds a source or a group of copies.
    """
    g = {k: fresh(docs, f"_mix_{k}") for k in ("src", "size", "md5", "bucket", "row")}
    sid, doc, text = quoted(source_col), quoted(id_col), quoted(text_col)
    size = F.coalesce(quoted(size_col), F.lit(0)).cast("long") if size_col else word_count(text)
    # one non-null text per source, NULL apart from every real value
    src = F.when(sid.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), sid.cast("string")))
    md5 = F.md5(F.coalesce(F.concat(F.lit("="), doc.cast("string")), F.lit("")))
    base = docs.select("*", src.alias(g["src"]), size.alias(g["size"]), md5.alias(g["md5"]))
    base = base.withColumn(g["bucket"], F.substring(quoted(g["md5"]), 1, 2))

    counts = written(
        base.groupBy(quoted(g["src"]).alias("src"), quoted(g["size"]).alias("size"), quoted(g["bucket"]).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    per_size = counts.groupBy("src", "size").agg(F.sum("n").alias("n"))
    larger = Window.partitionBy("src").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    per_size = per_size.select("src", "size", F.coalesce(F.sum("n").over(larger), F.lit(0)).alias("larger"))
    totals = counts.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    totals = totals.select(
        F.when(F.col("src") != "", F.expr("substring(src, 2)")).alias("source"), "source_size")
    targets = source_targets(totals, weights, max_epochs)
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("src")
    offset = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit("")))), 1, 8), 16, 10)
              .cast("double") / F.lit(4294967296.0))
    targets = targets.select(
        key, "source_size", "target", offset.alias("u"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))
    earlier = Window.partitionBy("src", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        counts.select("src", "size", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
        .join(per_size, ["src", "size"]).join(targets, "src")
        .select(F.col("src").alias(g["src"]), F.col("size").alias(g["size"]), F.col("bucket").alias(g["bucket"]),
                F.struct((F.col("earlier") + F.col("larger")).alias("start"), "source_size", "target", "u", "rate").alias(g["row"]))
    )
    keys = [g["src"], g["size"], g["bucket"]]
    rank = fresh(docs, "_mix_rank")
    within = Window.partitionBy(*[quoted(k) for k in keys]).orderBy(
        quoted(g["md5"]), doc, F.xxhash64(*[quoted(c) for c in docs.columns]))
    placed = base.withColumn(rank, F.row_number().over(within)).join(starts, keys, "left")
    r = quoted(g["row"])
    place = (r["start"] + quoted(rank)).cast("double")
    crossed = F.floor(r["rate"] * place + r["u"]) - F.floor(r["rate"] * (place - 1) + r["u"])
    copies = F.least(crossed, F.lit(max_epochs)).cast("long")
    names = [fresh(docs, n) for n in ("size", "source_size", "target", "copies")]
    return placed.select(
        *[quoted(c) for c in docs.columns],
        quoted(g["size"]).alias(names[0]), r["source_size"].alias(names[1]), r["target"].alias(names[2]), copies.alias(names[3]))


def emit(mixed: DataFrame, columns: list[str], copies_col: str) -> DataFrame:
    """``columns`` of each document, once per copy taken."""
    n = fresh(mixed, "_copy")
    return mixed.select(
        *[quoted(c) for c in columns],
        F.explode(F.array_repeat(F.lit(1), quoted(copies_col).cast("int"))).alias(n)).select(*[quoted(c) for c in columns])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('=' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
             source_size * 3 AS cap FROM s),
o AS (SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
             coalesce(sum(cap) OVER q, 0) AS cap_before, coalesce(sum(w) OVER q, 0) AS w_before
      FROM w WINDOW q AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, max(CAST(total - cap_before AS DOUBLE) / (all_w - w_before)) OVER () AS level FROM o),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), level * w) AS target,
             CAST('0x' || substr(md5('7:' || coalesce(source, '')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.u,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
             CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, d.h, d.doc_id) AS DOUBLE) AS place
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * least(floor(rate * place + u) - floor(rate * (place - 1) + u), 3) AS BIGINT) AS taken
FROM r
"""
