"""Corpus pipeline: documents -> clean, distinct, mixed, encoded.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read again as the
next one's ``docs``.  All but the last return the columns of ``docs``.

1. toxicity: documents predicted toxic go.
2. quality: documents not predicted of good quality go.
3. near_dedup: one document of each SimHash component stays.
4. mixing: documents are emitted once per copy the target weights give.
5. encoding: ids of the whole text, their number and a digest per document.

Rows with NULL or empty texts go through every stage (their scores are those
of an empty text; they are near copies of one another).  Extra columns pass
through stages 1 to 4.  Classifiers learn from the labels of the documents
that reach their stage; with none, nothing can be told apart and the base
rate decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cvframe.llm import mixing, pieces, quality, simhash, toxicity
from cvframe.llm.common import fresh, quoted, table, written
from cvframe.llm.queries import tokenizer_path


def _scored(docs: DataFrame, classifier, model) -> tuple[DataFrame, str]:
    name = fresh(docs, "score")
    return classifier.score(docs, model, name=name), name


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored, score = _scored(docs, toxicity, toxicity.fit(docs, sf_dir))
    return scored.where(quoted(score) < toxicity.THRESHOLD).select(*[quoted(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored, score = _scored(docs, quality, quality.fit(docs, sf_dir))
    return scored.where(quoted(score) >= quality.THRESHOLD).select(*[quoted(c) for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs)
    return mixing.emit(mixed, docs.columns, mixed.columns[-1])


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = pieces.encode(docs.select("doc_id", "source", "text"), tokenizer_path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: SQL can express neither the classifiers nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
