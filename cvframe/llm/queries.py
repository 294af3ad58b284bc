"""One query per operator: ``opN_<name>(spark, sf_dir)`` over whole tables.

Each query applies its operator with production parameters and derives the
digest columns from the operator's outputs.  ``ORACLES`` holds DuckDB SQL
where SQL can express the result; the others are tested against brute force
in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cvframe.llm import chat_tools, hard_negatives, html_text, impact_topk, language, mixing, pieces, prefix_forest, quality, sequences, simhash, spelling, toxicity
from cvframe.llm.common import table

def tokenizer_path(name: str) -> str:
    """A public vocabulary file by name (the operators take any path)."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), sf_dir)


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op3_chat_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat_tools.from_conversations(table(spark, sf_dir, "conversations"))
    return chat_tools.link(calls, results, chat_tools.TOOLS)


@query
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", html_text.extract(F.col("html")).alias("main"))
    return pages.select("page_id", "url", F.col("main.text").alias("text"),
                        F.length("main.text").cast("long").alias("n_chars"),
                        F.col("main.n_lines").alias("n_lines"), F.col("main.n_kept").alias("n_kept"))


@query
def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.encode(docs, tokenizer_path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op6_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = sequences.new_folder(spark)
    shards = sequences.write(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), folder, end_id=2)
    return sequences.read_documents(shards, folder)


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    docs = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("words"))
    mixed = mixing.mix(docs, size_col="words")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLES["op7_mixing"] = mixing.ORACLE


@query
def op8_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


ORACLES["op8_impact_topk"] = impact_topk.ORACLE


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), sf_dir)


@query
def op10_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", noisy), F.col("vec_id") % 100 == 0)


ORACLES["op11_hard_negatives"] = hard_negatives.ORACLE


@query
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


ORACLES["op12_spelling"] = spelling.ORACLE


@query
def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.classify(table(spark, sf_dir, "documents"))
