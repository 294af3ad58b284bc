"""The registered queries on the smallest tables: columns, types, SQL."""

import math

import duckdb
import pytest

from cvframe.llm.queries import ORACLES, QUERIES

CONTRACT = {
    "op1_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op3_chat_tools": {"conv_id": "bigint", "call_id": "string", "status": "string", "record": "string"},
    "op4_html_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op5_pieces": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op6_sequences": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op7_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op8_impact_topk": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op9_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10_prefix_forest": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op11_hard_negatives": {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint",
                            "positive_score": "bigint", "negative_score": "bigint"},
    "op12_spelling": {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"},
    "op13_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
}


def test_all_operators_have_a_query():
    assert set(QUERIES) == set(CONTRACT) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", CONTRACT)
def test_contract_columns(spark, sf_small, name):
    df = QUERIES[name](spark, sf_small)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in CONTRACT[name]} == CONTRACT[name]
    if "doc_id" in kinds:
        want = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id")
        assert sorted(r[0] for r in df.select("doc_id").collect()) == sorted(r[0] for r in want.collect())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf_small, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    want = con.execute(ORACLES[name])
    cols = [c[0] for c in want.description]
    key = lambda r: tuple(round(v, 9) if isinstance(v, float) and not math.isnan(v) else v for v in r)
    got = QUERIES[name](spark, sf_small).select(*cols).collect()
    assert sorted(key(tuple(r)) for r in got) == sorted(key(r) for r in want.fetchall())
