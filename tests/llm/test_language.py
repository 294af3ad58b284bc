"""Language identification: the parse by brute force, accuracy, edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cvframe.llm import language as L


def parsed(data, sample):
    """Phrases of one stretch: longest matches from left to right."""
    n, i = 0, 0
    while i < len(data):
        j = i + 1
        while j < len(data) and any(data[i:j + 1] in p for p in sample):
            j += 1
        n, i = n + 1, j
    return n


@pytest.mark.parametrize("seed", range(30))
def test_phrases_are_those_of_the_definition(seed, monkeypatch):
    monkeypatch.setattr(L, "STRETCH", 16)
    r = random.Random(seed)
    letters = b"ab" if seed % 2 else b"abcd "

    def some(n, more=b""):
        return bytes(r.choice(letters + more) for _ in range(n))

    models = {}
    samples = {}
    for lang in ("x", "y"):
        samples[lang] = [some(r.randint(1, 20)) for _ in range(r.randint(1, 6))]
        models[lang] = (*L.automaton(samples[lang]), sum(map(len, samples[lang])))
    texts = [some(n, b"zq") for n in (0, 1, 5, 16, 17, 32, 100, 3, 0)]
    sizes = np.array([len(t) for t in texts])
    got = L.Parser(models).phrases(np.frombuffer(b"".join(texts), np.uint8), sizes)
    for lang in models:
        want = [sum(parsed(t[a:a + 16], samples[lang]) for a in range(0, len(t), 16)) for t in texts]
        assert got[lang].tolist() == want


def test_automaton_knows_every_substring_and_no_other():
    sample = [b"abcbc", b"bcbcd", b"abcbc", b"dab"]
    edges, _ = L.automaton(sample)
    step = {(s, b): t for s, b, t in edges.tolist()}

    def known(data):
        state = 0
        for b in data:
            state = step.get((state, b))
            if state is None:
                return False
        return True

    parts = {p[i:j] for p in sample for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
    assert all(map(known, parts))
    r = random.Random(1)
    for _ in range(3000):
        w = bytes(r.choice(b"abcd") for _ in range(r.randint(1, 6)))
        assert known(w) == (w in parts)


def test_plain():
    assert L.plain("Été, 12 x_y\n") == " été x y ".encode()
    assert L.plain(None) == L.plain("") == L.plain("12 !? _") == b""


def test_held_out_accuracy(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    rows = docs.select("doc_id", "lang").join(L.classify(docs), "doc_id").where("held_out").collect()
    assert len(rows) > 30 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)


def test_held_out_languages_cannot_matter(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    other = docs.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang")))
    assert sorted(map(tuple, L.classify(docs).collect())) == sorted(map(tuple, L.classify(other).collect()))


LANGS = {"en": "the house and the garden were white with snow and the children ran home ",
         "de": "das haus und der garten waren weiß vom schnee und die kinder liefen heim "}


def test_rows_of_every_kind(spark):
    """NULLs anywhere, no letters, very long and repeated texts, ties."""
    rows = [(i, LANGS[lang] * 3, lang) for i in range(40) for lang in LANGS]
    rows += [(100, None, "en"), (101, "", "en"), (102, "12 34 !", None), (None, LANGS["de"], "de"), (103, LANGS["de"], None),
             (104, LANGS["en"] * 3000, None), (103, LANGS["de"], None), (105, "qqq", "zz"), (None, None, None), (106, "жжж", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    df = df.selectExpr("*", "'x' AS lang_pred", "0.1D AS score", "1 AS place", "2 AS h", "3 AS `a.b`")
    got = L.classify(df).collect()
    assert len(got) == len(rows)
    of = {}
    for r in got:
        of.setdefault(r["doc_id"], []).append((r["lang_pred"], r["held_out"]))
        assert 0 <= r["score"] <= 1
    assert of[100][0][0] == of[101][0][0] == of[102][0][0] == "und"
    assert sorted(of[None], key=str) == [("de", None), ("und", None)]
    assert [x[0] for x in of[103]] == ["de", "de"] and of[104][0][0] == "en"
    assert all(of[i][k][0] in LANGS for i in range(40) for k in (0, 1))
    with pytest.raises(ValueError, match="lang_pred"):
        L.predict(df, L.Parser({}))


def test_nothing_learned_and_empty_table(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in L.classify(df).collect()] == [("und", 0.0)]
    assert L.classify(df.where("false")).collect() == []
    one = spark.createDataFrame([(i, "some text", "en") for i in range(9)], "doc_id long, text string, lang string")
    assert {tuple(r)[2:] for r in L.classify(one).collect()} == {("en", 1.0)}


def test_bounds_of_the_sample(spark):
    rows = [(i, LANGS["en"] * 20, f"l{i % 5}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    parser = L.learn(df, documents=4, passages=3, passage_bytes=50, languages=2)
    assert sorted(parser.models) == sorted(parser.models)[:2] and len(parser.models) == 2
    assert all(size <= 150 for _, _, size in parser.models.values())
