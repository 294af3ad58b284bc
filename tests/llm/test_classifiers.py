import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cvframe.llm import quality, toxicity
from cvframe.llm.words import WordTable, sums

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("module, label, mod, rest, floor", [(quality, "quality", 4, 2, 0.98), (toxicity, "toxic", 3, 1, 0.97)])
def test_held_out_accuracy(spark, module, label, mod, rest, floor):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = module.classify(docs, SF).cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    rows = got.join(labels, "doc_id").collect()
    assert got.count() == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == rest) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["y"] for r in held]) >= floor
    # calibrated: the mean score is near the share of label 1
    assert abs(np.mean([r["score"] for r in held]) - np.mean([r["y"] for r in held])) < 0.04
    got.unpersist()


TEXTS = [None, "", "  ", "One two three.", "one!! two%%% | x", "you idiot " * 40, "word " * 50_000, "é" * 1000]


@pytest.fixture(scope="module")
def small(make_docs, label_dir):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(300):
        words = [f"w{rng.integers(60)}" for _ in range(int(rng.integers(5, 60)))]
        bad, rude = i % 4 == 0, i % 3 == 0
        if bad:
            words = [f"{w}%%%" for w in words]
        if rude:
            for _ in range(3):
                words.insert(int(rng.integers(len(words))), "you grumbleface")
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(not bad), int(rude)))
    rows += [(1000 + k, t, None) for k, t in enumerate(TEXTS)] + [(None, "no id", "s"), (5, rows[5][1], "s")]
    labels += [(None, 1, 1), (2000, None, None), (7, 0, 0), (7, 1, 1)]
    return make_docs(rows, extra=("score", "label")), label_dir(labels)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows(small, make_docs, module):
    docs, sf = small
    model = module.fit(docs, sf)
    got = module.score(docs, model)
    assert got.columns == [*docs.columns, "score_1"]
    rows = got.collect()
    assert len(rows) == docs.count() and all(0 <= r["score_1"] <= 1 for r in rows)
    by_text = {}
    for r in rows:          # the text alone decides; empty, blank and NULL alike
        by_text.setdefault((r["text"] or "").strip(), set()).add(r["score_1"])
    assert all(len(s) == 1 for s in by_text.values())
    want = (lambda i: i % 4 != 0) if module is quality else (lambda i: i % 3 == 0)
    own = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 300]
    assert np.mean([(r["score_1"] >= 0.7) == want(r["doc_id"]) for r in own]) > 0.95
    assert module.score(docs.limit(0), model).collect() == []


@pytest.mark.parametrize("module", [quality, toxicity])
def test_reruns_agree_and_labels_may_lack(spark, small, make_docs, label_dir, module):
    docs, sf = small
    a, b = (sorted(map(str, module.score(d, module.fit(d, sf)).select("doc_id", "score_1").collect()))
            for d in (docs.coalesce(1), docs.repartition(5)))
    assert a == b
    for labels in ([], [(i, 1, 0) for i in range(20)]):     # none, or one kind only
        empty = label_dir(labels)
        got = module.score(docs, module.fit(docs, empty)).select("score_1").distinct().collect()
        assert len(got) == 1 and 0 < got[0][0] < 1
    none = make_docs([])
    assert module.score(none, module.fit(none, sf)).collect() == []


def test_held_out_labels_teach_nothing(small, spark, label_dir):
    docs, sf = small
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    for module, mod, rest in ((quality, 4, 2), (toxicity, 3, 1)):
        flipped = label_dir([(i, None if q is None else 1 - q, None if t is None else 1 - t)
                             if i is not None and zlib.crc32(str(i).encode()) % mod == rest else (i, q, t) for i, q, t in labels])
        a, b = (sorted(map(str, module.score(docs, module.fit(docs, d)).select("doc_id", "score_1").collect())) for d in (sf, flipped))
        assert a == b


def test_context_sums_by_brute_force(make_docs, spark):
    rows = [(0, "a b c a", "s"), (1, "b", "s"), (2, "c a b", "s"), (3, None, "s")]
    got = quality.context_sums(make_docs(rows).repartition(3))
    place, sign = quality.index_vectors()
    want = np.zeros_like(got)
    for _, t, _ in rows:
        ws = quality._bucket((t or "").split())
        for i, w in enumerate(ws):
            for j in range(max(0, i - quality.REACH), min(len(ws), i + quality.REACH + 1)):
                if j != i:
                    want[w, place[ws[j]]] += sign[ws[j]]
    assert (got == want).all()


def test_sums_and_word_table():
    table = WordTable(lambda ws: np.array([[len(w)] for w in ws], float), limit=3)
    for _ in range(3):
        rows, sizes = table.rows_of(["aa b", None, "", "ccc aa"])
        assert sizes.tolist() == [2, 0, 0, 2]
        assert sums(table.rows[rows], sizes).ravel().tolist() == [3, 0, 0, 5]
        table.rows_of(["d e f g"])


def test_isotonic_curve_rises_and_matches_means():
    rng = np.random.default_rng(1)
    m = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-2 * m))).astype(float)
    at, value = toxicity.fit_isotonic(m, y)
    assert (np.diff(value) >= 0).all() and (np.diff(at) >= 0).all() and 0 < value[0] and value[-1] < 1
    assert abs(np.interp(m, at, value).mean() - y.mean()) < 0.02


def test_hidden_words():
    assert toxicity.plain("(Moron!!") == "moron" and toxicity.revealed("m0r0n!") == "moron"
    assert toxicity.revealed("i.d.i.o.t") == "idiot" and toxicity.revealed("looooser") == "loser"


def test_term_counts_count_every_text_and_copies_once(spark):
    common = "w226169"         # crc32 19772: the least of each text, though none is a copy of another
    rows = [(i, f"{common} own{i} word{i}" + (" rude" if i % 2 == 0 else ""), int(i % 2 == 0)) for i in range(40)]
    rows += [(100 + i, rows[0][1], 1) for i in range(5)] + [(200, rows[0][1], 0), (201, None, 1), (202, "", 1)]
    counts, docs = toxicity.term_counts(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    assert docs.sum(0).tolist() == [21, 21]         # 20 texts and the empty one; 20 texts and the copy with the other label
    assert (docs.sum(1) > 0).all()
    assert counts["rude"].sum(0).tolist() == [20, 1]


def test_copies_share_a_fold(spark):
    rows = spark.createDataFrame([(i, f"text {i % 7}") for i in range(70)] + [(99, None), (98, "")], "doc_id long, text string")
    folds = rows.select(F.coalesce("text", F.lit("")).alias("t"), toxicity._fold(F.col("text")).alias("f")).distinct().collect()
    assert len(folds) == 8
