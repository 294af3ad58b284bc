"""Text preparation: strip, tokens, shuffle, encode, batches, padding."""

from collections import Counter
from hashlib import md5

import numpy as np
from pyspark.sql import functions as F

from cvframe.functions.permute import permuted_positions
from cvframe.functions.text import strip_text, tokenize
from cvframe.operators import text as T


def test_strip_unicode_whitespace(spark):
    s = " \t  hello world  \x0b\x1c"
    only_ws = "\t  　 "
    df = spark.createDataFrame([(s,), ("\t ",), (only_ws,), (" x ",), (None,)], "t string")
    got = [r[0] for r in df.select(strip_text(F.col("t"))).collect()]
    assert got == [s.strip(), "", only_ws.strip(), "x", None]


def test_arg_issue_null_in_null_out(spark):
    from cvframe.sources.corpus_io import null_text_rows, with_arg_issue

    df = spark.createDataFrame([(1, None, "t"), (2, "i", "t")], "post_id long, issue string, post_text string")
    out = with_arg_issue(df)
    assert {r["post_id"]: r["arg_issue"] for r in out.collect()} == {1: None, 2: "i t"}
    assert null_text_rows(out).first()["null_rows"] == 1


def test_tokenize_words_and_punctuation(spark):
    df = spark.createDataFrame([("Hello, wörld_1! it's 3.5",)], "t string")
    got = df.select(tokenize(F.col("t"))).first()[0]
    assert got == ["Hello", ",", "wörld_1", "!", "it", "'", "s", "3", ".", "5"]


def test_shuffle_preserves_token_multiset_and_is_deterministic(spark):
    rows = [(i, "a b c d e f g h . , ; x y z " * (i + 1)) for i in range(20)]
    df = spark.createDataFrame(rows, "post_id long, t string")
    a = T.shuffle_text(df, "t", 42, out="s").collect()
    b = T.shuffle_text(df, "t", 42, out="s").collect()
    c = T.shuffle_text(df, "t", 43, out="s").collect()
    assert [r["s"] for r in a] == [r["s"] for r in b]
    assert any(x["s"] != y["s"] for x, y in zip(a, c))
    for r in a:
        assert Counter(r["s"].split(" ")) == Counter(r["t"].split())


def test_encode_unknown_and_empty(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a", "zz"]), (2, []), (3, ["b", "b", "a"])],
                               "post_id long, tokens array<string>")
    vocab = T.build_vocab(df, size=2)
    v = {r["token"]: r["id"] for r in vocab.collect()}
    assert v == {"a": 2, "b": 3}
    enc = {r["post_id"]: r["ids"] for r in T.encode(df, vocab).collect()}
    assert enc[1] == [2, 3, 2, 1] and enc[2] == [] and enc[3] == [3, 3, 2]


def test_encode_keeps_rows_apart_and_both_ways_agree(spark):
    rows = [(1, ["a", "b"]), (1, ["c"]), (2, None), (None, ["a", None, "c"]), (3, []), (4, ["a"] * 3000 + ["b"]), (1, ["c"])]
    df = spark.createDataFrame(rows, "post_id long, tokens array<string>")
    vocab = spark.createDataFrame([("a", 2), ("b", 3)], "token string, id int")
    want = sorted([(1, [2, 3]), (1, [1]), (2, []), (None, [2, 1, 1]), (3, []), (4, [2] * 3000 + [3]), (1, [1])], key=str)
    assert sorted(map(tuple, T.encode(df, vocab).collect()), key=str) == want
    assert sorted(map(tuple, T.encode(df, vocab, dictionary_tokens=1).collect()), key=str) == want
    assert T.encode(df.where("false"), vocab).collect() == [] == T.encode_joined(df.where("false"), vocab).collect()
    assert sorted(map(tuple, T.encode(df, vocab.where("false")).collect()), key=str) == sorted(
        [(i, [1] * len(t or [])) for i, t in rows], key=str)


def test_only_tokens_beyond_the_dictionary_are_joined(spark):
    words = [f"w{i}" for i in range(50)]
    rows = [(i, [words[(i * j) % 50] for j in range(i)] + ["new", None] * (i % 3)) for i in range(60)] + [(7, None)]
    df = spark.createDataFrame(rows, "post_id long, tokens array<string>")
    vocab = spark.createDataFrame([(w, i + 2) for i, w in enumerate(words)], "token string, id int")
    number = {w: i + 2 for i, w in enumerate(words)}
    want = sorted((i, [number.get(t, 1) for t in tokens or []]) for i, tokens in rows)
    for n in (1, 20, 49):
        joined = T.encode(df, vocab, dictionary_tokens=n)
        assert sorted(map(tuple, joined.collect())) == want
    # what is exploded are the words that were not sent, no row per token
    exploded = [r for f in joined.inputFiles() if "encode-rows" in f for r in spark.read.parquet(f).collect()]
    assert sum(len(r["_rest"]) for r in exploded) == sum(t == "w49" or t == "new" for _, x in rows for t in x or [])
    # ids that many tokens share: all are joined
    same = spark.createDataFrame([(w, 5) for w in words], "token string, id int")
    got = sorted(map(tuple, T.encode(df, same, dictionary_tokens=3).collect()))
    assert got == [(i, [x if x == 1 else 5 for x in ids]) for i, ids in want]


def test_positions_need_little_memory():
    import tracemalloc

    r = np.random.default_rng(6)
    sizes, keys = r.integers(0, 1500, 2000), r.integers(0, 1 << 32, (2000, 4))
    whole = permuted_positions(sizes, keys, at_once=1 << 30)
    for at_once in (1000, 99_991):
        assert (permuted_positions(sizes, keys, at_once) == whole).all()
    tracemalloc.start()
    permuted_positions(sizes, keys)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 * sizes.sum()          # 115 bytes a position when all are worked on together


def test_positions_are_permuted():
    sizes = np.array([0, 1, 2, 3, 4, 5, 16, 17, 0, 257, 5000])
    keys = np.random.default_rng(3).integers(0, 1 << 32, (len(sizes), 4))
    flat = permuted_positions(sizes, keys)
    for a, n in zip(np.cumsum(sizes) - sizes, sizes):
        assert sorted(flat[a:a + n]) == list(range(n))
    # every order of three positions turns up, none much too often
    many = permuted_positions(np.full(6000, 3), np.random.default_rng(4).integers(0, 1 << 32, (6000, 4))).reshape(-1, 3)
    counts = Counter(map(tuple, many.tolist()))
    assert len(counts) == 6 and max(counts.values()) < 1.3 * 1000
    # first positions of long rows are spread evenly
    first = permuted_positions(np.full(2000, 100), np.random.default_rng(5).integers(0, 1 << 32, (2000, 4)))[::100]
    assert len(set(first.tolist())) == 100 and abs(first.mean() - 49.5) < 3


def test_shuffle_of_null_and_empty(spark):
    df = spark.createDataFrame([(1, None), (None, "a b"), (2, ""), (3, " \n")], "post_id long, t string")
    got = {r["post_id"]: r["s"] for r in T.shuffle_text(df, "t", 42, out="s").collect()}
    assert got[1] is None and sorted(got[None]) == [" ", "a", "b"] and got[2] == got[3] == ""


def test_batches_and_padding(spark):
    n = 37  # last batch smaller than 16
    df = spark.createDataFrame([(i, list(range(i % 7 + 1))) for i in range(n)], "post_id long, ids array<int>")
    b = T.make_batches(df.select("post_id")).join(df, "post_id")
    p = T.pad_batches(b).collect()
    sizes = Counter(r["batch_id"] for r in p)
    assert sorted(sizes.values()) == [5, 16, 16]
    by_batch = {}
    for r in p:
        by_batch.setdefault(r["batch_id"], set()).add(len(r["ids"]))
        assert len(r["ids"]) == len(r["attention_mask"])
        assert sum(r["attention_mask"]) == r["post_id"] % 7 + 1
    assert all(len(v) == 1 for v in by_batch.values())  # rectangular per batch
    slots = {(r["batch_id"], r["slot"]) for r in p}
    assert len(slots) == n


def test_truncate_and_pack(spark):
    df = spark.createDataFrame([(1, 1, 0)], "post_id long, a int, b int")
    assert T.pack_labels(df, ["a", "b"]).first()["labels"] == [1.0, 0.0]
    assert T.pack_labels(df, ["a", "b"], "binary").first()["labels"] == 1
    toks = spark.createDataFrame([(list("abcdef"),)], "t array<string>")
    assert toks.select(T.truncate(F.col("t"), 4)).first()[0] == list("abcd")


def test_vocab_top_k_exact_with_ties(spark):
    import random

    rnd = random.Random(4)
    words = [f"w{i:03d}" for i in range(400)]
    rows = [(i, [rnd.choice(words[: rnd.choice([5, 50, 400])]) for _ in range(30)]) for i in range(200)]
    df = spark.createDataFrame(rows, "post_id long, tokens array<string>")
    got = [(r["token"], r["id"]) for r in T.build_vocab(df, size=120).orderBy("id").collect()]
    counts = Counter(t for _, toks in rows for t in toks)
    exp = sorted(counts.items(), key=lambda kv: (-kv[1], md5(f"vocab:{kv[0]}".encode()).hexdigest(), kv[0]))
    assert got == [(t, i + 2) for i, (t, _) in enumerate(exp[:120])]
    whole = [(r["token"], r["id"]) for r in T.build_vocab(df).orderBy("id").collect()]
    assert whole == [(t, i + 2) for i, (t, _) in enumerate(exp)]
