"""Spelling variants: the index, whole results by brute force, edge cases."""

import random
import re
import zlib

import pytest

from cvframe.llm import spelling as S
from cvframe.llm.fm_index import Vocabulary


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts, ratio=10):
    out = {}
    for w, n in counts.items():
        near = [o for o in counts if one_edit(w, o)]
        best = min(near, key=lambda o: (-counts[o], o), default=None)
        out[w] = (best if best is not None and counts[best] >= ratio * n else None, n, len(near))
    rows = []
    for w, (form, n, near) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.append((w, form, root, n, near, counts[form] if form is not None else None))
    return sorted(rows, key=lambda r: r[0])


def counted(docs):
    counts = {}
    low = {i: i + 32 for i in range(65, 91)}
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def rows_of(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


@pytest.mark.parametrize("seed", range(40))
def test_index_finds_each_pair_once(seed):
    r = random.Random(seed)
    letters = "ab" if seed % 3 == 0 else "abcé"

    def some(n, more=""):
        return sorted({"".join(r.choice(letters + more) for _ in range(r.randint(2, 7))) for _ in range(n)})

    words, asked = some(r.randint(1, 60)), some(30, "zÿ")
    asked += words
    index = Vocabulary(words, asked)
    pairs = []
    for first in (True, False):
        who, rank = index.near(asked, first)
        assert all(words[j].startswith(asked[i][:len(asked[i]) // 2]) == first for i, j in zip(who, rank))
        pairs += zip(who.tolist(), rank.tolist())
    assert sorted(pairs) == [(i, j) for i, q in enumerate(asked) for j, w in enumerate(words) if one_edit(q, w)]


def test_empty_index():
    who, rank = Vocabulary([], ["abc"]).near(["abc"], True)
    assert len(who) == len(rank) == 0


@pytest.mark.parametrize("shard_rows", [1 << 15, 40])
def test_whole_result_by_brute_force(spark, shard_rows):
    """40 rows a shard: many shards, and the common halves are hot."""
    r = random.Random(9)
    counts = {}
    for _ in range(120):
        w = r.choice(["straße", "niente", "aaaaaa", "ÿøöžx"]) + "".join(r.choice("abé") for _ in range(r.randint(1, 4)))
        counts[w] = r.choice([2, 3, 30, 31, 400, 5000])
    counts["a"], counts["b"] = 2, 50        # any length
    counts["𝒳abcdefg"], counts["𝒴abcdefg"] = 2, 20
    df = spark.createDataFrame(sorted(counts.items()), "word string, n long")
    got = rows_of(S.group_variants(df, shard_rows=shard_rows))
    assert got == brute(counts)
    assert any(row[1] is not None and row[2] != row[1] for row in got)     # a chain


def test_documents_by_brute_force(spark, make_docs):
    r = random.Random(4)
    base = ["Wonderland", "straßenbahn", "ÉCOLIERS", "internaciónal", "a", "kurz", "seventh"]
    docs = [(i, " ".join(r.choice(base) + r.choice(["", ",", "1", "-", "\n"]) for _ in range(60)), "s") for i in range(120)]
    docs += [(5, docs[5][1], "s"), (500, None, "s"), (501, "", "s"), (None, "Wonderland " * 3, "s"), (502, "x" * 40_000 + " y", "s")]
    docs += [(503, "x" * 40_000, "s"), (504, "×÷×÷×÷×÷ ÀÀÀÀÀÀÀ ÀÀÀÀÀÀÀ àààààààà", "s")]
    got = rows_of(S.variants(make_docs(docs, extra=("word", "n", "run"))))
    assert got == brute(counted([(i, t) for i, t, _ in docs]))
    assert any(row[1] is not None for row in got)


def test_no_words(spark, make_docs):
    assert rows_of(S.variants(make_docs([]))) == []
    assert rows_of(S.variants(make_docs([(1, None, "s"), (2, "once only seven", "s")]))) == []
    df = spark.createDataFrame([(None, 3), ("", 4), ("word", 2), ("word", 5)], "word string, n long")
    assert rows_of(S.group_variants(df)) == [("word", None, "word", 5, 0, None)]


def test_long_chain_of_forms(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(13)]
    got = dict(map(tuple, S.roots(spark.createDataFrame(links, "word string, form string")).collect()))
    assert got == {f"w{i}": "w13" for i in range(13)}
