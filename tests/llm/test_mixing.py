import re
from hashlib import md5
from math import floor

import numpy as np
import pytest

from cvframe.llm import mixing


def brute_targets(sizes):
    """Repeated resharing, as stated: sources by code point, NULL last."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        rest = total - sum(target.values())
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= 3 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    return target


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out, i = [], 0
    for s, n in (("a", 300), ("b", 40), ("é", 25), (None, 10), ("z", 3), ("c", 1)):
        for _ in range(n):
            out.append((i, " ".join(["w"] * int(rng.integers(0, 40))), s))
            i += 1
    out += [(i, None, "a"), (i + 1, "", "b"), (i + 2, "same text here", "a"), (i + 2, "same text here", "a"), (None, "x y", "a")]
    return out


def test_targets_sizes_and_copies(make_docs, rows):
    mixed = mixing.mix(make_docs(rows)).collect()
    assert len(mixed) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in mixed:
        assert r["size"] == len((r["text"] or "").split()) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["size"] * r["copies"]
    for s in sizes:  # within the largest document of the source
        biggest = max(len((t or "").split()) for _, t, q in rows if q == s)
        assert abs(taken[s] - want[s]) <= biggest


def test_copies_follow_the_running_sum(make_docs, rows):
    mixed = mixing.mix(make_docs([r for r in rows if r[0] is not None][:-2])).collect()
    by = {}
    for r in mixed:
        by.setdefault(r["source"], []).append(r)
    for s, own in by.items():
        own.sort(key=lambda r: (-r["size"], md5(f"={r['doc_id']}".encode()).hexdigest(), r["doc_id"]))
        u = int(md5(f"7:{s or ''}".encode()).hexdigest()[:8], 16) / 2**32
        rate = own[0]["target"] / own[0]["source_size"] if own[0]["source_size"] else 0.0
        assert [r["copies"] for r in own] == [floor(rate * (k + 1) + u) - floor(rate * k + u) for k in range(len(own))]


def test_reruns_agree_and_names_may_clash(make_docs, rows):
    docs = make_docs(rows, extra=("size", "Copies", "_mix_src"))
    a, b = mixing.mix(docs), mixing.mix(docs.repartition(7))
    assert a.columns[-4:] == ["size_1", "source_size", "target", "copies_1"]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, a.collect())) == sorted(map(key, b.collect()))
    out = mixing.emit(a, docs.columns, "copies_1")
    assert out.columns == docs.columns and out.count() == sum(r["copies_1"] for r in a.collect())


def test_empty_and_blank(make_docs):
    assert mixing.mix(make_docs([])).collect() == []
    got = mixing.mix(make_docs([(1, None, None), (2, " \t", None)])).collect()
    assert all(r["size"] == 0 and r["target"] == 0 and r["copies"] == 0 for r in got)
