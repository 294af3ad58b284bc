import random

import numpy as np
import xxhash

from cvframe.llm import simhash
from cvframe.llm.components import min_labels


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, bits=4):
    fps, n = np.array(fps, np.uint64), len(fps)
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(n):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1:] ^ fps[i]) <= bits) + i + 1:
            a, b = find(i), find(int(j))
            label[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_every_linked_pair_shares_a_key_and_passes_its_chain():
    rng = random.Random(5)
    masks = np.array([m for _, m in simhash.KEYS], np.uint64)
    for _ in range(20_000):
        a = rng.getrandbits(64)
        x = 0
        for b in rng.sample(range(64), rng.randrange(0, 5)):
            x |= 1 << b
        met = np.flatnonzero((masks & np.uint64(x)) == 0)
        pair = np.full(len(met), a, np.uint64)
        assert simhash._linked(pair, pair ^ np.uint64(x), simhash.KEY_STARTS[met]).any()


def test_fingerprints(spark, make_docs):
    texts = [None, "", " \n\t ", "One", "one TWO\x0bthree", "a b c d e f g a b c d", "É é É x", "w " * 70_000, "a b c d " * 9]
    got = make_docs([(i, t, "s") for i, t in enumerate(texts)]).select("doc_id", simhash.hex16(simhash.fingerprints("text")).alias("h"))
    assert {r["doc_id"]: r["h"] for r in got.collect()} == {i: f"{brute_fingerprint(t):016x}" for i, t in enumerate(texts)}


def planted(seed, groups, loose):
    rng = random.Random(seed)
    out = set()
    for n in groups:
        at = rng.getrandbits(64)
        for _ in range(n):       # a walk: neighbours are close, ends may be far apart
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                at ^= 1 << b
            out.add(at)
    centre = rng.getrandbits(64)
    for _ in range(loose):       # a ball: very many fingerprints under the same keys
        out.add(centre ^ sum(1 << b for b in rng.sample(range(64), 3)))
    out |= {rng.getrandbits(64) for _ in range(200)}
    return sorted(out)


def test_links_connect_what_all_pairs_would(spark):
    fps = planted(1, [2, 3, 40, 7], 300)
    want = brute_components(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    for limit in (20, 4096):     # 20: hot keys go through block pairs
        frame = spark.createDataFrame([(v,) for v in signed], "fp long").repartition(5)
        label = {r["node"]: r["label"] for r in min_labels(simhash.links(frame, limit)).collect()}
        groups, expected = {}, {}
        for v, w in zip(signed, want):
            groups.setdefault(label.get(v, v), set()).add(v)
            expected.setdefault(w, set()).add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(50)] + [(7, 7), (5, 4), (5, 4), (-3, 2000)]
    got = {r["node"]: r["label"] for r in min_labels(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and all(got[1000 + i] == 1000 for i in range(1, 50)) and got[2000] == -3
    assert min_labels(spark.createDataFrame([], "a long, b long")).collect() == []


def rows():
    base = " ".join(f"w{i}" for i in range(400))
    near = base.replace("w200 ", "W200x ")
    return [(5, base, "a"), (3, base.upper(), "a"), (9, near, "b"), (4, None, "a"), (8, "", "b"), (None, " ", "c"), (7, "other words here now", "a"),
            (7, "other words here now", "a"), (None, "no id at all", "a"), (None, "no id at all", "a"), (None, "a second text without id", None)]


def test_near_duplicates(make_docs):
    got = make_docs(rows(), extra=("fp", "component_id", "label"))
    got = [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(got).collect()]
    fps = [brute_fingerprint(t) for _, t, _ in rows()]
    comp = brute_components(fps)
    want = []
    for (i, _, _), c in zip(rows(), comp):
        ids = [r[0] for r, d in zip(rows(), comp) if d == c and r[0] is not None]
        want.append((i, min(ids) if ids else None))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(make_docs([])).collect() == []


def test_keep_one(make_docs):
    docs = make_docs(rows(), extra=("fp", "label"))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    comp = brute_components([brute_fingerprint(t) for _, t, _ in rows()])
    assert len(got) == len(set(comp))
    assert sorted((r["doc_id"] for r in got if r["doc_id"] is not None)) == [3, 4, 7]
    assert {r["text"] for r in got if r["doc_id"] is None} == {"no id at all", "a second text without id"}
    assert simhash.keep_one(make_docs([])).collect() == []
