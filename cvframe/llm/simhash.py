"""SimHash near-dedup with pigeonring candidate filtering.

A 64-bit fingerprint is cut into ``SEGMENTS`` = 5 consecutive segments on a
ring.  If two fingerprints differ in at most 4 bits, some segment starts a
chain whose running difference stays within the proportional budget: after
l segments at most floor(4 l / 5) bits, that is 0, 1, 2, 3, 4 (pigeonring
principle).  The first three links of the chain are turned into join keys:
segment i equal; segments i+1 and i+2, each cut into halves, with at most
one difference in the first and two in both.  So either both halves of
segment i+1 are equal, or one of its halves and one half of segment i+2
are.  That is 5 keys of about 26 bits per start, 25 per fingerprint, and any
linked pair shares at least one of them.  Pairs that meet under a key must
pass the whole chain test of that start before the full distance is taken.

Only distinct fingerprints are joined.  Within one key, runs are compared by
spreading from one fingerprint at a time over those not yet reached, so the
links kept form a spanning forest and never all pairs; keys with more than
``RUN_LIMIT`` fingerprints are cut into blocks and dealt out as block pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cvframe.llm.common import fresh, quoted, written
from cvframe.llm.components import min_labels

SHINGLE = 4
MAX_BITS = 4
SEED = 42
RUN_LIMIT = 4096      # fingerprints of one key that one task compares at once

#: Bounds of the 5 ring segments and of their halves, from bit 0 up.
SEGMENTS = 5
_WIDTHS = (13, 13, 13, 13, 12)
_STARTS = tuple(int(x) for x in np.cumsum((0,) + _WIDTHS[:-1]))
_MASKS = np.array([((1 << w) - 1) << s for w, s in zip(_WIDTHS, _STARTS)], dtype=np.uint64)


def _halves(i: int) -> tuple[int, int]:
    w, s = _WIDTHS[i], _STARTS[i]
    low = w // 2
    return ((1 << low) - 1) << s, ((1 << (w - low)) - 1) << (s + low)


def _key_masks() -> list[tuple[int, int]]:
    """(start segment, bit mask) of the 25 keys."""
    out = []
    for i in range(SEGMENTS):
        a, b = _halves((i + 1) % SEGMENTS)
        c, d = _halves((i + 2) % SEGMENTS)
        first = int(_MASKS[i])
        out += [(i, first | a | b), (i, first | a | c), (i, first | a | d), (i, first | b | c), (i, first | b | d)]
    return out


KEYS = _key_masks()
KEY_STARTS = np.array([i for i, _ in KEYS])


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of one text (unsigned)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    # shingles are slices of the space-joined words
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(size, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for a in range(0, n, 1 << 16):  # bounded memory for very long texts
        part = hashes[a:a + (1 << 16)]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    values = np.fromiter((fingerprint(t) for t in texts), np.uint64, len(texts))
    return pd.Series(values.view(np.int64))


def fingerprints(text: Column) -> Column:
    """Fingerprint as a signed BIGINT with the same 64 bits (NULL text: 0)."""
    return _fingerprints(text)


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """25 rows (key number, key bits, fp) per fingerprint."""
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for a in range(0, len(fp), 20_000):
            part = fp[a:a + 20_000]
            bits = np.concatenate([part & np.uint64(m) for _, m in KEYS]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(KEYS), dtype=np.int32), len(part))), pa.array(bits),
                 pa.array(np.tile(part, len(KEYS)).view(np.int64))], names=["k", "bits", "fp"])


def _linked(a: np.ndarray, b: np.ndarray, start: np.ndarray | int) -> np.ndarray:
    """Chain test from each pair's start segment, then the full distance."""
    x = a ^ b
    total = np.zeros(x.shape, np.int64)
    good = np.ones(x.shape, bool)
    for step in range(SEGMENTS):
        seg = _MASKS[(np.asarray(start) + step) % SEGMENTS]
        total += np.bitwise_count(x & seg)
        good &= total <= MAX_BITS * (step + 1) // SEGMENTS
    return good & (total <= MAX_BITS)


def _spread(fp: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among the members of one run.

    Pairs that fail the chain of this start pass it from another start, so
    they meet again under that start's key."""
    left = np.arange(len(fp))
    src, dst = [], []
    queue: list[int] = []
    while len(left) or queue:
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
        at = queue.pop()
        if not len(left):
            continue
        hit = _linked(fp[left], fp[at], start)
        if hit.any():
            new = left[hit]
            src.append(np.full(len(new), fp[at]))
            dst.append(fp[new])
            queue += new.tolist()
            left = left[~hit]
    none = np.empty(0, np.uint64)
    return (np.concatenate(src) if src else none), (np.concatenate(dst) if dst else none)


_LINKS = "k int, bits long, a long, b long, hot boolean"
_SMALL = 16


def _runs(frames: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Links from rows (k, bits, fp) sorted by (k, bits, fp).

    Runs longer than ``limit`` are passed on as rows marked hot: they are
    streamed through, never held."""
    def batch(k, bits, a, b, hot):
        return pa.RecordBatch.from_arrays(
            [pa.array(k, pa.int32()), pa.array(bits.view(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)),
             pa.array(np.full(len(k), hot))], names=["k", "bits", "a", "b", "hot"])

    def work(k, bits, fp):
        if not len(k):
            return
        edge = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (bits[1:] != bits[:-1])]))
        size = np.diff(np.concatenate([edge, [len(k)]]))
        run = np.repeat(np.arange(len(edge)), size)
        small = np.repeat((size > 1) & (size <= _SMALL), size)
        for off in range(1, _SMALL):
            if len(k) <= off:
                break
            i = np.flatnonzero(small[:-off] & (run[off:] == run[:-off]))
            if not len(i):
                break
            ok = i[_linked(fp[i], fp[i + off], KEY_STARTS[k[i]])]
            if len(ok):
                yield batch(k[ok], bits[ok], fp[ok], fp[ok + off], False)
        for r in np.flatnonzero(size > _SMALL):
            a, n = edge[r], size[r]
            if n > limit:
                yield batch(k[a:a + n], bits[a:a + n], fp[a:a + n], fp[a:a + n], True)
            else:
                x, y = _spread(fp[a:a + n], int(KEY_STARTS[k[a]]))
                if len(x):
                    yield batch(np.full(len(x), k[a]), np.full(len(x), bits[a]), x, y, False)

    held = None
    passing = None  # the key of a hot run that goes on in the next batch
    for rb in frames:
        k = rb.column(0).to_numpy(zero_copy_only=False)
        bits = rb.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        fp = rb.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
        if passing is not None and len(k):
            same = (k == passing[0]) & (bits == passing[1])
            n = len(k) if same.all() else int(np.argmin(same))
            if n:
                yield batch(k[:n], bits[:n], fp[:n], fp[:n], True)
                k, bits, fp = k[n:], bits[n:], fp[n:]
            if len(k):
                passing = None
        if held is not None:
            k, bits, fp = (np.concatenate([x, y]) for x, y in zip(held, (k, bits, fp)))
            held = None
        if not len(k):
            continue
        cut = len(k)  # hold back the last run: it may go on
        while cut and k[cut - 1] == k[-1] and bits[cut - 1] == bits[-1]:
            cut -= 1
        yield from work(k[:cut], bits[:cut], fp[:cut])
        held = (k[cut:], bits[cut:], fp[cut:])
        if len(held[0]) > limit:
            yield batch(*held, held[2], True)
            passing = (held[0][0], held[1][0])
            held = None
    if held is not None:
        yield from work(*held)


def links(prints: DataFrame, limit: int = RUN_LIMIT) -> DataFrame:
    """(a, b) links that connect all distinct fingerprints within MAX_BITS.

    ``prints`` has one BIGINT column of distinct fingerprints.  The links
    connect exactly what the graph of all pairs within the distance would."""
    keys = prints.mapInArrow(_key_rows, "k int, bits long, fp long")
    # the hash keeps all rows of a key in one task, in order
    keys = keys.repartition("k", "bits").sortWithinPartitions("k", "bits", "fp")
    found = written(keys.mapInArrow(lambda it: _runs(it, limit), _LINKS), "simhash-links")
    cold = found.where(~F.col("hot")).select("a", "b")
    hot = found.where("hot").select("k", "bits", F.col("a").alias("fp"))
    # block pairs of hot keys: each pair of members meets in one task of at most 2 blocks
    sizes = hot.groupBy("k", "bits").agg(F.ceil(F.count(F.lit(1)) * 2 / F.lit(limit)).cast("int").alias("nb"))
    dealt = hot.join(sizes, ["k", "bits"]).withColumn("blk", F.expr("pmod(xxhash64(fp), nb)").cast("int"))
    dealt = dealt.select("k", "bits", "fp", "blk", F.explode(F.expr("sequence(0, nb - 1)")).alias("other"))
    dealt = dealt.select("k", "bits", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"), "fp")
    dealt = dealt.repartition("k", "bits", "lo", "hi").sortWithinPartitions("k", "bits", "lo", "hi", "fp")
    pairs = dealt.mapInArrow(_block_runs, "a long, b long")
    return cold.unionByName(pairs)


def _block_runs(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each run of rows sorted by (k, bits, lo, hi)."""
    held: list[np.ndarray] = []
    key = None

    def flush():
        x, y = _spread(np.concatenate(held), int(KEY_STARTS[key[0]]))
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

    for rb in frames:
        cols = [rb.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        if not len(cols[0]):
            continue
        change = np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)
        edges = np.concatenate([[0], np.flatnonzero(change) + 1, [len(cols[0])]])
        for a, b in zip(edges[:-1], edges[1:]):
            own = tuple(int(c[a]) for c in cols[:4])
            if key is not None and own != key:
                yield flush()
                held = []
            key = own
            held.append(cols[4][a:b].view(np.uint64))
    if key is not None:
        yield flush()


def _components(docs: DataFrame, id_col: str, text_col: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, label, component_id) per row, one label per component;
    and the written (doc_id, fp) of the rows."""
    prints = written(docs.select(quoted(id_col).alias("doc_id"), fingerprints(quoted(text_col)).alias("fp")), "simhash-prints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-distinct")
    labels = min_labels(links(distinct.select("fp"), limit))          # only fingerprints that have a link
    named = distinct.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left")
    named = named.select("fp", "least_id", F.coalesce("label", "fp").alias("label"))
    # written, so that the join below deals both sides anew and a component of very many fingerprints can be split
    ids = written(named.groupBy("label").agg(F.min("least_id").alias("component_id")), "simhash-ids")
    by_fp = written(named.join(ids, "label").select("fp", "label", "component_id"), "simhash-components")
    return prints.join(by_fp, "fp").select("doc_id", "fp", "label", "component_id"), prints


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    limit: int = RUN_LIMIT) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    NULL, empty and blank texts have fingerprint zero and link like any
    other.  Exact copies and ties share a fingerprint and so a component;
    repeated rows stay separate rows of the result.  ``component_id`` is the
    smallest id reachable (NULL ids are ignored by the minimum; a component
    with no other id has NULL).  Other columns of ``docs`` are not read; an
    empty table gives an empty result."""
    return _components(docs, id_col, text_col, limit)[0].select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = RUN_LIMIT) -> DataFrame:
    """One row of ``docs`` per component, with all its columns.

    It is the row with the smallest id (NULL ids last; among rows that share
    that id the smallest fingerprint, then the smallest row in column order)."""
    names = {c: fresh(docs, f"_keep_{c}") for c in ("id", "fp", "row", "other")}
    own_id, own_fp = quoted(names["id"]), quoted(names["fp"])
    rows_of, prints = _components(docs, id_col, text_col, limit)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp"))
    kept = rows_of.groupBy("label").agg(first.alias("first")).select(
        F.col("first.doc_id").alias(names["id"]), F.col("first.fp").alias(names["fp"]))
    kept = written(kept, "simhash-kept")
    # an id of one row says which row it is; only rows that share theirs are told apart by their texts
    shared = written(prints.groupBy(F.col("doc_id").alias(names["id"])).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(own_id),
                     "simhash-shared")
    alone = docs.join(kept.join(shared.withColumnRenamed(names["id"], "other"), own_id.eqNullSafe(F.col("other")), "left_anti"),
                      quoted(id_col).eqNullSafe(own_id), "left_semi")
    rows = docs.join(shared, quoted(id_col).eqNullSafe(own_id), "left_semi")
    rows = rows.withColumn(names["fp"], fingerprints(quoted(text_col)))
    theirs = kept.select(own_id, own_fp.alias(names["other"]))
    rows = rows.join(theirs, quoted(id_col).eqNullSafe(own_id) & (own_fp == quoted(names["other"])), "left_semi")
    row = F.struct(*[quoted(c) for c in docs.columns])
    one = rows.groupBy(quoted(id_col), own_fp).agg(F.min(row).alias(names["row"]))
    return alone.unionByName(one.select(*[quoted(names["row"]).getField(c).alias(c) for c in docs.columns]))
