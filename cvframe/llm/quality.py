"""Quality classifier: random-indexing word vectors, pooled, then a small network.

Every word falls into one of ``BUCKETS`` buckets, and each bucket has a
sparse random index vector.  One pass over all documents adds, for each
word, the index vectors of its neighbours to the word's bucket: these sums
are the word vectors.  A document is the mean, the spread and the mean
neighbour product of its words' vectors.  A two-layer network in numpy is
fitted to labelled documents and its logits are divided by a temperature
fitted on documents it has not seen.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cvframe.llm.common import fresh, id_remainder, quoted
from cvframe.llm.words import WordTable, labelled, text_slices

BUCKETS = 1 << 14
DIM = 64
NONZERO = 4            # nonzero entries of an index vector
REACH = 2              # neighbours on each side
CHUNK = 256            # buckets summed by one row of the reduction
HIDDEN = 32
POOL_WORDS = 4096      # words whose vectors are looked up at once
MAX_LABELLED = 20_000  # labelled documents the network is fitted on, at most
SPARE = 0.2            # share of them kept for the temperature
THRESHOLD = 0.7
SEED = 11
HELD_MOD, HELD_REST = 4, 2

_PLAIN = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*[.,;:!?]?")
_LETTERS = re.compile(r"[^\W_]+")


def word_form(word: str) -> str:
    """What two words must share to share a vector: plain words their lower
    case letters; words with other characters only these, in order."""
    if _PLAIN.fullmatch(word):
        return word.rstrip(".,;:!?").lower()
    return "\x00" + _LETTERS.sub("a", word)


def _bucket(words: list[str]) -> np.ndarray:
    crc = zlib.crc32
    return np.fromiter((crc(word_form(w).encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for w in words), np.int64, len(words))


_WORDS: list[WordTable] = []


def _buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    if not _WORDS:
        _WORDS.append(WordTable(_bucket))
    rows, sizes = _WORDS[0].rows_of(texts)
    return (_WORDS[0].rows[rows] if len(rows) else rows), sizes


def index_vectors(seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries, (bucket, NONZERO)."""
    rng = np.random.default_rng(seed)
    place = np.argsort(rng.random((BUCKETS, DIM), dtype=np.float32), axis=1)[:, :NONZERO]
    return place.astype(np.int64), rng.integers(0, 2, (BUCKETS, NONZERO)).astype(np.float64) * 2 - 1


def context_sums(docs: DataFrame, text_col: str = "text", seed: int = SEED) -> np.ndarray:
    """(BUCKETS, DIM) sums over all documents.

    Tasks add up their part in one matrix; its chunks meet in a streamed
    sum per chunk.  What reaches the driver is BUCKETS x DIM numbers (8 MB),
    whatever the size of the corpus."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors(seed)
        total = np.zeros(BUCKETS * DIM)
        for batch in batches:
            for piece in text_slices(batch, 0):
                words, sizes = _buckets(piece.column(0).to_pylist())
                doc = np.repeat(np.arange(len(sizes)), sizes)
                for off in range(1, REACH + 1):
                    if len(words) <= off:
                        break
                    near = doc[off:] == doc[:-off]
                    a, b = words[:-off][near], words[off:][near]
                    for x, y in ((a, b), (b, a)):
                        at = x[:, None] * DIM + place[y]
                        total += np.bincount(at.ravel(), sign[y].ravel(), BUCKETS * DIM)
        grid = total.astype(np.int64).reshape(-1, CHUNK * DIM)
        own = np.flatnonzero(grid.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(own, pa.int32()), pa.array([grid[i].tobytes() for i in own], pa.binary())], names=["chunk", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = np.frombuffer(raw.as_buffer(), np.int64)
                found[chunk] = found[chunk] + got if chunk in found else got.copy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], names=["chunk", "sums"])

    schema = "chunk int, sums binary"
    parts = docs.select(quoted(text_col).alias("text")).mapInArrow(part, schema)
    # a first round in groups of chunk and origin keeps the number of partial sums per task small at any size
    parts = parts.withColumn("origin", F.spark_partition_id() % 32).repartition("chunk", "origin").select("chunk", "sums")
    rows = parts.mapInArrow(add, schema).repartition("chunk").mapInArrow(add, schema).collect()
    out = np.zeros((BUCKETS // CHUNK, CHUNK * DIM))
    for r in rows:
        out[r["chunk"]] += np.frombuffer(bytes(r["sums"]), np.int64)
    return out.reshape(BUCKETS, DIM)


def word_vectors(context: np.ndarray) -> np.ndarray:
    """Unit vectors around the mean direction; buckets without context: zero."""
    norm = np.sqrt((context * context).sum(1, keepdims=True))
    unit = np.divide(context, norm, out=np.zeros_like(context), where=norm > 0)
    some = norm[:, 0] > 0
    if some.any():
        weight = np.sqrt(norm[some])
        unit[some] -= (unit[some] * weight).sum(0) / weight.sum()
    norm = np.sqrt((unit * unit).sum(1, keepdims=True))
    return np.divide(unit, norm, out=np.zeros_like(unit), where=norm > 0).astype(np.float32)


def pooled(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """(texts, 3 DIM): mean, spread and mean neighbour product; empty: zeros.

    Vectors are looked up for ``POOL_WORDS`` words at a time, so a task's
    memory does not grow with its texts, however long one is."""
    words, sizes = _buckets(texts)
    total = np.zeros((len(sizes), 3, DIM))
    start = 0
    for t, size in enumerate(sizes.tolist()):
        for a in range(0, size, POOL_WORDS):
            n = min(POOL_WORDS, size - a)
            v = vectors.take(words[start + a:start + min(a + n + 1, size)], axis=0)     # and the word after the last one
            own = v[:n]
            total[t, 0] += own.sum(0)
            total[t, 1] += np.einsum("ij,ij->j", own, own)
            total[t, 2] += np.einsum("ij,ij->j", v[:-1], v[1:])
        start += size
    n = np.maximum(sizes, 1)[:, None]
    mean = total[:, 0] / n
    spread = np.sqrt(np.maximum(0, total[:, 1] / n - mean * mean))
    return np.hstack([mean, spread, total[:, 2] / np.maximum(sizes - 1, 1)[:, None]])


@dataclass
class Network:
    """standardise -> tanh layer -> logit / temperature -> probability."""

    vectors: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        # row by row, so that a score does not depend on the rows beside it
        z = (x - self.shift) / self.scale
        hidden = np.array([row @ self.w1 for row in z]).reshape(len(z), -1)
        return (np.tanh(hidden + self.b1) * self.w2).sum(1) + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, hidden: int = HIDDEN, epochs: int = 60, seed: int = SEED) -> Network:
    """Adam on the log loss; the temperature on a spare share of the rows."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    spare, own = np.split(order, [int(SPARE * len(x))])
    if len(set(y[own])) < 2:                 # nothing to tell apart: a smoothed constant
        p = (y.sum() + 1) / (len(y) + 2)
        d = x.shape[1]
        return Network(vectors, np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))
    shift, scale = x[own].mean(0), x[own].std(0) + 1e-6
    net = Network(vectors, shift, scale, rng.standard_normal((x.shape[1], hidden)) / np.sqrt(x.shape[1]), np.zeros(hidden),
                  rng.standard_normal(hidden) / np.sqrt(hidden), 0.0)
    z = (x - shift) / scale
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        rng.shuffle(own)
        for a in range(0, len(own), 256):
            rows = own[a:a + 256]
            h = np.tanh(z[rows] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40)))
            d = (p - y[rows]) / len(rows)
            back = d[:, None] * params[2] * (1 - h * h)
            grads = [z[rows].T @ back + 1e-4 * params[0], back.sum(0), h.T @ d + 1e-4 * params[2], d.sum(keepdims=True)]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                s[i] = 0.999 * s[i] + 0.001 * g * g
                params[i] = params[i] - 0.003 * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(s[i] / (1 - 0.999 ** step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if len(spare):
        logit, target = net.logits(x[spare]), y[spare]
        choices = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = [np.mean(np.logaddexp(0, np.where(target == 1, -logit, logit) / t)) for t in choices]
        net.temperature = float(choices[int(np.argmin(loss))])
    return net


def fit(docs: DataFrame, sf_dir: str, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_LABELLED) -> Network:
    """Word vectors from all documents, network from labelled ones outside
    the held-out remainder.  Without labels every score is one half."""
    vectors = word_vectors(context_sums(docs, text_col))
    shared = docs.sparkSession.sparkContext.broadcast(vectors)    # 4 MB

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch, 1):
                x = pooled(piece.column(1).to_pylist(), shared.value).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "x"])

    rows = labelled(docs, sf_dir, "quality", HELD_MOD, HELD_REST, limit, id_col, text_col)
    got = rows.mapInArrow(features, "doc_id long, label int, x binary").collect()     # limit x 192 floats at most
    got.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    x = np.array([np.frombuffer(bytes(r["x"]), np.float32) for r in got], np.float64).reshape(len(got), 3 * DIM)
    return fit_network(x, np.array([r["label"] for r in got], np.float64), vectors)


def score(docs: DataFrame, model: Network, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` and a last column with the probability of label 1.

    Scores depend on the text alone: equal texts score the same, NULL counts
    as empty, empty texts have the score of the zero vector, very long texts
    are pooled whole, and all columns pass through (a taken name gets a
    suffix)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(fresh(docs, name), T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch, at):
                p = shared.value.probability(pooled(piece.column(at).to_pylist(), shared.value.vectors))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(p)], names=schema.names)

    return docs.mapInArrow(work, schema)


def classify(docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    scored = score(docs.select("doc_id", "text"), fit(docs, sf_dir))
    return scored.select("doc_id", (id_remainder(F.col("doc_id"), HELD_MOD) == HELD_REST).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
