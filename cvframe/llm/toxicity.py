"""Toxicity classifier: gradient-boosted trees over dense features.

A lexicon of words and word beginnings that are far commoner in toxic
documents is learned from the labelled ones, in folds: each document's
features use a lexicon learned from the other folds, so the trees see what
unknown documents will look like.  The dense features are lexicon densities,
how close second-person words stand to lexicon words, capitals, punctuation
and obfuscation rates.  Boosted trees are fitted to most documents and an
isotonic curve, fitted on the rest, turns their sums into probabilities.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cvframe.llm.common import fresh, id_remainder, written
from cvframe.llm.words import WordTable, labelled, sums, text_slices

MAX_LABELLED = 20_000   # labelled documents the model is fitted on, at most
MAX_LEXICON = 8_000     # entries of the lexicon, at most
PREFIXES = range(3, 9)  # letters of word beginnings
MIN_DOCS = 3            # toxic documents an entry occurs in, at least
MIN_ODDS, MIN_SURE = 1.1, 3.5   # log odds and deviation an entry needs
STRONG = 2.5            # log odds of a strong entry
FOLDS = 4
NEAR = 5                # words between a second-person word and a lexicon word, at most
TREES, DEPTH, RATE, BINS = 80, 3, 0.2, 64
CALIBRATE = 0.3         # share of the documents kept for the isotonic curve
THRESHOLD = 0.7
SEED = 13
HELD_MOD, HELD_REST = 3, 1

SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur du dich dir dein deine deiner deinem deinen ihr euch euer eure tu toi te ton ta "
    "tes vous votre vos usted ustedes tú ti tuyo tuya vosotros os vuestro vuestra".split())
#: Signs and digits that stand for letters.
LEET = str.maketrans("0134578@$!|+€", "oieastbasiite")

_EDGE = re.compile(r"^[^\w@$]+|[^\w@$!]+$")
_INNER = re.compile(r"[^\W\d_][^\w\s'’-]+[^\W\d_]|[^\W\d_]\d+[^\W\d_]|[^\W\d_][@$]|[@$][^\W\d_]|(?:[^\W\d_][.\-_*]){2,}")
_REPEAT = re.compile(r"(.)\1{2,}")
_NOT_LETTER = re.compile(r"[\W\d_]+")


def plain(word: str) -> str:
    """Lower-case word without what stands around it."""
    return _EDGE.sub("", word).rstrip("!").lower()


def revealed(word: str) -> str:
    """The word with stand-in signs, inner signs and stretched letters undone."""
    return _REPEAT.sub(r"\1", _NOT_LETTER.sub("", plain(word).translate(LEET)))


def _terms(word: str) -> list[str]:
    """Lexicon entries a word can hit: itself and its beginnings."""
    w = plain(word)
    return [w, *(w[:k] + "*" for k in PREFIXES if len(w) > k)] if w else []


FEATURES = ["hits", "hit_density", "weight", "weight_density", "strong_hits", "strong_density", "hidden_hits", "near_you",
            "near_you_share", "you_density", "upper_letters", "upper_words", "exclaim", "question", "punctuation", "obfuscated",
            "stretched", "words"]


def _describer(lexicon: dict[str, float]):
    """Per word: weight, hit, (unused), strong hit, hidden hit, you, letters, capitals, all capitals, !, ?, signs, obfuscated, stretched."""

    def describe(words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), 14), np.float32)
        get = lexicon.get
        for i, w in enumerate(words):
            p = plain(w)
            weight = max((get(t, 0.0) for t in _terms(w)), default=0.0) if lexicon else 0.0
            odd = not w.isalpha()
            obfuscated = bool(odd and _INNER.search(w))
            stretched = bool(_REPEAT.search(p))
            hidden = 0.0
            if not weight and (obfuscated or stretched):
                hidden = float(get(revealed(w), 0.0) > 0)
            letters = sum(c.isalpha() for c in w) if odd else len(w)
            upper = 0 if w.islower() else sum(c.isupper() for c in w)
            out[i] = (weight, weight > 0, 0, weight >= STRONG, hidden, p in SECOND_PERSON, letters, upper,
                      letters > 1 and upper == letters, w.count("!"), w.count("?"), len(w) - letters, obfuscated, stretched)
        return out

    return describe


def dense_features(texts: list[str | None], words: WordTable) -> np.ndarray:
    """(texts, FEATURES); an empty text has zeros throughout."""
    rows, sizes = words.rows_of(texts)
    d = words.rows[rows] if len(rows) else np.zeros((0, 14), np.float32)
    total = sums(d, sizes)
    n = np.maximum(sizes, 1)
    text = np.repeat(np.arange(len(sizes)), sizes)
    hit = (d[:, 1] > 0) | (d[:, 4] > 0)
    at_hit, at_you = np.flatnonzero(hit), np.flatnonzero(d[:, 5] > 0)
    near = np.zeros(len(sizes))
    if len(at_hit) and len(at_you):
        right = np.searchsorted(at_you, at_hit)
        close = np.zeros(len(at_hit), bool)
        for side in (np.maximum(right - 1, 0), np.minimum(right, len(at_you) - 1)):
            other = at_you[side]
            close |= (np.abs(other - at_hit) <= NEAR) & (text[other] == text[at_hit])
        near = np.bincount(text[at_hit[close]], minlength=len(sizes)).astype(np.float64)
    hits = np.bincount(text[at_hit], minlength=len(sizes))
    letters = np.maximum(total[:, 6], 1)
    return np.column_stack([
        np.log1p(total[:, 1]), total[:, 1] / n, np.log1p(total[:, 0]), total[:, 0] / n, np.log1p(total[:, 3]), total[:, 3] / n,
        np.log1p(total[:, 4]), near, near / np.maximum(hits, 1), total[:, 5] / n, total[:, 7] / letters, total[:, 8] / n,
        total[:, 9] / n, total[:, 10] / n, total[:, 11] / letters, total[:, 12] / n, total[:, 13] / n, np.log1p(sizes)])


def _fold(text) -> Column:
    """Copies of a text share a fold, so none teaches the lexicon of another."""
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(FOLDS)).cast("int")


def term_counts(rows: DataFrame, limit: int = MAX_LEXICON, least: int = MIN_DOCS) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(entry -> documents per fold and kind, documents per fold and kind);
    kinds are toxic and other.

    Rows with the same whole text (by its SHA-256; NULL counts as empty) and
    label count once, so copies of a toxic document do not turn its words
    into entries; every other row counts.  Counts are added up per batch and
    shuffled by entry; the ``limit`` entries that deviate most reach the
    driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch, 0):
                found: dict[tuple[int, int], Counter] = {}
                for text, label, fold in zip(*(piece.column(i).to_pylist() for i in range(3))):
                    kind = found.setdefault((fold, int(label != 1)), Counter())
                    kind.update({t for w in set((text or "").split()) for t in _terms(w)})
                for (fold, kind), n in found.items():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()),
                         pa.array(np.full(len(n), 2 * fold + kind, np.int32))], names=["term", "n", "cell"])

    rows = rows.select(F.coalesce("text", F.lit("")).alias("text"), "label")
    rows = rows.groupBy(F.sha2("text", 256).alias("sig"), "label").agg(F.min("text").alias("text"))
    rows = written(rows.select("text", "label", _fold(F.col("text")).alias("fold")), "toxicity-rows")
    docs = np.zeros((FOLDS, 2))
    for r in rows.groupBy("fold", (F.col("label") != 1).cast("int").alias("kind")).count().collect():
        docs[r["fold"], r["kind"]] = r["count"]
    toxic, other = docs.sum(0)
    if not toxic or not other:
        return {}, docs
    cells = [F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).alias(f"c{c}") for c in range(2 * FOLDS)]
    counts = rows.mapInArrow(count, "term string, n long, cell int").groupBy("term").agg(*cells)
    hits = [sum((F.col(f"c{2 * f + kind}") for f in range(1, FOLDS)), F.col(f"c{kind}")) for kind in (0, 1)]
    sure = (hits[0] / F.lit(float(toxic)) - hits[1] / F.lit(float(other))) / F.sqrt(
        (hits[0] + hits[1]) * F.lit(1.0 / (toxic * other)))
    kept = counts.where(hits[0] >= least).withColumn("sure", sure).where(F.col("sure") >= MIN_SURE / 2)
    kept = kept.orderBy(F.col("sure").desc(), "term").limit(limit).collect()
    return {r["term"]: np.array([r[f"c{c}"] for c in range(2 * FOLDS)], np.float64).reshape(FOLDS, 2) for r in kept}, docs


def lexicon_of(counts: dict[str, np.ndarray], docs: np.ndarray, without: int = -1, least: int = MIN_DOCS) -> dict[str, float]:
    """Entry -> log odds, from all folds but ``without``."""
    own = np.arange(FOLDS) != without
    toxic, other = docs[own].sum(0)
    out = {}
    if toxic and other:
        for term, n in counts.items():
            a, b = n[own].sum(0)
            odds = np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (other + 1))
            sure = (a / toxic - b / other) / np.sqrt((a + b) / (toxic * other)) if a + b else 0.0
            if a >= least and odds >= MIN_ODDS and sure >= MIN_SURE:
                out[term] = float(odds)
    return out


@dataclass
class BoostedTrees:
    """Regression trees on the log loss, all of depth ``DEPTH``, with binned splits."""

    base: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    split: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        row = np.arange(len(x))
        for f, s, v in zip(self.feature, self.split, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[row, f[node]] > s[node])
            out += v[node - (2 ** DEPTH - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = RATE) -> BoostedTrees:
    p = (y.sum() + 1) / (len(y) + 2)
    model = BoostedTrees(float(np.log(p / (1 - p))))
    if not len(y) or len(set(y)) < 2:
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    margin = np.full(len(y), model.base)
    inner = 2 ** DEPTH - 1
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        g, h = y - prob, np.maximum(prob * (1 - prob), 1e-6)
        feature, split = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            for k in range(2 ** depth - 1, 2 ** (depth + 1) - 1):
                own = np.flatnonzero(node == k)
                if len(own) >= 10:
                    best, total_g, total_h = 1e-3, g[own].sum(), h[own].sum()
                    for j, e in enumerate(edges):
                        if not len(e):
                            continue
                        gs = np.cumsum(np.bincount(bins[own, j], g[own], len(e) + 1))[:-1]
                        hs = np.cumsum(np.bincount(bins[own, j], h[own], len(e) + 1))[:-1]
                        gain = gs ** 2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g ** 2 / (total_h + 1)
                        gain[(hs < 1e-3) | (total_h - hs < 1e-3)] = 0
                        b = int(np.argmax(gain))
                        if gain[b] > best:
                            best, feature[k], split[k] = gain[b], j, e[b]
                right = x[own, feature[k]] > split[k]
                node[own] = 2 * k + 1 + right
        at = node - inner
        leaf = rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + 1)
        margin += leaf[at]
        model.feature.append(feature)
        model.split.append(split)
        model.leaf.append(leaf)
    return model


def fit_isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising curve (margins, probabilities) by pooling adjacent violators.

    Each end has one pseudo-document of either label, so no probability is 0 or 1."""
    if not len(y):
        return np.array([-30.0, 30.0]), np.array([1e-9, 1 - 1e-9])
    order = np.argsort(margin, kind="stable")
    m = np.concatenate([[margin.min()], margin[order], [margin.max()]])
    t = np.concatenate([[0.5], y[order], [0.5]])
    blocks: list[list[float]] = []       # label sum, count, first margin, last margin
    for a, b in zip(m, t):
        blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, last = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = last
    at = np.array([v for b in blocks for v in (b[2], b[3])])
    value = np.array([v for b in blocks for v in (b[0] / b[1],) * 2])
    return at, value


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: BoostedTrees
    curve: tuple[np.ndarray, np.ndarray]

    def words(self) -> WordTable:
        return WordTable(_describer(self.lexicon))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.trees.margin(x), *self.curve), 0.0, 1.0)


def fit(docs: DataFrame, sf_dir: str, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_LABELLED) -> ToxicityModel:
    """Lexicon, trees and curve from labelled documents outside the held-out
    remainder.  Without labels of both kinds every score is the base rate."""
    rows = labelled(docs, sf_dir, "toxic", HELD_MOD, HELD_REST, limit, id_col, text_col)
    counts, per_fold = term_counts(rows)
    lexicons = [lexicon_of(counts, per_fold, f) for f in range(FOLDS)]      # MAX_LEXICON entries each at most

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [WordTable(_describer(x)) for x in lexicons]
        for batch in batches:
            for piece in text_slices(batch, 1):
                texts, folds = piece.column(1).to_pylist(), np.asarray(piece.column(3))
                x = np.zeros((len(texts), len(FEATURES)))
                for f in np.unique(folds):
                    own = np.flatnonzero(folds == f)
                    x[own] = dense_features([texts[i] for i in own], words[f])
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "x"])

    rows = rows.withColumn("fold", _fold(F.col("text")))
    got = rows.mapInArrow(features, "doc_id long, label int, x binary").collect()   # limit x 18 numbers
    got.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    x = np.array([np.frombuffer(bytes(r["x"])) for r in got]).reshape(len(got), len(FEATURES))
    y = np.array([float(r["label"] == 1) for r in got])
    order = np.random.default_rng(SEED).permutation(len(y))
    spare, own = np.split(order, [int(CALIBRATE * len(y))])
    trees = fit_trees(x[own], y[own])
    return ToxicityModel(lexicon_of(counts, per_fold), trees, fit_isotonic(trees.margin(x[spare]) if len(spare) else np.empty(0), y[spare]))


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` and a last column with the probability of label 1.

    Scores depend on the text alone: equal texts score the same, NULL counts
    as empty, an empty text has the score of zero features, very long texts
    are read whole, and all columns pass through (a taken name gets a
    suffix)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(fresh(docs, name), T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value.words()
        for batch in batches:
            for piece in text_slices(batch, at):
                p = shared.value.probability(dense_features(piece.column(at).to_pylist(), words))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(p)], names=schema.names)

    return docs.mapInArrow(work, schema)


def classify(docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    scored = score(docs.select("doc_id", "text"), fit(docs, sf_dir))
    return scored.select("doc_id", (id_remainder(F.col("doc_id"), HELD_MOD) == HELD_REST).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
