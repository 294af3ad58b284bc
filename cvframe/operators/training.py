"""Training and scoring of all cells and labels together (K1, K2, K5).

The study fine-tunes one transformer per (repeat, fold); that engine is out
of scope.  What carries over is its protocol: fit on TRAIN, score VALID every
few steps, keep the weights of the best step (the earliest wins a tie),
score TEST, for every cell and label.  Re-aimed at Spark, the model is a
logistic regression on hashed term frequencies, and all cells x labels are
columns ("responses") of one coefficient matrix:

* a post is one row, whatever the number of cells: its terms, its labels and
  one packed word saying in which split each cell has it
  (:func:`cvframe.operators.splits.cell_bits`);
* a step reads the rows once.  A task multiplies blocks of rows with the
  coefficient matrix (sparse: each row with the coefficients of its own
  terms, each term with the rows that have it), masks each response to the
  TRAIN rows of its cell and adds up its gradient; the partial gradients are
  cut into blocks of features and summed per block, so no task holds more
  than its share.  The same margins give VALID confusion counts for every
  cell and label;
* steps are spectral gradient steps (Barzilai-Borwein) on centred terms; a
  point whose loss is above the last few ones is not taken, and a shorter
  step is tried from the last point.  Every response has its own step and
  decision, so a pass serves all and none influences another: a cell trained
  alone gets the weights it gets together with the others;
* every ``every`` steps the optimiser's state and the counts are appended to
  a folder; a run that finds its own folder goes on from the last whole step.

The matrix (features x responses doubles, :data:`MAX_MATRIX` bytes at most)
is what the driver and each worker hold; nothing there grows with the rows.
Inverse document frequencies and means are those of each cell's TRAIN rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cvframe.functions.text import TOKEN_PATTERN
from cvframe.operators.metrics import CELL, best_checkpoint, macro_prf
from cvframe.operators.splits import SPLIT_BITS
from cvframe.schema import KFOLD_SEEDS, N_FOLDS
from cvframe.session import scratch_dir, written

NUM_FEATURES = 1 << 14
MAX_MATRIX = 256 << 20
ROWS, TERMS = 5000, 1 << 21     # of a block of rows multiplied at once
FEATURE_BLOCK = 2048
STEPS, EVERY, DECAY = 20, 4, 1e-3
RECENT = 5                      # losses a new point may not exceed
ALL_CELLS = [(r, f) for r in range(len(KFOLD_SEEDS)) for f in range(N_FOLDS)]


# --------------------------------------------------------------------------- rows
def term_features(df: DataFrame, text_col: str = "text", num_features: int = NUM_FEATURES) -> DataFrame:
    """Adds ``terms`` (sorted hashes) and ``weights`` (``ln(1 + count)``, scaled
    to length one) of the lower-cased tokens; a NULL text has none."""
    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol="_text", outputCol="_tok", pattern=TOKEN_PATTERN, gaps=False, toLowercase=True),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features)])
    src = df.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    out = pipe.fit(src).transform(src).withColumn("_u", F.unwrap_udt("_tf"))
    out = out.withColumn("_w", F.transform("_u.values", lambda v: F.log1p(v)))
    # the sum of squares is handed on within one expression: as a column of its
    # own Catalyst would put it into the division, a sum over the text per term
    scaled = F.aggregate("_w", F.lit(0.0), lambda s, v: s + v * v,
                         lambda s: F.transform("_w", lambda v: (v / F.sqrt(s)).cast("float")))
    return out.withColumn("terms", F.col("_u.indices")).withColumn("weights", scaled).drop("_text", "_tok", "_tf", "_u", "_w")


def training_rows(labelled: DataFrame, bits: DataFrame, labels: Sequence[str], text_col: str = "text", id_col: str = "post_id",
                  num_features: int = NUM_FEATURES, keep: Sequence[str] = ()) -> DataFrame:
    """``(id, keep.., cells, gold, known, terms, weights)``, one row per post,
    written to the shared folder.  ``gold`` and ``known`` have a bit per
    label; a NULL label is not known and trains nothing."""
    if len(labels) > 62:
        raise ValueError("at most 62 labels")
    pack = " | ".join(f"shiftleft(CAST({{}} AS BIGINT), {k})" for k in range(len(labels)))
    gold = pack.format(*[f"coalesce(CAST(`{d}` AS INT), 0)" for d in labels])
    known = pack.format(*[f"CAST(`{d}` IS NOT NULL AS INT)" for d in labels])
    rows = labelled.join(bits.select(id_col, "cells"), id_col)
    rows = rows.selectExpr(f"`{id_col}`", *[f"`{c}`" for c in keep], "cells", f"{gold} AS gold", f"{known} AS known",
                           f"`{text_col}` AS _raw")
    rows = term_features(rows, "_raw", num_features).drop("_raw")
    return written(rows, "training-rows")


# --------------------------------------------------------------------------- one pass
@dataclass(frozen=True)
class Shape:
    """Cells x labels responses over ``num_features`` terms and an intercept."""

    cells: tuple[tuple[int, int], ...]
    labels: tuple[str, ...]
    num_features: int = NUM_FEATURES
    folds: int = N_FOLDS

    def __post_init__(self):
        if 8 * (self.num_features + 1) * self.responses > MAX_MATRIX:
            raise ValueError("coefficient matrix too large; take fewer features")

    @property
    def responses(self) -> int:
        return len(self.cells) * len(self.labels)

    @property
    def blocks(self) -> int:
        return -(-(self.num_features + 1) // FEATURE_BLOCK)

    def splits(self, cells: np.ndarray) -> np.ndarray:
        """Split code of every (row, cell)."""
        shift = np.array([2 * (r * self.folds + f) for r, f in self.cells], np.int64)
        return (cells[:, None] >> shift) & 3

    def wide(self, per_cell: np.ndarray) -> np.ndarray:
        """Cell columns repeated for their labels (cell-major responses)."""
        return np.repeat(per_cell, len(self.labels), axis=-1)

    def bits(self, packed: np.ndarray) -> np.ndarray:
        """(row, label) booleans of packed labels."""
        return (packed[:, None] >> np.arange(len(self.labels))) & 1 == 1


class Rows:
    """A block of rows as a sparse matrix over the terms and an intercept."""

    def __init__(self, batch: pa.RecordBatch, num_features: int):
        terms, weights = batch["terms"], batch["weights"]
        self.size, self.num_features = np.diff(terms.offsets.to_numpy()), num_features
        self.terms = np.asarray(terms.flatten()).astype(np.intp)
        self.weights = np.asarray(weights.flatten()).astype(float)
        self.cells, self.gold, self.known = (np.asarray(batch[c]) if c in batch.schema.names else None
                                             for c in ("cells", "gold", "known"))

    def times(self, coefficients: np.ndarray) -> np.ndarray:
        """Rows x columns: the rows' products with ``coefficients``."""
        out = np.empty((len(self.size), coefficients.shape[1]))
        end = np.cumsum(self.size)
        for i, (a, b) in enumerate(zip((end - self.size).tolist(), end.tolist())):
            np.dot(self.weights[a:b], coefficients.take(self.terms[a:b], axis=0), out=out[i])
        return out + coefficients[-1]

    def add_to(self, matrix: np.ndarray, per_row: np.ndarray, factors: Callable[[np.ndarray], np.ndarray] = lambda w: w) -> None:
        """Adds to each term's row of ``matrix`` the rows of ``per_row`` that
        have the term, times ``factors`` of its weights there; several rows of
        factors give columns beside each other.  The intercept's factors are 1."""
        order = np.argsort(self.terms.astype(np.uint16 if self.num_features <= 1 << 16 else np.intp), kind="stable")
        terms, times = self.terms[order], factors(self.weights[order])
        rows = np.repeat(np.arange(len(self.size)), self.size)[order]
        first = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])[:len(terms)])
        out = np.empty((len(first), *times.shape[:-1], per_row.shape[1]))
        for j, (a, b) in enumerate(zip(first.tolist(), [*first[1:].tolist(), len(terms)])):
            np.dot(times[..., a:b], per_row.take(rows[a:b], axis=0), out=out[j])
        matrix[terms[first]] += out.reshape(len(first), matrix.shape[1])
        matrix[-1] += np.tile(per_row.sum(0), matrix.shape[1] // per_row.shape[1])


def _row_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = np.diff(batch["terms"].offsets.to_numpy())
        a = 0
        while a < batch.num_rows:
            n = max(1, int(np.searchsorted(np.cumsum(size[a:a + ROWS]), TERMS, "right")))
            yield batch.slice(a, n)
            a += n


def _summed(rows: DataFrame, shape: Shape, add: Callable[[Rows, np.ndarray, np.ndarray], None], columns: int,
            counters: int) -> tuple[np.ndarray, np.ndarray]:
    """One pass: (feature matrix with ``columns`` columns, counters).

    ``add(block of rows, matrix, counters)`` adds a block to its task's sums.
    Tasks emit blocks of features, which are summed per block, streaming."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, counts = np.zeros((shape.num_features + 1, columns)), np.zeros(counters)
        for part in _row_blocks(batches):
            add(Rows(part, shape.num_features), matrix, counts)
        if matrix.any() or counts.any():
            parts = [matrix[a:a + FEATURE_BLOCK].tobytes() for a in range(0, len(matrix), FEATURE_BLOCK)]
            yield pa.record_batch([pa.array([-1, *range(len(parts))], pa.int32()), pa.array([counts.tobytes(), *parts], pa.binary())],
                                  names=["block", "part"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, block = None, None
        for batch in batches:
            block = batch["block"][0].as_py() if batch.num_rows else block
            for part in batch["part"]:
                v = np.frombuffer(part.as_buffer(), np.float64)
                out = v.copy() if out is None else np.add(out, v, out=out)
        if out is not None:
            yield pa.record_batch([pa.array([block], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["block", "part"])

    total.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    parts = rows.mapInArrow(partial, "block int, part binary")
    found = {r["block"]: r["part"] for r in parts.groupBy("block").applyInArrow(total, "block int, part binary").collect()}
    matrix = np.zeros((shape.num_features + 1, columns))
    for b in range(shape.blocks):
        if b in found:
            matrix[b * FEATURE_BLOCK:(b + 1) * FEATURE_BLOCK] = np.frombuffer(found[b]).reshape(-1, columns)
    return matrix, np.frombuffer(found[-1]).copy() if -1 in found else np.zeros(counters)


@dataclass
class _Corpus:
    """What TRAIN says before any step: rows per cell, known and positive
    ones per response, and per (term, cell) rows with the term, sums and
    sums of squares."""

    n: np.ndarray
    known: np.ndarray
    positive: np.ndarray
    with_term: np.ndarray
    total: np.ndarray
    squares: np.ndarray


def _corpus(rows: DataFrame, shape: Shape) -> _Corpus:
    n, k = len(shape.cells), shape.responses

    def add(block: Rows, matrix: np.ndarray, counts: np.ndarray) -> None:
        train = (shape.splits(block.cells) == SPLIT_BITS["TRAIN"]).astype(float)
        block.add_to(matrix, train, lambda w: np.stack([(w != 0).astype(float), w, w * w]))
        known = shape.bits(block.known)
        counts[:n] += train.sum(0)
        counts[n:n + k] += (train.T @ known).ravel()
        counts[n + k:] += (train.T @ (known & shape.bits(block.gold))).ravel()

    m, counts = _summed(rows, shape, add, 3 * n, n + 2 * k)
    return _Corpus(counts[:n], counts[n:n + k], counts[n + k:], m[:, :n], m[:, n:2 * n], m[:, 2 * n:])


def _step(rows: DataFrame, shape: Shape, coefficients: np.ndarray, weight: np.ndarray,
          known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At ``coefficients``: gradient and value of the mean TRAIN loss of each
    response, and VALID confusion counts (response x tp, fp, fn, tn)."""
    shared = rows.sparkSession.sparkContext.broadcast(coefficients)
    share = 1.0 / np.maximum(known, 1.0)
    labels, n = len(shape.labels), shape.responses

    def add(block: Rows, matrix: np.ndarray, counts: np.ndarray) -> None:
        margin = block.times(shared.value)
        split = shape.splits(block.cells)
        known_here = np.tile(shape.bits(block.known), len(shape.cells))
        y = np.tile(shape.bits(block.gold), len(shape.cells))
        part = np.where(y, weight, 1.0) * (shape.wide(split == SPLIT_BITS["TRAIN"]) & known_here) * share
        block.add_to(matrix, (0.5 * (1.0 + np.tanh(0.5 * margin)) - y) * part)
        counts[:n] += ((np.logaddexp(0.0, margin) - y * margin) * part).sum(0)
        valid = shape.wide(split == SPLIT_BITS["VALID"]) & known_here
        p = margin > 0
        for i, hit in enumerate((y & p, ~y & p, y & ~p, ~y & ~p)):
            counts[n + i::4] += (hit & valid).sum(0)

    try:
        gradient, counts = _summed(rows, shape, add, len(shape.cells) * labels, 5 * n)
    finally:
        shared.unpersist()
    return gradient, counts[:n], counts[n:]


# --------------------------------------------------------------------------- K1, K2
@dataclass
class StackedModel:
    """One coefficient matrix for all cells: column ``cell * labels + label``,
    term weights included, last row the intercepts.  ``history`` has
    (approach, repeat, fold, step, score), ``best`` what M5 picks from it."""

    shape: Shape
    coefficients: np.ndarray
    history: DataFrame
    best: DataFrame


def _saved_steps(spark: SparkSession, folder: str, shape: Shape) -> list[int]:
    """Steps in the folder that are complete, ascending."""
    try:
        table = spark.read.parquet(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return []
        raise
    n = table.groupBy("step").agg(F.countDistinct("block").alias("n")).where(F.col("n") == shape.blocks + 1)
    return sorted(r["step"] for r in n.collect())       # one number per saved step


def _saved(spark: SparkSession, folder: str, step: int, run: str, shape: Shape, column: str) -> np.ndarray:
    """A saved matrix: ``x`` the weights, ``y`` their gradient."""
    rows = {r["block"]: r for r in spark.read.parquet(folder).where(F.col("step") == step).select("block", "run", column).collect()}
    if any(r["run"] != run for r in rows.values()):
        raise ValueError(f"{folder} holds another run (other parameters); take a new folder")
    parts = [np.frombuffer(rows[b][column]) for b in range(shape.blocks)]
    return np.concatenate(parts).reshape(-1, shape.responses).copy()


def _saved_state(spark: SparkSession, folder: str, step: int) -> tuple[np.ndarray, np.ndarray]:
    row = spark.read.parquet(folder).where((F.col("step") == step) & (F.col("block") == -1)).select("x", "y").first()
    return np.frombuffer(row["x"]).copy(), np.frombuffer(row["y"]).copy()


def _history(spark: SparkSession, folder: str, shape: Shape, approach: str, last: int) -> DataFrame:
    """VALID scores of the saved steps: macro F1, mean over the labels."""
    counts = spark.read.parquet(folder).where((F.col("block") == -1) & (F.col("step") <= last)).select("step", "y")
    rows = []
    for r in counts.distinct().collect():               # cells x labels counts a step
        conf = np.frombuffer(r["y"]).reshape(len(shape.cells), len(shape.labels), 4).astype(int).tolist()
        rows += [(approach, *cell, r["step"], d, *c) for cell, per in zip(shape.cells, conf) for d, c in zip(shape.labels, per)]
    schema = "approach string, repeat int, fold int, step int, dim string, tp long, fp long, fn long, tn long"
    per_label = macro_prf(spark.createDataFrame(rows, schema))
    return per_label.groupBy(*CELL, "step").agg(F.avg("macro_f1").alias("score"))


def clamped_weights(known: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """The rule of :func:`cvframe.operators.weights.pos_weights` on counts."""
    negative = known - positive
    use = (positive > 0) & (negative >= positive)
    return np.where(use, negative / np.where(use, positive, 1.0), 1.0)


def train(rows: DataFrame, labels: Sequence[str], weights: Mapping[tuple[int, int, str], float] | str | None = None,
          cells: Sequence[tuple[int, int]] = ALL_CELLS, approach: str = "logistic", num_features: int = NUM_FEATURES,
          steps: int = STEPS, every: int = EVERY, decay: float = DECAY, folder: str | None = None) -> StackedModel:
    """K1 (one label) and K2: fits all cells and labels of ``rows``.

    ``rows``: :func:`training_rows`.  ``weights``: weight of the positives per
    (repeat, fold, label), 1 where missing, or ``"clamped"`` for those of W1,
    which follow from the first pass's counts.  After every ``every`` steps VALID
    is scored and the state saved in ``folder`` (a new one by default); a
    folder that holds the same run is continued.  Each cell keeps the
    weights of its best step (the mean over the labels decides).  A label
    that has one class in TRAIN gets an intercept that says so; a cell
    without TRAIN rows keeps zero weights (every logit 0, so label 0)."""
    if steps < 1 or every < 1:
        raise ValueError("steps and every start from 1")
    if isinstance(weights, str) and weights != "clamped":
        raise ValueError(f"unknown weights {weights}")
    spark = rows.sparkSession
    shape = Shape(tuple(cells), tuple(labels), num_features)
    folder = folder or scratch_dir(spark, "training")
    run = md5(json.dumps([shape.cells, shape.labels, num_features, every, decay,
                          weights if isinstance(weights, str) else sorted((weights or {}).items())]).encode()).hexdigest()
    corpus = _corpus(rows, shape)
    scale = np.log((corpus.n + 1.0) / (corpus.with_term + 1.0))     # inverse document frequency
    scale[-1] = 1.0
    share = 1.0 / np.maximum(corpus.n, 1.0)
    mean = scale * corpus.total * share
    mean[-1] = 0.0
    # the trace bounds the curvature: a step of 1 / bound always descends
    trace = (scale * scale * corpus.squares * share - mean * mean).sum(0)
    if weights == "clamped":
        weight = clamped_weights(corpus.known, corpus.positive)
    else:
        weight = np.array([float((weights or {}).get((*c, d), 1.0)) for c in shape.cells for d in shape.labels])
    shortest = 1.0 / (0.25 * np.maximum(weight, 1.0) * shape.wide(np.maximum(trace, 1.0)) + decay)
    scale, mean = shape.wide(scale), shape.wide(mean)
    shrink = np.full((num_features + 1, 1), decay)
    shrink[-1] = 0.0

    def raw(w: np.ndarray) -> np.ndarray:
        """Coefficients on the terms as stored, for weights on scaled and centred ones."""
        out = scale * w
        out[-1] -= (mean * w).sum(0)
        return out

    done = [s for s in _saved_steps(spark, folder, shape) if s <= steps]
    if done:
        x, g = (_saved(spark, folder, done[-1], run, shape, c) for c in ("x", "y"))
        state, counts = _saved_state(spark, folder, done[-1])
        state = state.reshape(1 + RECENT, -1)
        rate, recent, t = state[0], state[1:], done[-1] + 1
    else:
        x = g = np.zeros((num_features + 1, shape.responses))
        rate, recent, counts, t = shortest, np.full((RECENT, shape.responses), np.inf), np.zeros(4 * shape.responses), 0
    while t <= steps:
        tried = x - rate * g
        slope, loss, seen = _step(rows, shape, raw(tried), weight, corpus.known)
        slope = scale * slope - mean * slope[-1] + shrink * tried
        loss = loss + 0.5 * (shrink * tried * tried).sum(0)
        highest = recent.max(0)
        taken = (loss <= highest) | (rate <= shortest)
        moved, bent = tried - x, slope - g
        along = (moved * bent).sum(0)
        spectral = np.divide((moved * moved).sum(0), along, out=np.full_like(rate, np.inf), where=along > 0)
        # the first point is the start itself; longest steps stay within the decay's own scale
        spectral = np.clip(spectral, shortest, 1.0 / decay) if t else shortest
        rate = np.where(taken, spectral, np.maximum(0.25 * rate, shortest))
        x, g = np.where(taken, tried, x), np.where(taken, slope, g)
        recent = np.where(taken, np.vstack([recent[1:], loss]) if t else np.vstack([np.full_like(recent[1:], -np.inf), loss]), recent)
        counts = np.where(np.repeat(taken, 4), seen, counts)
        if t and (t % every == 0 or t == steps):
            _save(spark, folder, t, run, x, g, np.vstack([rate, recent]), counts)
        t += 1
    history = _history(spark, folder, shape, approach, steps)
    best = best_checkpoint(history)
    chosen = {(r["repeat"], r["fold"]): r["best_step"] for r in best.collect()}      # one row a cell
    out = np.zeros_like(scale)
    for step in sorted(set(chosen.values())):
        at = _saved(spark, folder, step, run, shape, "x")
        mine = shape.wide(np.array([chosen[c] == step for c in shape.cells]))
        out[:, mine] = at[:, mine]
    return StackedModel(shape, raw(out), history, best)


def _save(spark: SparkSession, folder: str, step: int, run: str, x: np.ndarray, g: np.ndarray, state: np.ndarray,
          counts: np.ndarray) -> None:
    """One append a step: block -1 has the responses' state and counts."""
    rows = [(step, run, -1, state.tobytes(), counts.tobytes())]
    rows += [(step, run, b, x[a:a + FEATURE_BLOCK].tobytes(), g[a:a + FEATURE_BLOCK].tobytes())
             for b, a in enumerate(range(0, len(x), FEATURE_BLOCK))]
    table = spark.createDataFrame(rows, "step int, run string, block int, x binary, y binary")
    table.coalesce(1).write.mode("append").parquet(folder)


# --------------------------------------------------------------------------- K5
def predict(model: StackedModel, rows: DataFrame, splits: Sequence[str] = ("VALID", "TEST"),
            keep: Sequence[str] = ("post_id",)) -> DataFrame:
    """``(keep.., repeat, fold, split, logit_0 ..)``: each post scored by the
    models of the cells that have it in one of ``splits``.

    One pass over the rows: a post's margins of all cells are one product,
    and its packed word says which of them are asked for."""
    shape = model.shape
    shared = rows.sparkSession.sparkContext.broadcast(model.coefficients)
    names = {SPLIT_BITS[s]: s for s in splits}
    labels = len(shape.labels)
    repeat, fold = (np.array([c[i] for c in shape.cells], np.int32) for i in (0, 1))
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("repeat", T.IntegerType()), T.StructField("fold", T.IntegerType()),
                           T.StructField("split", T.StringType()), *[T.StructField(f"logit_{k}", T.DoubleType()) for k in range(labels)]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _row_blocks(batches):
            block = Rows(part, shape.num_features)
            margin = block.times(shared.value)
            split = shape.splits(block.cells)
            i, c = np.nonzero(np.isin(split, list(names)))
            at = pa.array(i)
            yield pa.RecordBatch.from_arrays(
                [*[part[k].take(at) for k in keep], pa.array(repeat[c]), pa.array(fold[c]),
                 pa.array([names[s] for s in split[i, c].tolist()], pa.string()),
                 *[pa.array(margin[i, c * labels + k]) for k in range(labels)]], names=schema.names)

    return rows.select(*dict.fromkeys([*keep, "cells", "terms", "weights"])).mapInArrow(work, schema)


def train_cells(labelled: DataFrame, bits: DataFrame, labels: Sequence[str], weights: Mapping | str | None = None,
                approach: str = "logistic", text_col: str = "text", id_col: str = "post_id", **kw) -> tuple[DataFrame, StackedModel]:
    """K1/K2/K5 in one go: ``(approach, repeat, fold, id, logit_0 ..)`` of
    every TEST post by its cell's model, and the model."""
    rows = training_rows(labelled, bits, labels, text_col, id_col, kw.get("num_features", NUM_FEATURES))
    model = train(rows, labels, weights, approach=approach, **kw)
    scored = predict(model, rows, ("TEST",), [id_col])
    return scored.select(F.lit(approach).alias("approach"), "repeat", "fold", id_col,
                         *[f"logit_{k}" for k in range(len(labels))]), model
