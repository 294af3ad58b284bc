"""Repeated multilabel-stratified TRAIN / VALID / TEST assignment.

Definition (also what the SQL oracle computes).  For repeat ``r`` with seed
``s_r``::

    pos  = row_number() over (partition by r
                              order by md5(s_r ':' code), code, md5(s_r ':' id), id) - 1
    test_fold = pos % k

``code`` is the labelset as a bit mask.  Rows with equal label vectors are
neighbours in that order, so every labelset is dealt round-robin over the
folds: fold sizes differ by at most one and every label is spread evenly.
The order of the labelsets depends on the seed too, so a labelset of a
single row meets another fold in each repeat.  The inner holdout renumbers
the non-test rows of each cell ``(r, f)`` by ``(code, md5(seed ':' id), id)``
with the holdout seed and sends every ``every``-th position to VALID.

Nothing here sorts globally: see :mod:`cvframe.operators.index`.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cvframe.functions.hashing import keyed_md5
from cvframe.operators.index import BUCKET_COL, ordered_index, running_offsets
from cvframe.schema import HOLDOUT_EVERY, HOLDOUT_SEED, KFOLD_SEEDS, LABEL_COLS, N_FOLDS

MAX_LABELS = 30  # labelset code is a bit mask in a BIGINT
MAX_GREEDY_LABELS = 20  # D5 solves its quotas on up to 2**labels counts in one task
CODE = "labelset_code"
SPLIT_BITS = {"TRAIN": 1, "VALID": 2, "TEST": 3}    # two bits a cell, 0: not assigned


def labelset_code(dims: Sequence[str] = LABEL_COLS) -> Column:
    """Bit mask with the first label as most significant bit, so ascending
    code order equals ascending ``(l1, ..., ln)`` order."""
    if len(dims) > MAX_LABELS:
        raise ValueError("too many labels for a labelset code")
    n = len(dims)
    return F.expr(" + ".join(f"CAST(`{d}` AS BIGINT) * {1 << (n - 1 - i)}" for i, d in enumerate(dims)))


def _known_code(dims: Sequence[str]) -> Column:
    """The code, -1 for rows with a NULL label (a group of their own).  Never
    NULL: joins on it then infer no filter that would part shared scans."""
    return F.coalesce(labelset_code(dims), F.lit(-1).cast("bigint"))


def labelset_string(dims: Sequence[str] = LABEL_COLS) -> Column:
    return F.concat(*[F.col(d).cast("string") for d in dims])


# --------------------------------------------------------------------------- D1
def labelset_counts(df: DataFrame, dims: Sequence[str] = LABEL_COLS) -> DataFrame:
    """Frequency of each label combination: ``(labelset, n)``."""
    return df.groupBy(labelset_string(dims).alias("labelset")).agg(F.count(F.lit(1)).alias("n"))


def _seeded(corpus: DataFrame, id_col: str, dims, seeds, by: Sequence[str] = ()) -> DataFrame:
    """One row per (post, repeat) with the repeat's seed hash; no join."""
    return corpus.select(
        *[F.col(b) for b in by],
        F.col(id_col),
        _known_code(dims).alias("_code"),
        F.posexplode(_seed_array(seeds)).alias("repeat", "_seed"),
    ).withColumn("_h", keyed_md5(F.col("_seed"), F.col(id_col))).drop("_seed")


def _seed_array(seeds) -> Column:
    return F.array(*[F.lit(str(s)) for s in seeds])


# --------------------------------------------------------------------------- D2
def ms_kfold(
    corpus: DataFrame,
    id_col: str = "post_id",
    dims: Sequence[str] = LABEL_COLS,
    k: int = N_FOLDS,
    seeds: Sequence[int] = KFOLD_SEEDS,
    digits: int = 3,
    keep_code: bool = False,
    by: Sequence[str] = (),
) -> DataFrame:
    """Stratified k-fold TEST assignment for every seed: ``(id, repeat, fold)``.

    ``by`` columns (e.g. ``dataset_version``) split each group on its own,
    all groups in the same job."""
    by = list(by)
    base = _seeded(corpus, id_col, dims, seeds, by)
    # the seeded order of the labelsets: hashed once per labelset and repeat
    seed = F.element_at(_seed_array(seeds), F.col("repeat") + 1)
    idx = ordered_index(base, [*by, "repeat"], ["_code"], "_h", id_col, out_col="_pos", digits=digits,
                        group_order=[keyed_md5(seed, F.col("_code")), F.col("_code")])
    cols = [*[F.col(b) for b in by], F.col(id_col), F.col("repeat").cast("int").alias("repeat"),
            (F.col("_pos") % k).cast("int").alias("fold")]
    if keep_code:
        cols.append(F.col("_code"))
    return idx.select(*cols)


# --------------------------------------------------------------------------- D3 + D4
def assign_splits(
    corpus: DataFrame,
    id_col: str = "post_id",
    dims: Sequence[str] = LABEL_COLS,
    k: int = N_FOLDS,
    seeds: Sequence[int] = KFOLD_SEEDS,
    holdout_seed: int = HOLDOUT_SEED,
    every: int = HOLDOUT_EVERY,
    digits: int = 3,
    test_folds: DataFrame | None = None,
    by: Sequence[str] = (),
    per_repeat: bool = False,
    keep_code: bool = False,
) -> DataFrame:
    """Long split table ``(id, repeat, fold, split)``: one row per post and cell
    (``per_repeat=True``: one row per post and repeat, ``splits`` array;
    ``keep_code=True``: with the labelset code, so counts per cell and label
    need no join with the labels).

    ``test_folds`` may carry a precomputed ``(id, repeat, fold, _code)``
    TEST assignment (e.g. from :func:`iterative_stratify`); by default the
    labelset-systematic k-fold is used.

    Holdout without a per-cell sort: within ``(repeat, labelset, bucket)``
    (bucket = leading hex digits of the holdout hash) one window pass gives
    each row its rank ``rn`` and, per fold ``f``, how many rows up to it
    are TEST in ``f``; its rank among the non-test rows of cell ``f`` is
    ``rn - seen_f``.  Bucket sizes per cell are a bucket's last values.
    """
    by = list(by)
    kf = test_folds if test_folds is not None else ms_kfold(corpus, id_col, dims, k, seeds, digits, keep_code=True,
                                                            by=by)
    kf = kf.withColumnRenamed("fold", "_test")
    d = kf.withColumn("_h2", keyed_md5(F.lit(str(holdout_seed)), F.col(id_col))).withColumn(
        BUCKET_COL, F.substring("_h2", 1, digits)
    )
    keys = [*by, "repeat", "_code", BUCKET_COL]
    d = d.select(*keys, "_h2", F.struct(id_col, "_test").alias("_row"))     # as in ordered_index: one shuffle
    w_rn = Window.partitionBy(*keys).orderBy("_h2", "_row")
    w_run = w_rn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = d.select(
        "*",
        F.row_number().over(w_rn).cast("bigint").alias("_rn"),
        *[F.sum((F.col("_row._test") == f).cast("bigint")).over(w_run).alias(f"_s{f}") for f in range(k)],
    )
    # a bucket's sizes are its last rank and running sums
    sizes = ranked.groupBy(*keys).agg(F.max("_rn").alias("_tot"), *[F.max(f"_s{f}").alias(f"_c{f}") for f in range(k)])
    nontest = sizes.select(*keys, *[(F.col("_tot") - F.col(f"_c{f}")).alias(f"_n{f}") for f in range(k)])
    offsets = running_offsets(nontest, [*by, "repeat"], ["_code"], BUCKET_COL,
                              [f"_n{f}" for f in range(k)], [f"_o{f}" for f in range(k)])
    offsets = offsets.select(*keys, F.array(*[F.col(f"_o{f}") for f in range(k)]).alias("_offs"))
    ranked = ranked.select(*keys, F.col(f"_row.`{id_col}`").alias(id_col), F.col("_row._test").alias("_test"),
                           (F.col("_rn") - 1).alias("_rn"), F.array(*[F.col(f"_s{f}") for f in range(k)]).alias("_seen"))
    j = ranked.join(offsets, keys, "left")  # see ordered_index on why left
    code = [f"nullif(_code, -1L) AS {CODE}"] if keep_code else []
    if per_repeat:
        # (id, repeat) rows with the k splits of that repeat as an array
        return j.selectExpr(*[f"`{b}`" for b in by], f"`{id_col}`", *code, "CAST(repeat AS INT) AS repeat",
                            f"transform(sequence(0, {k - 1}), f -> {_split_case(every)}) AS splits")
    cell = f"named_struct('fold', f, 'split', {_split_case(every)})"
    return j.selectExpr(*[f"`{b}`" for b in by], f"`{id_col}`", *code, "CAST(repeat AS INT) AS repeat",
                        f"inline(transform(sequence(0, {k - 1}), f -> {cell}))")


def _split_case(every: int) -> str:
    """Split of cell fold ``f`` for a ranked row (SQL text)."""
    return (f"CASE WHEN f = _test THEN 'TEST' "
            f"WHEN (element_at(_offs, f + 1) + _rn - element_at(_seen, f + 1)) % {every} = 0 THEN 'VALID' "
            f"ELSE 'TRAIN' END")


def assign_splits_wide(corpus: DataFrame, id_col: str = "post_id", dims: Sequence[str] = LABEL_COLS,
                       k: int = N_FOLDS, seeds: Sequence[int] = KFOLD_SEEDS, name: str = "fold{repeat}_{fold}",
                       by: Sequence[str] = (), **kw) -> DataFrame:
    """Export form computed directly: one row per id, one column per cell.

    Each (id, repeat) row already knows all ``k`` splits of its repeat, so
    only ``repeats`` rows per id are shuffled to meet (a pivot of the long
    table would shuffle ``repeats x k``)."""
    by = list(by)
    per = assign_splits(corpus, id_col, dims, k, seeds, by=by, per_repeat=True, **kw)
    wide = per.groupBy(*by, id_col).pivot("repeat", list(range(len(seeds)))).agg(F.first("splits"))
    cols = [f"element_at(`{r}`, {f + 1}) AS `{name.format(repeat=r, fold=f)}`"
            for r in range(len(seeds)) for f in range(k)]
    return wide.selectExpr(*[f"`{b}`" for b in by], f"`{id_col}`", *cols)


def cell_bits(corpus: DataFrame, id_col: str = "post_id", dims: Sequence[str] = LABEL_COLS, k: int = N_FOLDS,
              seeds: Sequence[int] = KFOLD_SEEDS, by: Sequence[str] = (), **kw) -> DataFrame:
    """``(by.., id, cells)``, the splits of all cells of a post in one
    BIGINT: two bits (:data:`SPLIT_BITS`) at ``2 * (repeat * k + fold)``.

    Any part of any cell is then a mask on one column (:func:`in_split`):
    a corpus that carries it is read once for all cells, without a join per
    part."""
    if k * len(seeds) > 31:
        raise ValueError("at most 31 cells fit one packed word")
    per = assign_splits(corpus, id_col, dims, k, seeds, by=list(by), per_repeat=True, **kw)
    code = "CASE element_at(splits, {}) WHEN 'TRAIN' THEN 1L WHEN 'VALID' THEN 2L ELSE 3L END"
    mine = " | ".join(f"shiftleft({code.format(f + 1)}, 2 * (repeat * {k} + {f}))" for f in range(k))
    return per.groupBy(*by, id_col).agg(F.bit_or(F.expr(mine)).alias("cells"))


def wide_bits(prefix: str = "fold{repeat}_{fold}", k: int = N_FOLDS, repeats: int = len(KFOLD_SEEDS)) -> Column:
    """The packed word from the export form's split columns."""
    parts = [f"shiftleft(CASE `{prefix.format(repeat=r, fold=f)}` WHEN 'TRAIN' THEN 1L WHEN 'VALID' THEN 2L WHEN 'TEST' THEN 3L ELSE 0L END, "
             f"{2 * (r * k + f)})" for r in range(repeats) for f in range(k)]
    return F.expr(" | ".join(parts))


def in_split(cells: Column, repeat: int, fold: int, split: str, k: int = N_FOLDS) -> Column:
    """Whether a packed word has the post in that part of the cell."""
    return F.shiftright(cells, 2 * (repeat * k + fold)).bitwiseAND(3) == SPLIT_BITS[split]


def test_split(corpus: DataFrame, id_col: str = "post_id", dims: Sequence[str] = LABEL_COLS, k: int = N_FOLDS,
               seeds: Sequence[int] = KFOLD_SEEDS, digits: int = 3, by: Sequence[str] = (),
               keep_code: bool = False) -> DataFrame:
    """The TEST rows of :func:`assign_splits` - by definition the k-fold
    assignment itself - without the holdout pass.  Evaluation needs only
    these, so it skips the three holdout shuffles."""
    kf = ms_kfold(corpus, id_col, dims, k, seeds, digits, keep_code=keep_code, by=by)
    if keep_code:
        kf = kf.withColumn("_code", F.expr("nullif(_code, -1L)")).withColumnRenamed("_code", CODE)
    return kf.withColumn("split", F.lit("TEST"))


def ms_holdout(
    corpus: DataFrame,
    id_col: str = "post_id",
    dims: Sequence[str] = LABEL_COLS,
    seed: int = HOLDOUT_SEED,
    every: int = HOLDOUT_EVERY,
    digits: int = 3,
) -> DataFrame:
    """Single stratified holdout over the whole input: ``(id, split)`` with
    every ``every``-th row in (labelset, md5) order in VALID, rest TRAIN."""
    base = corpus.select(
        F.col(id_col), _known_code(dims).alias("_code"), keyed_md5(F.lit(str(seed)), F.col(id_col)).alias("_h")
    )
    idx = ordered_index(base, [], ["_code"], "_h", id_col, out_col="_pos", digits=digits)
    return idx.select(
        id_col, F.when(F.col("_pos") % every == 0, F.lit("VALID")).otherwise(F.lit("TRAIN")).alias("split")
    )


def splits_wide(splits: DataFrame, id_col: str = "post_id", k: int = N_FOLDS, repeats: int = len(KFOLD_SEEDS),
                name: str = "fold{repeat}_{fold}", by: Sequence[str] = ()) -> DataFrame:
    """Export form: one column per cell (explicit pivot values, no extra job).
    ``name='fold{repeat}.{fold}'`` reproduces the study's column names."""
    names = [name.format(repeat=r, fold=f) for r in range(repeats) for f in range(k)]
    cell = F.format_string(name.replace("{repeat}", "%d").replace("{fold}", "%d"), "repeat", "fold")
    return splits.withColumn("_cell", cell).groupBy(*by, id_col).pivot("_cell", names).agg(F.first("split"))


def split_rows(corpus: DataFrame, splits: DataFrame, repeat: int, fold: int, split: str,
               id_col: str = "post_id", by: Sequence[str] = ()) -> DataFrame:
    """Rows of one cell's TRAIN/VALID/TEST part (P5): filter then equi-join.

    ``by`` columns (e.g. ``dataset_version``) are part of the key: a post is
    taken where its own variant puts it in the part."""
    ids = splits.filter((F.col("repeat") == repeat) & (F.col("fold") == fold) & (F.col("split") == split))
    return corpus.join(ids.select(*by, id_col), [*by, id_col], "left_semi")


# --------------------------------------------------------------------------- D5
def _greedy_quotas(codes: np.ndarray, counts: np.ndarray, n_labels: int, k: int) -> np.ndarray:
    """Rarest-label-first iterative stratification on labelset counts.

    Returns an ``S x k`` matrix of rows per (labelset, fold).  Cost depends
    on the number of labelsets and folds, not on the number of rows.
    """
    s = len(codes)
    shifts = np.arange(n_labels - 1, -1, -1, dtype=np.int64)
    bits = ((np.maximum(codes, 0)[:, None] >> shifts[None, :]) & 1).astype(np.float64)  # S x L; -1 (a NULL label) has none
    counts = counts.astype(np.int64)
    label_tot = bits.T @ counts.astype(np.float64)
    norm = np.where(label_tot > 0, label_tot, 1.0)
    demand = np.tile(label_tot / k, (k, 1))  # k x L
    size_left = np.full(k, counts.sum() / k)
    label_left = label_tot.copy()
    quota = np.zeros((s, k), dtype=np.int64)
    placed = np.zeros(s, dtype=bool)

    def give(i: int) -> None:
        n = int(counts[i])
        base, rem = divmod(n, k)
        quota[i] += base
        demand[:] -= base * bits[i][None, :]
        size_left[:] -= base
        topped = np.zeros(k, dtype=bool)
        for _ in range(rem):
            # only folds that are not yet ahead in size may take a left-over
            # row (keeps fold sizes within one); among them the one that
            # still wants this labelset's labels most, then the lower fold
            score = (demand / norm[None, :]) @ bits[i]
            room = max(size_left[f] for f in range(k) if not topped[f])
            best = None
            for f in range(k):
                if topped[f] or size_left[f] < room - 1e-9:
                    continue
                key = (score[f], -f)
                if best is None or key > best[0]:
                    best = (key, f)
            f = best[1]
            topped[f] = True
            quota[i, f] += 1
            demand[f] -= bits[i]
            size_left[f] -= 1
        placed[i] = True
        label_left[:] -= n * bits[i]

    while True:
        open_labels = [j for j in range(n_labels) if label_left[j] > 0]
        if not open_labels:
            break
        lab = min(open_labels, key=lambda j: (label_left[j], j))
        for i in np.nonzero((bits[:, lab] > 0) & ~placed)[0]:
            give(int(i))
    for i in np.argsort(-counts, kind="stable"):
        if not placed[i]:
            give(int(i))
    return quota


def iterative_stratify(
    corpus: DataFrame,
    id_col: str = "post_id",
    dims: Sequence[str] = LABEL_COLS,
    k: int = N_FOLDS,
    seeds: Sequence[int] = KFOLD_SEEDS,
    digits: int = 3,
    keep_code: bool = False,
    by: Sequence[str] = (),
) -> DataFrame:
    """Iterative (rarest label first) stratified k-fold: ``(id, repeat, fold)``.

    1. labelset counts: distributed partial aggregate;
    2. greedy quotas on the count table, one pandas task.  The table has at
       most ``2**len(dims)`` rows whatever the corpus size, and quotas do
       not depend on the seed, so they are computed once;
    3. quotas are joined on the labelset; each row's rank inside its
       labelset (seeded md5 order, bucketed index) picks the fold whose
       cumulative quota range holds it;
    4. folds are numbered anew in each repeat (by ``md5(seed ':' fold)``), so
       a labelset with fewer rows than folds meets other folds.
    """
    n = len(dims)
    if n > MAX_GREEDY_LABELS:
        raise ValueError(f"iterative stratification takes at most {MAX_GREEDY_LABELS} labels")
    by = list(by)
    counts = corpus.groupBy(*by, _known_code(dims).alias("_code")).agg(F.count(F.lit(1)).alias("_n"))
    by_schema = [f.simpleString().replace(":", " ", 1) for f in corpus.select(*by).schema.fields]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_code").reset_index(drop=True)
        q = _greedy_quotas(pdf["_code"].to_numpy(np.int64), pdf["_n"].to_numpy(np.int64), n, k)
        cum = np.cumsum(q, axis=1)
        out = pd.DataFrame({b: pdf[b] for b in by})
        out["_code"] = pdf["_code"]
        out["_cum"] = list(cum.tolist())
        return out

    # one pandas group per `by` value; each holds that group's labelset
    # count table (at most 2**len(dims) rows, independent of the corpus size)
    grouping = by if by else [F.lit(0).alias("_g")]
    quotas = counts.groupBy(*grouping).applyInPandas(
        lambda pdf: solve(pdf.drop(columns=["_g"], errors="ignore")),
        schema=", ".join([*by_schema, "_code long", "_cum array<long>"]),
    )
    base = _seeded(corpus, id_col, dims, seeds, by)
    idx = ordered_index(base, [*by, "repeat", "_code"], [], "_h", id_col, out_col="_pos", digits=digits)
    j = idx.join(quotas, [*by, "_code"])
    slot = F.size(F.filter("_cum", lambda c: c <= F.col("_pos")))
    orders = [sorted(range(k), key=lambda f: md5(f"{s}:{f}".encode()).hexdigest()) for s in seeds]
    renumbered = F.array(*[F.array(*[F.lit(f) for f in o]) for o in orders])
    fold = F.element_at(F.element_at(renumbered, F.col("repeat").cast("int") + 1), slot + 1)
    cols = [*[F.col(b) for b in by], F.col(id_col), F.col("repeat").cast("int").alias("repeat"),
            fold.cast("int").alias("fold")]
    if keep_code:
        cols.append(F.col("_code"))
    return j.select(*cols)


def stratification_balance(assigned: DataFrame, k: int = N_FOLDS, code: str = "_code") -> DataFrame:
    """Per (repeat, labelset): rows, and whether its folds' shares and the
    repeat's fold sizes lie within one row of each other."""
    per = assigned.groupBy("repeat", code, "fold").agg(F.count(F.lit(1)).alias("n"))
    sizes = per.groupBy("repeat", "fold").agg(F.sum("n").alias("n")).groupBy("repeat").agg(
        F.count(F.lit(1)).alias("n_folds"), (F.max("n") - F.min("n")).alias("_d"))
    # folds without a row of the labelset count as 0
    sets = per.groupBy("repeat", code).agg(
        F.sum("n").alias("n_rows"), (F.max("n") - F.when(F.count(F.lit(1)) < k, 0).otherwise(F.min("n"))).alias("_s"))
    return sets.join(sizes, "repeat").select(
        "repeat", F.col(code).alias("code"), "n_rows", F.col("n_folds").cast("int").alias("n_folds"),
        (F.col("_s") <= 1).alias("spread_within_one"), (F.col("_d") <= 1).alias("sizes_within_one"))


def label_balance(assigned: DataFrame, dims: Sequence[str] = LABEL_COLS, k: int = N_FOLDS, code: str = "_code") -> DataFrame:
    """Per (repeat, label): positives, the largest distance of a fold's
    positives from an even share, and whether that is at most 5 rows or 2 %
    of the share.  Counts per labelset first, so labels are decoded once."""
    n = len(dims)
    per = assigned.groupBy("repeat", "fold", code).agg(F.count(F.lit(1)).alias("n"))
    bits = ", ".join(f"named_struct('dim', '{d}', 'y', n * (shiftright(greatest({code}, 0L), {n - 1 - i}) & 1))" for i, d in enumerate(dims))
    folds = per.selectExpr("repeat", "fold", f"inline(array({bits}))").groupBy("repeat", "dim", "fold").agg(F.sum("y").alias("y"))
    # a fold without any row is a fold without positives
    low = F.when(F.count(F.lit(1)) < k, F.lit(0)).otherwise(F.min("y"))
    out = folds.groupBy("repeat", "dim").agg(F.sum("y").alias("n_pos"), F.max("y").alias("_hi"), low.alias("_lo"))
    share = F.col("n_pos") / F.lit(float(k))
    worst = F.greatest(F.col("_hi") - share, share - F.col("_lo"))
    return out.select("repeat", "dim", "n_pos", worst.alias("worst"), (worst <= F.greatest(F.lit(5.0), 0.02 * share)).alias("balanced"))
