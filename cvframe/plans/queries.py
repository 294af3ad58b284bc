"""Registered queries (one per operator of SURVEY §2) and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from cvframe.operators import metrics as M
from cvframe.operators import splits as S
from cvframe.plans import fixtures as fx
from cvframe.plans import oracle as O
from cvframe.plans.evaluate import cv_evaluate, per_label_metrics
from cvframe.plans.registry import register
from cvframe.schema import LABEL_COLS, TREE

L = LABEL_COLS


def _gold(spark, sf):
    return fx.gold(spark, sf)


def _splits(spark, sf):
    return S.assign_splits(_gold(spark, sf))


def _coded_splits(spark, sf):
    return S.assign_splits(_gold(spark, sf), keep_code=True)


def _test_splits(spark, sf):
    """TEST cells only (equal to ``_splits`` filtered to TEST; the oracle
    checks that against the full split table)."""
    return S.test_split(_gold(spark, sf), keep_code=True)


def _per_label(spark, sf):
    return per_label_metrics(fx.preds(spark, sf), _gold(spark, sf), _test_splits(spark, sf))


def _r6(x: str) -> str:
    return f"round({x}, 6)"


WITH_SPLITS = "WITH " + O.splits_with() + "\n"
WITH_EVAL = WITH_SPLITS.rstrip() + ",\n" + ",\n".join([O.preds_cte(), O.pred01_cte(), O.confusion_cte(), O.macro_cte()]) + "\n"

# --------------------------------------------------------------------------- splits


@register(
    "labelset_counts",
    "WITH " + O.corpus_cte() + f"\nSELECT concat({', '.join(f'CAST({c} AS VARCHAR)' for c in L)}) AS labelset, "
    "count(*) AS n FROM corpus GROUP BY 1",
)
def q_labelset_counts(spark, sf):
    return S.labelset_counts(_gold(spark, sf))


@register("ms_kfold", "WITH " + ",\n".join([O.corpus_cte(), O.seeds_cte(), O.kfold_cte()]) + "\nSELECT * FROM kfold")
def q_ms_kfold(spark, sf):
    return S.ms_kfold(_gold(spark, sf))


@register(
    "ms_holdout",
    "WITH " + O.corpus_cte() + f"""
SELECT post_id, CASE WHEN (row_number() OVER (ORDER BY {O.LABEL_ORDER}, md5('42:' || CAST(post_id AS VARCHAR)),
       post_id) - 1) % 8 = 0 THEN 'VALID' ELSE 'TRAIN' END AS split FROM corpus""",
)
def q_ms_holdout(spark, sf):
    return S.ms_holdout(_gold(spark, sf))


@register("assign_splits", WITH_SPLITS + "SELECT * FROM splits")
def q_assign_splits(spark, sf):
    return _splits(spark, sf)


@register(
    "splits_wide",
    WITH_SPLITS
    + "SELECT post_id, "
    + ", ".join(
        f"max(CASE WHEN repeat = {r} AND fold = {f} THEN split END) AS fold{r}_{f}" for r in range(5) for f in range(5)
    )
    + " FROM splits GROUP BY post_id",
)
def q_splits_wide(spark, sf):
    return S.assign_splits_wide(_gold(spark, sf))


@register("iterative_stratify")
def q_iterative_stratify(spark, sf):
    return S.iterative_stratify(_gold(spark, sf))


def _d5_sql() -> str:
    """What must hold of any stratified assignment: per cell the fold's size
    is within one of a fifth of the corpus, and each labelset's rows in it
    within one of a fifth of the labelset."""
    return ("WITH " + O.corpus_cte() + f""",
sets AS (SELECT {O.CODE_SQL} AS code, count(*) AS n FROM corpus c GROUP BY 1)
SELECT CAST(r.range AS INTEGER) AS repeat, s.code, s.n AS n_rows, 5 AS n_folds, TRUE AS spread_within_one, TRUE AS sizes_within_one
FROM sets s CROSS JOIN range(5) r""")


@register("iterative_stratify_balance", _d5_sql())
def q_iterative_stratify_balance(spark, sf):
    assigned = S.iterative_stratify(_gold(spark, sf), keep_code=True)
    return S.stratification_balance(assigned)


def _d5_labels_sql() -> str:
    """Per repeat and label the positives, whose folds' shares D5 must keep even."""
    parts = " UNION ALL ".join(f"SELECT '{d}' AS dim, CAST(sum({d}) AS BIGINT) AS n_pos FROM corpus" for d in L)
    return ("WITH " + O.corpus_cte() + f""",
pos AS ({parts})
SELECT CAST(r.range AS INTEGER) AS repeat, dim, n_pos, TRUE AS balanced FROM pos CROSS JOIN range(5) r""")


@register("iterative_stratify_labels", _d5_labels_sql())
def q_iterative_stratify_labels(spark, sf):
    return S.label_balance(S.iterative_stratify(_gold(spark, sf), keep_code=True)).drop("worst")


@register(
    "split_filter",
    WITH_SPLITS + "SELECT c.post_id, c.issue FROM corpus c JOIN splits s USING (post_id) "
    "WHERE s.repeat = 2 AND s.fold = 3 AND s.split = 'VALID'",
)
def q_split_filter(spark, sf):
    corpus = fx.corpus(spark, sf)
    return S.split_rows(corpus, S.assign_splits(corpus), 2, 3, "VALID").select("post_id", "issue")


# --------------------------------------------------------------------------- metrics


@register("confusion_counts", WITH_EVAL + "SELECT * FROM conf")
def q_confusion(spark, sf):
    rows = M.test_rows(M.predicted_labels(fx.preds(spark, sf)), _gold(spark, sf), _test_splits(spark, sf))
    return M.confusion_counts(rows)


_PRF_OUT = f"approach, repeat, fold, dim, {_r6('precision')} AS precision, {_r6('recall')} AS recall, " \
           f"{_r6('macro_f1')} AS macro_f1"


@register("macro_prf", WITH_EVAL + f"SELECT {_PRF_OUT} FROM prf")
def q_macro_prf(spark, sf):
    d = _per_label(spark, sf)
    return d.select("approach", "repeat", "fold", "dim",
                    *[F.round(c, 6).alias(c) for c in ("precision", "recall", "macro_f1")])


@register(
    "mean_over_labels",
    WITH_EVAL + "SELECT approach, repeat, fold, round(avg(precision), 6) AS mean_precision, "
    "round(avg(recall), 6) AS mean_recall, round(avg(macro_f1), 6) AS mean_f1 FROM prf GROUP BY 1, 2, 3",
)
def q_mean_over_labels(spark, sf):
    d = M.mean_over_labels(_per_label(spark, sf))
    return d.select("approach", "repeat", "fold", *[F.round(c, 6).alias(c) for c in d.columns[3:]])


def _run_record_sql() -> str:
    cols = []
    for d in L:
        for m, out in (("precision", "precision"), ("recall", "recall"), ("macro_f1", "macroF1")):
            cols.append(f"round(max(CASE WHEN dim = '{d}' THEN {m} END), 6) AS eval_{d}_{out}")
    for m, out in (("precision", "precision"), ("recall", "recall"), ("macro_f1", "F1")):
        cols.append(f"round(avg({m}), 6) AS eval_mean_{out}")
    return WITH_EVAL + "SELECT approach, repeat, fold, " + ", ".join(cols) + " FROM prf GROUP BY 1, 2, 3"


@register("run_record", _run_record_sql())
def q_run_record(spark, sf):
    d = M.run_records(_per_label(spark, sf))
    return d.select("approach", "repeat", "fold", *[F.round(c, 6).alias(c) for c in d.columns[3:]])


@register(
    "best_checkpoint",
    "WITH " + O.history_cte() + """
SELECT approach, repeat, fold, max(CASE WHEN rn = 1 THEN step END) AS best_step, max(score) AS best_score,
       count(*) AS n_evals
FROM (SELECT approach, repeat, fold, step, score,
             row_number() OVER (PARTITION BY approach, repeat, fold ORDER BY score DESC, step) AS rn FROM history)
GROUP BY 1, 2, 3""",
)
def q_best_checkpoint(spark, sf):
    return M.best_checkpoint(fx.history(spark, sf))


# --------------------------------------------------------------------------- flagship


def _cv_evaluate_sql() -> str:
    per = ", ".join(f"avg(CASE WHEN dim = '{d}' THEN macro_f1 END) AS {d}_f1" for d in L)
    mean = " + ".join(f"{d}_f1" for d in L)
    return WITH_EVAL + f""", board AS (SELECT approach, ({mean}) / 14.0 AS mean_f1, * EXCLUDE (approach)
  FROM (SELECT approach, {per} FROM prf GROUP BY approach))
SELECT CAST(row_number() OVER (ORDER BY mean_f1 DESC, approach) AS INTEGER) AS rank, approach,
       round(mean_f1, 4) AS mean_f1, {', '.join(f'round({d}_f1, 4) AS {d}_f1' for d in L)} FROM board"""


@register("cv_evaluate", _cv_evaluate_sql())
def q_cv_evaluate(spark, sf):
    return cv_evaluate(fx.preds(spark, sf), _gold(spark, sf), _test_splits(spark, sf))


# --------------------------------------------------------------------------- text
from cvframe.functions.text import STRIP_PATTERN  # noqa: E402
from cvframe.operators import text as T  # noqa: E402

MAX_LEN = 512
SHUFFLE_SEED = 42
WITH_TOKS = "WITH " + O.corpus_cte() + ",\n" + O.tokens_cte() + "\n"


def _toks(spark, sf):
    return T.tokens_col(fx.corpus(spark, sf).select("post_id", "post_text"), "post_text").select("post_id", "tokens")


def _ids_str(c):
    return F.array_join(F.col(c).cast("array<string>"), ",")


@register(
    "strip_text",
    "WITH " + O.corpus_cte() + f"\nSELECT post_id, regexp_replace(post_text, '{STRIP_PATTERN}', '', 'g') AS text FROM corpus",
)
def q_strip_text(spark, sf):
    c = fx.corpus(spark, sf).select("post_id", "post_text")
    return T.strip_col(c, "post_text", "text").select("post_id", "text")


@register(
    "tokenize_words",
    WITH_TOKS + "SELECT post_id, CAST(len(tokens) AS INTEGER) AS n_tokens, array_to_string(tokens, ' ') AS tokens "
    "FROM toks",
)
def q_tokenize(spark, sf):
    t = _toks(spark, sf)
    return t.select("post_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


@register(
    "shuffle_tokens",
    O.shuffled_sql(SHUFFLE_SEED),
)
def q_shuffle_tokens(spark, sf):
    c = fx.corpus(spark, sf).select("post_id", "post_text")
    return T.shuffle_text(c, "post_text", SHUFFLE_SEED, out="text").select("post_id", "text")


@register(
    "truncate_tokens",
    WITH_TOKS + f"SELECT post_id, CAST(len(tokens[1:{MAX_LEN}]) AS INTEGER) AS n_tokens, "
    f"array_to_string(tokens[1:{MAX_LEN}], ' ') AS tokens FROM toks",
)
def q_truncate(spark, sf):
    t = _toks(spark, sf).select("post_id", T.truncate(F.col("tokens"), MAX_LEN).alias("tokens"))
    return t.select("post_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


def _encoded(spark, sf):
    """Ids of every token of the whole text, from the whole vocabulary."""
    t = _toks(spark, sf)
    return T.encode(t, T.build_vocab(t))


WITH_ENC = WITH_TOKS.rstrip() + ",\n" + O.vocab_cte() + ",\n" + O.encode_cte() + "\n"


@register(
    "encode_ids",
    WITH_ENC + "SELECT post_id, CAST(len(ids) AS INTEGER) AS n_ids, array_to_string(ids, ',') AS ids FROM enc",
)
def q_encode(spark, sf):
    e = _encoded(spark, sf)
    return e.select("post_id", F.size("ids").alias("n_ids"), _ids_str("ids").alias("ids"))


@register(
    "attention_mask",
    WITH_ENC + "SELECT post_id, array_to_string(list_transform(ids, lambda x: 1), ',') AS attention_mask FROM enc",
)
def q_attention_mask(spark, sf):
    t = _toks(spark, sf).withColumn("attention_mask", T.attention_mask(F.col("tokens")))
    return t.select("post_id", _ids_str("attention_mask").alias("attention_mask"))


@register("make_batches", "WITH " + O.corpus_cte() + ",\n" + O.batches_cte() + "\nSELECT * FROM batches")
def q_make_batches(spark, sf):
    return T.make_batches(fx.gold(spark, sf).select("post_id"))


@register(
    "pad_batches",
    WITH_ENC.rstrip() + ",\n" + O.batches_cte() + """,
j AS (SELECT e.post_id, b.batch_id, b.slot, e.ids, len(e.ids) AS n,
             max(len(e.ids)) OVER (PARTITION BY b.batch_id) AS m FROM enc e JOIN batches b USING (post_id))
SELECT post_id, batch_id, slot,
       array_to_string(list_concat(ids, list_transform(range(m - n), lambda x: 0)), ',') AS ids,
       array_to_string(list_concat(list_transform(ids, lambda x: 1), list_transform(range(m - n), lambda x: 0)), ',')
         AS attention_mask
FROM j""",
)
def q_pad_batches(spark, sf):
    e = _encoded(spark, sf)
    # batch order needs only the ids: take them from the id column, not from
    # the encoded rows (which would re-run the encoder for a second branch)
    b = T.make_batches(_gold(spark, sf).select("post_id")).join(e, "post_id")
    p = T.pad_batches(b)
    return p.select("post_id", "batch_id", "slot", _ids_str("ids").alias("ids"),
                    _ids_str("attention_mask").alias("attention_mask"))


@register(
    "pack_labels",
    "WITH " + O.corpus_cte() + "\nSELECT post_id, appropriateness AS label, array_to_string(["
    + ", ".join(f"CAST({c} AS DOUBLE)" for c in L) + "], ',') AS labels FROM corpus",
)
def q_pack_labels(spark, sf):
    g = fx.gold(spark, sf)
    b = T.pack_labels(g, L, "binary", "label")
    m = T.pack_labels(b, L, "multilabel", "labels")
    return m.select("post_id", "label", F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"))


# --------------------------------------------------------------------------- weights and losses
from cvframe.operators import scoring as G  # noqa: E402
from cvframe.operators import weights as W  # noqa: E402


def _pos_weights_sql_body() -> str:
    parts = [
        f"SELECT repeat, fold, '{d}' AS dim, CAST(sum({d}) AS BIGINT) AS n_pos, CAST(count(*) - sum({d}) AS BIGINT) AS n_neg "
        f"FROM splits JOIN corpus USING (post_id) WHERE split = 'TRAIN' GROUP BY repeat, fold"
        for d in L
    ]
    return ("cnt AS (" + " UNION ALL ".join(parts) + "),\n"
            "pw AS (SELECT *, CASE WHEN n_pos > 0 AND CAST(n_neg AS DOUBLE) / n_pos >= 1 "
            "AND CAST(n_neg AS DOUBLE) / n_pos < 'inf'::DOUBLE THEN CAST(n_neg AS DOUBLE) / n_pos ELSE 1.0 END AS weight "
            "FROM cnt)")


@register("pos_weights", WITH_SPLITS.rstrip() + ",\n" + _pos_weights_sql_body() +
          "\nSELECT repeat, fold, dim, n_pos, n_neg, round(weight, 6) AS weight FROM pw")
def q_pos_weights(spark, sf):
    w = W.pos_weights(_gold(spark, sf), _coded_splits(spark, sf))
    return w.withColumn("weight", F.round("weight", 6))


def _loss_sql(kind: str) -> str:
    body = WITH_SPLITS.rstrip() + ",\n" + O.preds_cte() + ",\n"
    body += "tj AS (SELECT * FROM splits s JOIN corpus c USING (post_id) JOIN preds p USING (post_id) WHERE s.split = 'TEST')"
    sp = "(greatest({x}, 0) + ln(1 + exp(-abs({x}))))"
    if kind == "bce":
        body += ",\n" + _pos_weights_sql_body()
        terms = []
        for k, d in enumerate(L):
            x = f"logit_{k}"
            terms.append(
                f"SELECT approach, repeat, fold, (SELECT weight FROM pw WHERE pw.repeat = tj.repeat AND pw.fold = tj.fold "
                f"AND pw.dim = '{d}') * {d} * {sp.format(x='-' + x)} + (1 - {d}) * {sp.format(x=x)} AS l FROM tj")
        return body + "\nSELECT approach, repeat, fold, round(avg(l), 6) AS bce_loss FROM (" + \
            " UNION ALL ".join(terms) + ") GROUP BY 1, 2, 3"
    if kind == "ce":
        return body + """
SELECT approach, repeat, fold,
  round(avg(greatest(-logit_0, logit_0) + ln(exp(-logit_0 - greatest(-logit_0, logit_0))
        + exp(logit_0 - greatest(-logit_0, logit_0))) - CASE WHEN appropriateness = 1 THEN logit_0 ELSE -logit_0 END),
        6) AS ce_loss
FROM tj GROUP BY 1, 2, 3"""
    terms = [f"SELECT approach, repeat, fold, (logit_{k} - {d}) * (logit_{k} - {d}) AS l FROM tj" for k, d in enumerate(L)]
    return body + "\nSELECT approach, repeat, fold, round(avg(l), 6) AS mse_loss FROM (" + \
        " UNION ALL ".join(terms) + ") GROUP BY 1, 2, 3"


@register("bce_loss", _loss_sql("bce"))
def q_bce(spark, sf):
    g, s = _gold(spark, sf), _coded_splits(spark, sf)
    d = W.bce_loss(fx.preds(spark, sf), g, s, W.pos_weights(g, s))
    return d.withColumn("bce_loss", F.round("bce_loss", 6))


@register("cross_entropy", _loss_sql("ce"))
def q_ce(spark, sf):
    d = W.cross_entropy(fx.preds(spark, sf), _gold(spark, sf), _test_splits(spark, sf))
    return d.withColumn("ce_loss", F.round("ce_loss", 6))


@register("mse_loss", _loss_sql("mse"))
def q_mse(spark, sf):
    d = W.mse_loss(fx.preds(spark, sf), _gold(spark, sf), _test_splits(spark, sf))
    return d.withColumn("mse_loss", F.round("mse_loss", 6))


# --------------------------------------------------------------------------- scoring and repair
EMB_DIM = 64
# linear-head parameters of the synthetic scorer (a rule, not data)
HEAD_COEF = [[((k + 1) * (j + 1) % 7 - 3) / 4.0 for j in range(EMB_DIM)] for k in range(len(L))]
HEAD_BIAS = [(k - 7) / 10.0 for k in range(len(L))]


def _linear_head_sql() -> str:
    cols = []
    for k in range(len(L)):
        cols.append(
            f"round(list_reduce(list_transform(embedding, lambda x, j: CAST(x AS DOUBLE) * "
            f"((({k + 1} * j) % 7 - 3) / 4.0)), lambda a, b: a + b, CAST(0.0 AS DOUBLE)) + {HEAD_BIAS[k]!r}, 6) "
            f"AS logit_{k}")
    return "SELECT vec_id, " + ", ".join(cols) + " FROM embeddings"


@register("linear_head", _linear_head_sql())
def q_linear_head(spark, sf):
    emb = fx.table(spark, sf, "embeddings", ["vec_id", "embedding"])
    d = G.score_linear(emb, "embedding", HEAD_COEF, HEAD_BIAS)
    return d.select("vec_id", *[F.round(f"logit_{k}", 6).alias(f"logit_{k}") for k in range(len(L))])


WITH_PREDS = "WITH " + O.corpus_cte() + ",\n" + O.preds_cte() + "\n"


@register("sigmoid_probs", WITH_PREDS + "SELECT approach, post_id, " + ", ".join(
    f"round(1.0 / (1.0 + exp(-logit_{k})), 6) AS prob_{d}" for k, d in enumerate(L)) + " FROM preds")
def q_sigmoid(spark, sf):
    p = G.probabilities(fx.preds(spark, sf))
    return p.select("approach", "post_id", *[F.round(f"prob_{d}", 6).alias(f"prob_{d}") for d in L])


@register("threshold_labels", WITH_PREDS.rstrip() + ",\n" + O.pred01_cte() + "\nSELECT * FROM p01")
def q_threshold(spark, sf):
    return G.thresholded(fx.preds(spark, sf))


@register("argmax_label", WITH_PREDS + "SELECT approach, post_id, CASE WHEN logit_0 > -logit_0 THEN 1 ELSE 0 END "
          "AS label FROM preds")
def q_argmax(spark, sf):
    return G.binary_label(fx.preds(spark, sf).select("approach", "post_id", "logit_0")).drop("logit_0")


def _repair_sql(mode: str) -> str:
    k = {d: i for i, d in enumerate(L)}
    p = {d: f"(CASE WHEN logit_{k[d]} > 0 THEN 1 ELSE 0 END)" for d in L}
    x = {d: f"logit_{k[d]}" for d in L}
    root = "appropriateness"
    cols = [f"{p[root]} AS pred_{root}"]
    for parent, kids in TREE.items():
        gate = f"({p[root]} = 1 AND {p[parent]} = 1)"
        cols.append(f"CASE WHEN {gate} THEN 1 ELSE 0 END AS pred_{parent}")
        none = " AND ".join(f"{p[c]} = 0" for c in kids)
        if mode == "reference" and len(kids) == 3:
            a, b, _ = kids
            pick = {a: f"{x[a]} >= {x[b]}", b: f"{x[b]} > {x[a]}", kids[2]: "FALSE"}
        else:
            pick = {}
            for j, c in enumerate(kids):
                conds = [f"{x[c]} > {x[o]}" for o in kids[:j]] + [f"{x[c]} >= {x[o]}" for o in kids[j + 1:]]
                pick[c] = " AND ".join(conds)
        for c in kids:
            cols.append(f"CASE WHEN NOT {gate} THEN 0 WHEN {none} THEN (CASE WHEN {pick[c]} THEN 1 ELSE 0 END) "
                        f"ELSE {p[c]} END AS pred_{c}")
    return WITH_PREDS + "SELECT approach, post_id, " + ", ".join(cols) + " FROM preds"


@register("repair_hierarchy_ref", _repair_sql("reference"))
def q_repair_ref(spark, sf):
    return G.repair(fx.preds(spark, sf), "reference")


@register("repair_hierarchy", _repair_sql("corrected"))
def q_repair(spark, sf):
    return G.repair(fx.preds(spark, sf), "corrected")


# --------------------------------------------------------------------------- runs and reports
from cvframe.operators import runs as R  # noqa: E402
from cvframe.operators import stats as J  # noqa: E402
from cvframe.sources import runs_io as RIO  # noqa: E402

RUN_METRICS = ["mean_F1", "even_macroF1", "even_precision", "coarse_macroF1"]
HEADLINE = "mean_F1"
WITH_RUNS = "WITH " + O.runs_cte() + "\n"
_DEC2 = "CAST(CAST(CAST({x} AS DECIMAL(18,6)) AS DECIMAL(18,2)) AS {t})"


def _runs(spark, sf):
    return fx.runs(spark, sf)


def _wide_means(spark, sf):
    return R.pivot_runs(R.summarise(_runs(spark, sf), "mean"), RUN_METRICS)


def _wide_sql(src: str = "runs") -> str:
    cols = ", ".join(f"max(CASE WHEN metric = '{m}' THEN v END) AS {m}" for m in RUN_METRICS)
    return f"wide AS (SELECT approach, {cols} FROM (SELECT approach, metric, avg(value) AS v FROM {src} " \
           f"GROUP BY 1, 2) GROUP BY approach)"


@register("mean_runs", WITH_RUNS + "SELECT approach, metric, round(avg(value), 6) AS value, count(*) AS n_runs "
          "FROM runs GROUP BY 1, 2")
def q_mean_runs(spark, sf):
    return R.summarise(_runs(spark, sf), "mean").withColumn("value", F.round("value", 6))


@register("std_runs", WITH_RUNS + "SELECT approach, metric, round(stddev_pop(value), 6) AS value, "
          "count(*) AS n_runs FROM runs GROUP BY 1, 2")
def q_std_runs(spark, sf):
    return R.summarise(_runs(spark, sf), "std").withColumn("value", F.round("value", 6))


@register("metric_filter", WITH_RUNS + "SELECT approach, repeat, fold, metric, round(value, 6) AS value FROM runs "
          "WHERE metric LIKE '%F1%'")
def q_metric_filter(spark, sf):
    return R.f1_metrics(_runs(spark, sf)).withColumn("value", F.round("value", 6))


@register("pivot_runs", WITH_RUNS.rstrip() + ",\n" + _wide_sql() + "\nSELECT approach, " +
          ", ".join(f"round({m}, 6) AS {m}" for m in RUN_METRICS) + " FROM wide")
def q_pivot_runs(spark, sf):
    w = _wide_means(spark, sf)
    return w.select("approach", *[F.round(m, 6).alias(m) for m in RUN_METRICS])


REPORT = ["approach", "mean_F1", "even_macroF1", "coarse_macroF1"]


@register("metric_projection", WITH_RUNS.rstrip() + ",\n" + _wide_sql() + "\nSELECT approach, " +
          ", ".join(f"round({m}, 6) AS {m}" for m in REPORT[1:]) + " FROM wide")
def q_metric_projection(spark, sf):
    w = R.report_columns(_wide_means(spark, sf), REPORT)
    return w.select("approach", *[F.round(m, 6).alias(m) for m in REPORT[1:]])


def _records(spark, sf):
    """Long run records of the engine's own evaluation."""
    return RIO.runs_long(M.run_records(_per_label(spark, sf)))


@register("record_metric_filter", WITH_EVAL + " UNION ALL ".join(
    [f"SELECT approach, repeat, fold, '{d}_macroF1' AS metric, round(macro_f1, 6) AS value FROM prf WHERE dim = '{d}'" for d in L]
    + ["SELECT approach, repeat, fold, 'mean_F1', round(avg(macro_f1), 6) FROM prf GROUP BY 1, 2, 3"]))
def q_record_metric_filter(spark, sf):
    return R.f1_metrics(_records(spark, sf)).withColumn("value", F.round("value", 6))


@register("study_report", WITH_EVAL + "SELECT approach, round(avg(macro_f1), 6) AS \"mean_F1\", " + ", ".join(
    f"round(avg(CASE WHEN dim = '{d}' THEN macro_f1 END), 6) AS \"{d}_macroF1\"" for d in L) + " FROM prf GROUP BY 1")
def q_study_report(spark, sf):
    d = R.study_report(_records(spark, sf))
    return d.select("approach", *[F.round(c, 6).alias(c) for c in d.columns[1:]])


@register("leaderboard", WITH_RUNS.rstrip() + ",\n" + _wide_sql() + f"""
SELECT CAST(row_number() OVER (ORDER BY {HEADLINE} DESC NULLS LAST, approach) AS INTEGER) AS rank, approach, """ +
          ", ".join(f"round({m}, 4) AS {m}" for m in RUN_METRICS) + " FROM wide")
def q_leaderboard(spark, sf):
    return R.leaderboard(_wide_means(spark, sf), HEADLINE)


@register("best_in_column", WITH_RUNS + f"""SELECT approach, metric, shown, shown = max(shown) OVER (PARTITION BY metric)
  AS is_best FROM (SELECT approach, metric, {_DEC2.format(x='avg(value)', t='DOUBLE')} AS shown FROM runs GROUP BY 1, 2)""")
def q_best_in_column(spark, sf):
    return R.mark_best(R.summarise(_runs(spark, sf), "mean")).select("approach", "metric", "shown", "is_best")


@register("latex_rows", WITH_RUNS.rstrip() + ",\n" + _wide_sql() + f"""
SELECT CAST(row_number() OVER (ORDER BY {HEADLINE} DESC NULLS LAST, approach) AS INTEGER) AS rank,
  replace(approach, '_', '\\_') || ' & ' || """ + " || ' & ' || ".join(
    f"coalesce({_DEC2.format(x=m, t='VARCHAR')}, '--')" for m in RUN_METRICS) + " || ' \\\\' AS line FROM wide")
def q_latex_rows(spark, sf):
    board = R.leaderboard(_wide_means(spark, sf), HEADLINE, digits=12)
    return R.latex_lines(board, RUN_METRICS)


_BEST = [(f"{_DEC2.format(x=m, t='VARCHAR')}", f"{_DEC2.format(x=m, t='DOUBLE')}") for m in RUN_METRICS]


@register("latex_rows_best", WITH_RUNS.rstrip() + ",\n" + _wide_sql() + f"""
SELECT CAST(row_number() OVER (ORDER BY {HEADLINE} DESC NULLS LAST, approach) AS INTEGER) AS rank,
  replace(approach, '_', '\\_') || ' & ' || """ + " || ' & ' || ".join(
    f"coalesce(CASE WHEN {d} = max({d}) OVER () THEN '\\textbf{{' || {t} || '}}' ELSE {t} END, '--')" for t, d in _BEST)
    + " || ' \\\\' AS line FROM wide")
def q_latex_rows_best(spark, sf):
    board = R.leaderboard(_wide_means(spark, sf), HEADLINE, digits=12)
    return R.latex_lines(board, RUN_METRICS, best="textbf")


@register("score_vectors", WITH_RUNS + "SELECT approach, metric, string_agg(CAST(CAST(value AS DECIMAL(18,6)) AS "
          "VARCHAR), ',' ORDER BY repeat, fold) AS scores FROM runs GROUP BY 1, 2")
def q_score_vectors(spark, sf):
    v = R.score_vectors(_runs(spark, sf))
    return v.select("approach", "metric", F.array_join(
        F.transform("scores", lambda x: x.cast("decimal(18,6)").cast("string")), ",").alias("scores"))


# --------------------------------------------------------------------------- significance
_PAIRS_SQL = """pairs AS (SELECT a.metric, a.approach AS approach_a, b.approach AS approach_b, a.repeat, a.fold,
  a.value AS value_a, b.value AS value_b FROM runs a JOIN runs b
  ON a.metric = b.metric AND a.repeat = b.repeat AND a.fold = b.fold AND a.approach < b.approach)"""
_RANKS_SQL = """nz AS (SELECT *, value_a - value_b AS d, abs(value_a - value_b) AS ad FROM pairs WHERE value_a <> value_b),
ranked AS (SELECT *, CAST(2 * rank() OVER (PARTITION BY metric, approach_a, approach_b ORDER BY ad)
  + count(*) OVER (PARTITION BY metric, approach_a, approach_b, ad) - 1 AS INTEGER) AS r2 FROM nz),
grp AS (SELECT metric, approach_a, approach_b, count(*) AS n,
  sum(CASE WHEN d > 0 THEN r2 ELSE 0 END) AS w2p, sum(CASE WHEN d < 0 THEN r2 ELSE 0 END) AS w2m,
  CAST(sum(r2) AS BIGINT) AS s, list([r2] ORDER BY r2) AS ranks FROM ranked GROUP BY 1, 2, 3),
allp AS (SELECT metric, approach_a, approach_b, count(*) AS n_pairs FROM pairs GROUP BY 1, 2, 3),
sr AS (SELECT p.metric, p.approach_a, p.approach_b, n_pairs, CAST(coalesce(n, 0) AS BIGINT) AS n,
  coalesce(w2p, 0) / 2.0 AS w_plus, coalesce(w2m, 0) / 2.0 AS w_minus,
  least(coalesce(w2p, 0), coalesce(w2m, 0)) / 2.0 AS t_stat, s, ranks
  FROM allp p LEFT JOIN grp g USING (metric, approach_a, approach_b)),
dp AS (SELECT *, CASE WHEN n > 0 THEN list_reduce(ranks, lambda acc, x: list_transform(acc, lambda v, i:
  v + CASE WHEN i - 1 >= x[1] THEN acc[i - x[1]] ELSE 0 END),
  list_concat([CAST(1 AS BIGINT)], list_transform(range(s), lambda z: CAST(0 AS BIGINT)))) END AS acc FROM sr),
wx AS (SELECT *, CASE WHEN n > 0 THEN least(1.0, 2.0 * list_sum(acc[1:CAST(t_stat * 2 AS INTEGER) + 1])
  / pow(2.0, n)) END AS p_value FROM dp)"""
WITH_F1_RUNS = WITH_RUNS.rstrip() + ",\nf1runs AS (SELECT * FROM runs WHERE metric LIKE '%F1%'),\n" + \
    _PAIRS_SQL.replace("FROM runs a JOIN runs b", "FROM f1runs a JOIN f1runs b") + ",\n" + _RANKS_SQL + "\n"
_SR_COLS = "metric, approach_a, approach_b, n_pairs, n, w_plus, w_minus, t_stat"


def _f1_pairs(spark, sf):
    return J.approach_pairs(R.f1_metrics(_runs(spark, sf)))


@register("approach_pairs", WITH_RUNS.rstrip() + ",\n" + _PAIRS_SQL + """
SELECT metric, approach_a, approach_b, repeat, fold, round(value_a, 6) AS value_a, round(value_b, 6) AS value_b
FROM pairs""")
def q_pairs(spark, sf):
    p = J.approach_pairs(_runs(spark, sf))
    return p.select("metric", "approach_a", "approach_b", "repeat", "fold", F.round("value_a", 6).alias("value_a"),
                    F.round("value_b", 6).alias("value_b"))


@register("signed_rank", WITH_F1_RUNS + f"SELECT {_SR_COLS} FROM sr")
def q_signed_rank(spark, sf):
    return J.signed_rank(_f1_pairs(spark, sf)).drop("_ranks")


@register("wilcoxon_p", WITH_F1_RUNS + f"SELECT {_SR_COLS}, round(p_value, 9) AS p_value FROM wx")
def q_wilcoxon(spark, sf):
    return J.wilcoxon(_f1_pairs(spark, sf)).withColumn("p_value", F.round("p_value", 9))


@register("significant_pairs", WITH_F1_RUNS + f"SELECT {_SR_COLS}, round(p_value, 9) AS p_value, "
          "p_value <= 0.5 AS significant FROM wx")
def q_significant(spark, sf):
    t = J.significant_pairs(J.wilcoxon(_f1_pairs(spark, sf)), alpha=0.5)
    return t.withColumn("p_value", F.round("p_value", 9))


# --------------------------------------------------------------------------- sources and sinks
from cvframe.session import scratch_dir, written  # noqa: E402
from cvframe.sources import corpus_io as C  # noqa: E402

_LAB = ", ".join(L)


def _variants_sql() -> str:
    ctes = ",\n".join(O.corpus_cte(v, f"c_{v}") for v in ("full", "majority", "conservative"))
    sel = " UNION ALL ".join(f"SELECT '{v}' AS dataset_version, post_id, {_LAB} FROM c_{v}"
                             for v in ("full", "majority", "conservative"))
    return "WITH " + ctes + "\n" + sel


def _variants(spark, sf):
    docs = fx.table(spark, sf, "documents", ["doc_id", "source", "text"])
    return C.union_variants({v: fx.corpus_from_documents(docs, v) for v in ("full", "majority", "conservative")})


@register("scan_corpus_csv", "WITH " + O.corpus_cte() + "\nSELECT * FROM corpus")
def q_scan_corpus_csv(spark, sf):
    path = scratch_dir(spark, "corpus-csv")
    C.write_corpus_csv(fx.corpus(spark, sf), path)
    return C.read_corpus(spark, path)


@register("scan_corpus_csv_split", "WITH " + O.corpus_cte() + "\nSELECT * FROM corpus")
def q_scan_corpus_csv_split(spark, sf):
    path = scratch_dir(spark, "corpus-csv")
    C.write_corpus_csv(fx.corpus(spark, sf), path)
    return C.read_corpus(spark, path, split=True)


@register("union_variants", _variants_sql())
def q_union_variants(spark, sf):
    return _variants(spark, sf).select("dataset_version", "post_id", *L)


@register("sink_corpus", _variants_sql())
def q_sink_corpus(spark, sf):
    path = scratch_dir(spark, "corpus-parquet")
    C.write_corpus(_variants(spark, sf).select("dataset_version", "post_id", *L), path)
    return spark.read.parquet(path).select("dataset_version", "post_id", *L)


def _wide_runs_sql() -> str:
    cols = ", ".join(f"max(CASE WHEN metric = '{m}' THEN value END) AS eval_{m}" for m in RUN_METRICS)
    return f"SELECT approach, repeat, fold, {cols} FROM runs GROUP BY 1, 2, 3"


@register("scan_run_results", WITH_RUNS + "SELECT approach, repeat, fold, metric, round(value, 6) AS value FROM runs")
def q_scan_runs(spark, sf):
    wide = _runs(spark, sf).withColumn("metric", F.concat(F.lit("eval_"), "metric"))
    wide = wide.groupBy("approach", "repeat", "fold").pivot("metric", [f"eval_{m}" for m in RUN_METRICS]) \
        .agg(F.first("value"))
    path = scratch_dir(spark, "runs-json")
    RIO.write_runs(wide, path)
    back = RIO.read_runs(spark, path)
    return back.select("approach", "repeat", "fold", "metric", F.round("value", 6).alias("value"))


@register("sink_run_results", _run_record_sql())
def q_sink_runs(spark, sf):
    rec = M.run_records(_per_label(spark, sf))
    path = scratch_dir(spark, "run-records")
    RIO.write_runs(rec, path)
    back = RIO.read_runs_wide(spark, path).withColumn("approach", F.col("approach").cast("int"))
    return back.select("approach", "repeat", "fold", *[F.round(c, 6).alias(c) for c in rec.columns[3:]])


def _latex_sql() -> str:
    header = ["approach", *RUN_METRICS]
    head = [r"\begin{tabular}{l" + "r" * (len(header) - 1) + "}", r"\toprule",
            " & ".join(h.replace("_", r"\_") for h in header) + r" \\", r"\midrule"]
    foot = [r"\bottomrule", r"\end{tabular}"]
    parts = [f"SELECT {i} AS line_no, '{s}' AS line" for i, s in enumerate(head)]
    parts += [f"SELECT (SELECT count(*) FROM wide) + {len(head) + i}, '{s}'" for i, s in enumerate(foot)]
    body = "replace(approach, '_', '\\_') || ' & ' || " + " || ' & ' || ".join(
        f"coalesce({_DEC2.format(x=m, t='VARCHAR')}, '--')" for m in RUN_METRICS) + " || ' \\\\'"
    parts.append(f"SELECT {len(head) - 1} + row_number() OVER (ORDER BY {HEADLINE} DESC NULLS LAST, approach), {body} FROM wide")
    return (WITH_RUNS.rstrip() + ",\n" + _wide_sql() + "\nSELECT CAST(line_no AS INTEGER) AS line_no, line FROM ("
            + " UNION ALL ".join(parts) + ")")


@register("sink_latex", _latex_sql())
def q_sink_latex(spark, sf):
    board = R.leaderboard(_wide_means(spark, sf), HEADLINE, digits=12)
    table = R.latex_table(R.latex_lines(board, RUN_METRICS), ["approach", *RUN_METRICS])
    path = scratch_dir(spark, "latex")
    RIO.write_latex(table, path)
    return RIO.read_lines(spark, path)


# --------------------------------------------------------------------------- reshapes
@register("label_vector", "WITH " + O.corpus_cte() + "\nSELECT post_id, array_to_string([" + _LAB +
          "], ',') AS labels FROM corpus")
def q_label_vector(spark, sf):
    v = C.label_vector(_gold(spark, sf))
    return v.select("post_id", F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"))


_OLD = {"intelligibility": "clarity", "intelligible_position": "clear_position",
        "intelligible_relevance": "clear_relevance", "intelligible_organization": "clear_organization"}


@register("rename_labels", "WITH " + O.corpus_cte() + "\nSELECT post_id, " + ", ".join(_OLD) + " FROM corpus")
def q_rename_labels(spark, sf):
    old = _gold(spark, sf).withColumnsRenamed(_OLD)  # the corpus as first published
    return C.rename_labels(old).select("post_id", *_OLD)


@register("arg_issue", "WITH " + O.corpus_cte() + "\nSELECT post_id, issue || ' ' || post_text AS arg_issue FROM corpus")
def q_arg_issue(spark, sf):
    return C.with_arg_issue(fx.corpus(spark, sf)).select("post_id", "arg_issue")


@register("text_choice", "WITH " + O.corpus_cte() + "\nSELECT post_id, TRUE AS with_issue, issue || ' ' || post_text "
          "AS text FROM corpus UNION ALL SELECT post_id, FALSE, post_text FROM corpus")
def q_text_choice(spark, sf):
    # both choices from one pass over the corpus
    both = F.array(*[F.struct(F.lit(w).alias("with_issue"), C.chosen_text(w).alias("text")) for w in (True, False)])
    return fx.corpus(spark, sf).select("post_id", F.inline(both))


@register("melt_labels", "WITH " + O.corpus_cte() + "\n" + " UNION ALL ".join(
    f"SELECT post_id, '{d}' AS dim, {d} AS y FROM corpus" for d in L))
def q_melt(spark, sf):
    return C.melt(_gold(spark, sf), ["post_id"])


# --------------------------------------------------------------------------- grid and baselines
from cvframe.operators import grid as K  # noqa: E402

ABLATION_NAMES = list(K.ABLATIONS)


@register("cv_grid", WITH_SPLITS + "SELECT a.approach, s.* FROM (SELECT repeat, fold, "
          "count(CASE WHEN split = 'TRAIN' THEN 1 END) AS n_train, count(CASE WHEN split = 'VALID' THEN 1 END) "
          "AS n_valid, count(CASE WHEN split = 'TEST' THEN 1 END) AS n_test FROM splits GROUP BY 1, 2) s CROSS JOIN "
          "(VALUES " + ", ".join(f"('{a}')" for a in ABLATION_NAMES) + ") a(approach)")
def q_cv_grid(spark, sf):
    return K.cv_grid(_splits(spark, sf), ABLATION_NAMES)


def _ablation_sql() -> str:
    from cvframe.functions.text import STRIP_PATTERN, TOKEN_PATTERN

    def strip(x: str) -> str:
        return "regexp_replace(" + x + ", '" + STRIP_PATTERN + "', '', 'g')"

    arg = "issue || ' ' || post_text"
    toks = f"argtoks AS (SELECT post_id, regexp_extract_all({strip(arg)}, '{TOKEN_PATTERN}') AS tokens FROM corpus)"
    return ("WITH RECURSIVE " + O.corpus_cte() + ",\n" + toks + ",\n" + O.shuffled_cte(42, "argtoks")
            + f"\nSELECT 'with_issue' AS approach, post_id, {strip(arg)} AS text "
            f"FROM corpus UNION ALL SELECT 'wo_issue', post_id, {strip('post_text')} FROM corpus "
            f"UNION ALL SELECT 'shuffle', post_id, text FROM shuffled")


@register("ablation_grid", _ablation_sql())
def q_ablation_grid(spark, sf):
    return K.ablations(fx.corpus(spark, sf), seed=42)


def _baseline_sql(kind: str) -> str:
    base = WITH_SPLITS.rstrip() + ",\n"
    if kind == "majority":
        base += "cnt AS (" + " UNION ALL ".join(
            f"SELECT repeat, fold, '{d}' AS dim, sum({d}) AS n_pos, count(*) - sum({d}) AS n_neg FROM splits "
            f"JOIN corpus USING (post_id) WHERE split = 'TRAIN' GROUP BY 1, 2" for d in L) + "),\n"
        base += "maj AS (SELECT repeat, fold, dim, CASE WHEN n_pos > n_neg THEN 1 ELSE 0 END AS majority FROM cnt),\n"
        pred = "m_{d}"
        base += ("majw AS (SELECT repeat, fold, " + ", ".join(f"max(CASE WHEN dim = '{d}' THEN majority END) AS m_{d}" for d in L)
                 + " FROM maj GROUP BY 1, 2),\n")
    else:
        pred = "CAST(('0x' || substr(md5('random:' || CAST(c.post_id AS VARCHAR) || ':{d}'), 1, 1))::INTEGER % 2 AS INTEGER)"
    extra = "JOIN majw USING (repeat, fold) " if kind == "majority" else ""
    parts = [
        f"SELECT repeat, fold, '{d}' AS dim, CAST(sum(c.{d} * p) AS BIGINT) AS tp, CAST(sum((1 - c.{d}) * p) AS BIGINT) AS fp,"
        f" CAST(sum(c.{d} * (1 - p)) AS BIGINT) AS fn, CAST(sum((1 - c.{d}) * (1 - p)) AS BIGINT) AS tn FROM "
        f"(SELECT repeat, fold, c.{d}, {pred.format(d=d)} AS p FROM splits s JOIN corpus c USING (post_id) {extra}"
        f"WHERE s.split = 'TEST') c GROUP BY 1, 2" for d in L]
    base += "conf AS (" + " UNION ALL ".join(parts) + "),\n" + O.macro_cte() + "\n"
    out = "SELECT repeat, fold, dim, round(precision, 6) AS precision, round(recall, 6) AS recall, " \
          "round(macro_f1, 6) AS macro_f1"
    if kind == "majority":
        return base + out + ", majority FROM prf JOIN maj USING (repeat, fold, dim)"
    return base + out + " FROM prf"


def _rounded(d):
    return d.select(*[F.round(c, 6).alias(c) if c in ("precision", "recall", "macro_f1") else F.col(c)
                      for c in d.columns])


@register("majority_baseline", _baseline_sql("majority"))
def q_majority(spark, sf):
    return _rounded(K.majority_baseline(_gold(spark, sf), _coded_splits(spark, sf)))


@register("random_baseline", _baseline_sql("random"))
def q_random(spark, sf):
    return _rounded(K.random_baseline(_gold(spark, sf), _test_splits(spark, sf)))


# --------------------------------------------------------------------------- training
from cvframe.operators import training as TR  # noqa: E402

TRAIN_DIMS = ["quality", "toxic"]
APPROACH = "logistic"


def _labelled_sql(select: str) -> str:
    """Split table of the labelled documents, stated over their two labels."""
    src = "lt AS (SELECT d.doc_id AS post_id, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id))"
    code = "(CAST(c.quality AS BIGINT) * 2 + CAST(c.toxic AS BIGINT))"
    kf = f"""kfold AS (SELECT c.post_id, CAST(s.repeat AS INTEGER) AS repeat,
  CAST((row_number() OVER (PARTITION BY s.repeat ORDER BY md5(s.seed || ':' || CAST({code} AS VARCHAR)), {code},
        md5(s.seed || ':' || CAST(c.post_id AS VARCHAR)), c.post_id) - 1) % 5 AS INTEGER) AS fold FROM lt c CROSS JOIN seeds s)"""
    holdout = O.splits_cte("lt").replace(", ".join("c." + x for x in L), "c.quality, c.toxic")
    return "WITH " + ",\n".join([src, O.seeds_cte(), kf, holdout]) + "\n" + select


@fx.memo
def _training_rows(spark, sf):
    """The labelled documents with terms, both labels and packed splits, read once for all cells."""
    lt = fx.labelled_text(spark, sf).withColumnRenamed("doc_id", "post_id")
    lt = C.with_arg_issue(lt.withColumnsRenamed({"source": "issue", "text": "post_text"}), "text")
    bits = S.cell_bits(lt.select("post_id", *TRAIN_DIMS), dims=TRAIN_DIMS)
    return TR.training_rows(lt, bits, TRAIN_DIMS, keep=TRAIN_DIMS)


@fx.memo
def _model(spark, sf, kind):
    """All 25 cells in one fit: K1 on the first label, unweighted; K2 on both
    with the positive weights of each cell.  Fitted once a session."""
    rows = _training_rows(spark, sf)
    if kind == "binary":
        return TR.train(rows, TRAIN_DIMS[:1], approach=APPROACH)
    return TR.train(rows, TRAIN_DIMS, "clamped", approach=APPROACH)


def _scored(spark, sf, kind, splits, keep):
    scored = TR.predict(_model(spark, sf, kind), _training_rows(spark, sf), splits, ["post_id", *keep])
    return scored.withColumn("approach", F.lit(APPROACH))


def _binary_scores():
    return [F.expr("CASE WHEN logit_0 > 0 THEN 1 ELSE 0 END").alias("prediction"), F.expr("1 / (1 + exp(-logit_0))").alias("prob")]


@register("train_binary")
def q_train_binary(spark, sf):
    p = _scored(spark, sf, "binary", ("TEST",), ["quality"])
    return p.select("approach", "repeat", "fold", "post_id", "quality", *_binary_scores())


CELL_KEYS = f"SELECT '{APPROACH}' AS approach, repeat, fold, post_id, "


@register("train_binary_cells_rows", _labelled_sql(
    CELL_KEYS + "quality, TRUE AS scored FROM splits JOIN lt USING (post_id) WHERE split = 'TEST'"))
def q_train_binary_cells_rows(spark, sf):
    p = q_train_binary(spark, sf)
    return p.select("approach", "repeat", "fold", "post_id", "quality",
                    (F.col("prediction").isin(0, 1) & F.col("prob").between(0, 1)).alias("scored"))


@register("batch_predict")
def q_batch_predict(spark, sf):
    p = _scored(spark, sf, "binary", ("VALID", "TEST"), [])
    return p.select("approach", "repeat", "fold", "post_id", *_binary_scores(), "split")


@register("batch_predict_cells_rows", _labelled_sql(
    CELL_KEYS + "split, TRUE AS scored FROM splits WHERE split <> 'TRAIN'"))
def q_batch_predict_cells_rows(spark, sf):
    p = q_batch_predict(spark, sf)
    return p.select("approach", "repeat", "fold", "post_id", "split",
                    (F.col("prediction").isin(0, 1) & F.col("prob").between(0, 1)).alias("scored"))


@register("train_multilabel")
def q_train_multilabel(spark, sf):
    p = _scored(spark, sf, "multilabel", ("TEST",), TRAIN_DIMS)
    pred = [F.expr(f"CASE WHEN logit_{k} > 0 THEN 1 ELSE 0 END").alias(f"pred_{d}") for k, d in enumerate(TRAIN_DIMS)]
    return p.select("approach", "repeat", "fold", "post_id", *TRAIN_DIMS, *pred, "logit_0", "logit_1")


@register("train_multilabel_cells_rows", _labelled_sql(
    CELL_KEYS + "quality, toxic, TRUE AS scored FROM splits JOIN lt USING (post_id) WHERE split = 'TEST'"))
def q_train_multilabel_cells_rows(spark, sf):
    p = q_train_multilabel(spark, sf)
    ok = [F.col(f"pred_{d}").isin(0, 1) & F.col(f"logit_{k}").isNotNull() for k, d in enumerate(TRAIN_DIMS)]
    return p.select("approach", "repeat", "fold", "post_id", *TRAIN_DIMS, (ok[0] & ok[1]).alias("scored"))


@register("train_history")
def q_train_history(spark, sf):
    """VALID score of every saved step of both fits."""
    one, two = (_model(spark, sf, kind).history.withColumn("kind", F.lit(kind)) for kind in ("binary", "multilabel"))
    return one.unionByName(two)


STEP_LIST = ", ".join(f"({t})" for t in range(1, TR.STEPS + 1) if t % TR.EVERY == 0 or t == TR.STEPS)
TRAIN_RUNS = ("FROM (SELECT CAST(range AS INTEGER) AS repeat FROM range(5)), (SELECT CAST(range AS INTEGER) AS fold FROM range(5)), "
              "(VALUES ('binary'), ('multilabel')) k(kind)")


@register("train_history_steps", f"SELECT '{APPROACH}' AS approach, repeat, fold, kind, step, TRUE AS scored {TRAIN_RUNS}, "
          f"(VALUES {STEP_LIST}) s(step) WHERE EXISTS (SELECT 1 FROM documents JOIN labels USING (doc_id))")
def q_train_history_steps(spark, sf):
    h = q_train_history(spark, sf)
    return h.select("approach", "repeat", "fold", "kind", "step", F.col("score").between(0, 1).alias("scored"))


@register("train_best_step")
def q_train_best_step(spark, sf):
    """M5 on the engine's own history."""
    return M.best_checkpoint(q_train_history(spark, sf), ["kind", *M.CELL])


@register("train_scores")
def q_train_scores(spark, sf):
    """K1/K2 through M1-M3: TEST macro P/R/F1 of every cell and label."""
    p = q_train_multilabel(spark, sf)
    return M.macro_prf(M.confusion_counts(p, dims=TRAIN_DIMS))


def _bits_sql() -> str:
    code = "CASE split WHEN 'TRAIN' THEN 1 WHEN 'VALID' THEN 2 ELSE 3 END"
    return ("WITH " + O.splits_with() + f"\nSELECT post_id, CAST(sum(CAST({code} AS BIGINT) << CAST(2 * (repeat * 5 + fold) AS BIGINT)) AS BIGINT) AS cells "
            "FROM splits GROUP BY post_id")


@register("cell_bits", _bits_sql())
def q_cell_bits(spark, sf):
    return S.cell_bits(_gold(spark, sf))


# --------------------------------------------------------------------------- streaming
from cvframe.streaming import leaderboard as ST  # noqa: E402


@register("stream_mean_runs", WITH_RUNS + "SELECT approach, metric, round(avg(value), 6) AS value, count(*) AS n_runs "
          "FROM runs GROUP BY 1, 2")
def q_stream_mean_runs(spark, sf):
    wide = _runs(spark, sf).withColumn("metric", F.concat(F.lit("eval_"), "metric"))
    wide = wide.groupBy("approach", "repeat", "fold").pivot("metric", [f"eval_{m}" for m in RUN_METRICS]) \
        .agg(F.first("value"))
    root = scratch_dir(spark, "runs-stream-src")
    RIO.write_runs(wide, root)
    table = ST.run_until_caught_up(spark, root, ST.run_record_schema(RUN_METRICS))
    return spark.read.parquet(table).withColumn("value", F.round("value", 6))


# --------------------------------------------------------------------------- preparation (E1 end to end)
from cvframe.plans.prepare import prepare_corpus  # noqa: E402


def _prepare_sql() -> str:
    variants = ("full", "majority", "conservative")
    ctes = [O.corpus_cte(v, f"c_{v}") for v in variants]
    ctes.append("allc AS (" + " UNION ALL ".join(
        f"SELECT '{v}' AS dataset_version, * FROM c_{v}" for v in variants) + ")")
    ctes += [O.seeds_cte(), O.splits_by_cte("allc", "dataset_version")]
    wide = ", ".join(f"max(CASE WHEN repeat = {r} AND fold = {f} THEN split END) AS fold{r}_{f}"
                     for r in range(5) for f in range(5))
    ctes.append(f"wide AS (SELECT dataset_version, post_id, {wide} FROM splits GROUP BY 1, 2)")
    return ("WITH " + ",\n".join(ctes) + "\nSELECT c.*, c.issue || ' ' || c.post_text AS arg_issue, w.* "
            "EXCLUDE (dataset_version, post_id) FROM allc c JOIN wide w USING (dataset_version, post_id)")


@register("prepare_corpus", _prepare_sql())
def q_prepare_corpus(spark, sf):
    docs = fx.table(spark, sf, "documents", ["doc_id", "source", "text"])
    variants = C.union_variants({v: fx.corpus_from_documents(docs, v) for v in ("full", "majority", "conservative")})
    return prepare_corpus(variants)
