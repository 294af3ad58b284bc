"""Independent DuckDB SQL for the fixtures and operators.

These strings are the correctness oracle: they restate each definition in
plain SQL (global windows, cross products, recursive CTEs - whatever is the
most direct statement), never the Spark plan.  Views ``documents``,
``embeddings``, ``events``, ``labels`` ... are registered by the caller.
"""

from __future__ import annotations

from cvframe.plans.fixtures import APPROACH_SHIFT, CHILD_P, PARENT_P, ROOT_P
from cvframe.schema import HOLDOUT_SEED, KFOLD_SEEDS, LABEL_COLS, TREE

L = LABEL_COLS
LABEL_ORDER = ", ".join(L)


def _bit(key: str, p: float, id_expr: str = "doc_id") -> str:
    return (
        f"CASE WHEN ('0x' || substr(md5('{key}:' || CAST({id_expr} AS VARCHAR)), 1, 6))::BIGINT "
        f"< {float(16777216 * p)!r} THEN 1 ELSE 0 END"
    )


def corpus_cte(variant: str = "majority", name: str = "corpus") -> str:
    roots = f"SELECT doc_id, source, text, {_bit('appropriateness', ROOT_P[variant])} AS appropriateness FROM documents"
    parents = ", ".join(f"appropriateness * {_bit(p, q)} AS {p}" for p, q in PARENT_P.items())
    lvl2 = f"SELECT *, {parents} FROM ({roots})"
    kids = ", ".join(f"{par} * {_bit(c, CHILD_P[c])} AS {c}" for par, cs in TREE.items() for c in cs)
    lvl3 = f"SELECT *, {kids} FROM ({lvl2})"
    cols = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in L)
    return (f"{name} AS (SELECT CAST(doc_id AS BIGINT) AS post_id, source AS issue, text AS post_text, {cols} "
            f"FROM ({lvl3}))")


CODE_SQL = "(" + " + ".join(f"CAST(c.{x} AS BIGINT) * {1 << (len(L) - 1 - i)}" for i, x in enumerate(L)) + ")"


def seeds_cte() -> str:
    vals = ", ".join(f"({i}, '{s}')" for i, s in enumerate(KFOLD_SEEDS))
    return f"seeds AS (SELECT * FROM (VALUES {vals}) t(repeat, seed))"


def kfold_cte(src: str = "corpus") -> str:
    return f"""kfold AS (
  SELECT c.post_id, CAST(s.repeat AS INTEGER) AS repeat,
         CAST((row_number() OVER (PARTITION BY s.repeat ORDER BY md5(s.seed || ':' || CAST({CODE_SQL} AS VARCHAR)), {CODE_SQL},
               md5(s.seed || ':' || CAST(c.post_id AS VARCHAR)), c.post_id) - 1) % 5 AS INTEGER) AS fold
  FROM {src} c CROSS JOIN seeds s)"""


def splits_cte(src: str = "corpus", kfold: str = "kfold") -> str:
    return f"""cells AS (SELECT CAST(range AS INTEGER) AS fold FROM range(5)),
nontest AS (
  SELECT k.post_id, k.repeat, cl.fold,
         row_number() OVER (PARTITION BY k.repeat, cl.fold ORDER BY {', '.join('c.' + x for x in L)},
             md5('{HOLDOUT_SEED}:' || CAST(k.post_id AS VARCHAR)), k.post_id) - 1 AS hpos
  FROM {kfold} k JOIN {src} c ON c.post_id = k.post_id JOIN cells cl ON cl.fold <> k.fold),
splits AS (
  SELECT post_id, repeat, fold, 'TEST' AS split FROM {kfold}
  UNION ALL
  SELECT post_id, repeat, fold, CASE WHEN hpos % 8 = 0 THEN 'VALID' ELSE 'TRAIN' END FROM nontest)"""


def splits_with(corpus: str = "corpus") -> str:
    return ",\n".join([corpus_cte(), seeds_cte(), kfold_cte(), splits_cte()])


def preds_cte(name: str = "preds", gold: str = "corpus") -> str:
    approaches = ", ".join(f"({i}, CAST({s!r} AS DOUBLE))" for i, s in enumerate(APPROACH_SHIFT))
    logits = ", ".join(
        f"CAST(8.0 AS DOUBLE) * CAST(e.embedding[a.approach * 14 + {k + 1}] AS DOUBLE) "
        f"+ a.s * CAST(2 * g.{c} - 1 AS DOUBLE) AS logit_{k}"
        for k, c in enumerate(L)
    )
    return (f"approaches AS (SELECT * FROM (VALUES {approaches}) t(approach, s)),\n"
            f"{name} AS (SELECT CAST(a.approach AS INTEGER) AS approach, g.post_id, {logits} "
            f"FROM {gold} g JOIN embeddings e ON e.vec_id = g.post_id % (SELECT max(vec_id) + 1 FROM embeddings) "
            f"CROSS JOIN approaches a)")


def runs_cte(name: str = "runs") -> str:
    return f"""ev AS (
  SELECT event_type AS approach, event_id % 25 AS run, CAST(round(value * 100) AS BIGINT) AS q,
         user_id % 2 = 0 AS even FROM events),
runagg AS (
  SELECT approach, run,
         CAST(sum(q) AS DOUBLE) / count(*) AS mean_F1,
         CAST(sum(CASE WHEN even THEN q END) AS DOUBLE) / count(CASE WHEN even THEN 1 END) AS even_macroF1,
         CAST(sum(CASE WHEN even THEN q % 97 END) AS DOUBLE) / count(CASE WHEN even THEN 1 END) AS even_precision,
         round(CAST(sum(q) AS DOUBLE) / count(*) / 100) AS coarse_macroF1
  FROM ev GROUP BY approach, run),
{name} AS (
  SELECT approach, CAST(run // 5 AS INTEGER) AS repeat, CAST(run % 5 AS INTEGER) AS fold, metric, value
  FROM (SELECT approach, run, 'mean_F1' AS metric, mean_F1 AS value FROM runagg
        UNION ALL SELECT approach, run, 'even_macroF1', even_macroF1 FROM runagg
        UNION ALL SELECT approach, run, 'even_precision', even_precision FROM runagg
        UNION ALL SELECT approach, run, 'coarse_macroF1', coarse_macroF1 FROM runagg)
  WHERE value IS NOT NULL)"""


def history_cte(name: str = "history") -> str:
    return f"""{name} AS (
  SELECT approach, CAST(run // 5 AS INTEGER) AS repeat, CAST(run % 5 AS INTEGER) AS fold, step,
         CAST(sum(q) AS DOUBLE) / count(*) AS score
  FROM (SELECT event_type AS approach, event_id % 25 AS run,
               CAST(((event_id // 25) % 8) * 250 AS INTEGER) AS step,
               CAST(round(value * 100) AS BIGINT) AS q FROM events)
  GROUP BY approach, run, step)"""


def confusion_cte(pred01: str = "p01", name: str = "conf") -> str:
    """Long confusion counts from a table with 0/1 ``pred_<dim>`` columns."""
    parts = []
    for d in L:
        parts.append(
            f"SELECT approach, repeat, fold, '{d}' AS dim, "
            f"CAST(sum(y.{d} * p.pred_{d}) AS BIGINT) AS tp, CAST(sum((1 - y.{d}) * p.pred_{d}) AS BIGINT) AS fp, "
            f"CAST(sum(y.{d} * (1 - p.pred_{d})) AS BIGINT) AS fn, "
            f"CAST(sum((1 - y.{d}) * (1 - p.pred_{d})) AS BIGINT) AS tn "
            f"FROM {pred01} p JOIN corpus y USING (post_id) JOIN splits s USING (post_id) "
            f"WHERE s.split = 'TEST' GROUP BY approach, repeat, fold"
        )
    return f"{name} AS (\n  " + "\n  UNION ALL ".join(parts) + ")"


def pred01_cte(src: str = "preds", name: str = "p01") -> str:
    cols = ", ".join(f"CASE WHEN logit_{k} > 0 THEN 1 ELSE 0 END AS pred_{d}" for k, d in enumerate(L))
    return f"{name} AS (SELECT approach, post_id, {cols} FROM {src})"


def macro_cte(conf: str = "conf", name: str = "prf") -> str:
    def m(x1: str, x0: str) -> str:
        return (f"(CASE WHEN tp + fp + fn > 0 THEN {x1} ELSE 0 END + CASE WHEN tn + fp + fn > 0 THEN {x0} ELSE 0 END)"
                f" / ((CASE WHEN tp + fp + fn > 0 THEN 1 ELSE 0 END) + (CASE WHEN tn + fp + fn > 0 THEN 1 ELSE 0 END))")

    def r(n: str, d: str) -> str:
        return f"(CASE WHEN ({d}) = 0 THEN 0.0 ELSE CAST({n} AS DOUBLE) / ({d}) END)"

    return f"""{name} AS (
  SELECT * EXCLUDE (tp, fp, fn, tn),
    {m(r('tp', 'tp + fp'), r('tn', 'tn + fn'))} AS precision,
    {m(r('tp', 'tp + fn'), r('tn', 'tn + fp'))} AS recall,
    {m(r('2 * tp', '2 * tp + fp + fn'), r('2 * tn', '2 * tn + fn + fp'))} AS macro_f1
  FROM {conf})"""


def tokens_cte(src: str = "corpus", name: str = "toks") -> str:
    from cvframe.functions.text import STRIP_PATTERN, TOKEN_PATTERN

    return (f"{name} AS (SELECT post_id, regexp_extract_all(regexp_replace(post_text, '{STRIP_PATTERN}', '', 'g'), "
            f"'{TOKEN_PATTERN}') AS tokens FROM {src})")


def shuffled_cte(seed, toks: str = "toks", name: str = "shuffled") -> str:
    """(post_id, text): tokens in the order of the keyed permutation (WITH RECURSIVE)."""
    from cvframe.functions.permute import permutation_sql

    key = f"'{seed}:' || CAST(post_id AS VARCHAR)"
    return permutation_sql(toks, "perm", "post_id", key) + f""",
{name} AS (SELECT t.post_id, CASE WHEN t.tokens IS NOT NULL THEN coalesce(string_agg(t.tokens[p.x + 1], ' ' ORDER BY p.j), '') END AS text
  FROM {toks} t LEFT JOIN perm p ON p.post_id = t.post_id GROUP BY t.post_id, t.tokens)"""


def shuffled_sql(seed) -> str:
    return "WITH RECURSIVE " + ",\n".join([corpus_cte(), tokens_cte(), shuffled_cte(seed)]) + "\nSELECT post_id, text FROM shuffled"


def vocab_cte(toks: str = "toks", name: str = "vocab") -> str:
    """Every token of the corpus, most frequent first (ties by md5, token)."""
    return f"""vcount AS (SELECT t AS token, count(*) AS n FROM (SELECT unnest(tokens) AS t FROM {toks}) GROUP BY t),
{name} AS (SELECT token, CAST(1 + row_number() OVER (ORDER BY n DESC, md5('vocab:' || token), token) AS INTEGER) AS id
  FROM vcount)"""


def encode_cte(toks: str = "toks", vocab: str = "vocab", name: str = "enc") -> str:
    """Every token of every row (whole texts) to its id, unknown -> 1."""
    return f"""flat AS (SELECT post_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM {toks}),
enc0 AS (SELECT post_id, list(coalesce(v.id, 1) ORDER BY pos) AS ids FROM flat LEFT JOIN {vocab} v USING (token)
         GROUP BY post_id),
{name} AS (SELECT t.post_id, coalesce(e.ids, CAST([] AS INTEGER[])) AS ids FROM {toks} t LEFT JOIN enc0 e USING (post_id))"""


def batches_cte(src: str = "corpus", name: str = "batches", seed: str = "batches", size: int = 16) -> str:
    return f"""{name} AS (SELECT post_id, CAST(pos // {size} AS BIGINT) AS batch_id, CAST(pos % {size} AS INTEGER) AS slot
  FROM (SELECT post_id, row_number() OVER (ORDER BY md5('{seed}:' || CAST(post_id AS VARCHAR)), post_id) - 1 AS pos
        FROM {src}))"""


def splits_by_cte(src: str, by: str, name: str = "splits") -> str:
    """Split table of ``src`` computed separately for every value of ``by``."""
    order = ", ".join("c." + x for x in L)
    return f"""kf_by AS (
  SELECT c.{by}, c.post_id, CAST(s.repeat AS INTEGER) AS repeat,
         CAST((row_number() OVER (PARTITION BY c.{by}, s.repeat ORDER BY md5(s.seed || ':' || CAST({CODE_SQL} AS VARCHAR)), {CODE_SQL},
               md5(s.seed || ':' || CAST(c.post_id AS VARCHAR)), c.post_id) - 1) % 5 AS INTEGER) AS fold
  FROM {src} c CROSS JOIN seeds s),
cells_by AS (SELECT CAST(range AS INTEGER) AS fold FROM range(5)),
nt_by AS (
  SELECT k.{by}, k.post_id, k.repeat, cl.fold,
         row_number() OVER (PARTITION BY k.{by}, k.repeat, cl.fold ORDER BY {order},
             md5('{HOLDOUT_SEED}:' || CAST(k.post_id AS VARCHAR)), k.post_id) - 1 AS hpos
  FROM kf_by k JOIN {src} c ON c.post_id = k.post_id AND c.{by} = k.{by} JOIN cells_by cl ON cl.fold <> k.fold),
{name} AS (
  SELECT {by}, post_id, repeat, fold, 'TEST' AS split FROM kf_by
  UNION ALL
  SELECT {by}, post_id, repeat, fold, CASE WHEN hpos % 8 = 0 THEN 'VALID' ELSE 'TRAIN' END FROM nt_by)"""
