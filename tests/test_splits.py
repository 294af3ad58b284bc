"""Split assignment: oracle definition on a small fixture and balance properties."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cvframe.operators import splits as S
from cvframe.plans import fixtures as fx
from cvframe.schema import KFOLD_SEEDS, LABEL_COLS


@pytest.fixture(scope="module")
def gold(spark, sf_small):
    return fx.gold(spark, sf_small).cache()


@pytest.fixture(scope="module")
def splits(gold):
    return S.assign_splits(gold).toPandas()


def brute_force_kfold(gdf: pd.DataFrame, seed: int, k: int = 5) -> pd.Series:
    import hashlib

    def digest(x):
        return hashlib.md5(f"{seed}:{x}".encode()).hexdigest()

    code = sum(gdf[c].astype("int64") * 2 ** (len(LABEL_COLS) - 1 - i) for i, c in enumerate(LABEL_COLS))
    order = gdf.assign(_code=code, _g=code.map(digest), _h=gdf["post_id"].map(digest))
    order = order.sort_values(["_g", "_code", "_h", "post_id"]).reset_index(drop=True)
    order["fold"] = order.index % k
    return order.set_index("post_id")["fold"]


def test_kfold_matches_definition(gold):
    gdf = gold.toPandas()
    got = S.ms_kfold(gold).toPandas()
    for r, seed in enumerate(KFOLD_SEEDS):
        exp = brute_force_kfold(gdf, seed)
        g = got[got.repeat == r].set_index("post_id")["fold"]
        assert (g.sort_index() == exp.sort_index()).all()


def test_bucket_width_does_not_change_positions(gold):
    a = S.ms_kfold(gold, digits=1).toPandas().sort_values(["repeat", "post_id"]).reset_index(drop=True)
    b = S.ms_kfold(gold, digits=3).toPandas().sort_values(["repeat", "post_id"]).reset_index(drop=True)
    assert a.equals(b)


def test_every_post_once_per_cell(splits, gold):
    n = gold.count()
    assert len(splits) == n * 25
    per = splits.groupby(["repeat", "fold", "post_id"]).size()
    assert (per == 1).all()


def test_test_folds_partition_each_repeat(splits, gold):
    n = gold.count()
    t = splits[splits.split == "TEST"]
    assert (t.groupby(["repeat", "post_id"]).size() == 1).all()
    sizes = t.groupby(["repeat", "fold"]).size()
    assert sizes.max() - sizes.min() <= 1
    assert sizes.groupby(level=0).sum().eq(n).all()


def test_valid_is_one_eighth_of_non_test(splits):
    nt = splits[splits.split != "TEST"]
    frac = (nt.split == "VALID").groupby([nt.repeat, nt.fold]).mean()
    assert frac.between(0.11, 0.14).all()


def test_labels_spread_evenly(gold):
    rows = S.ms_kfold(gold).join(gold, "post_id").toPandas()
    for r in range(5):
        sub = rows[rows.repeat == r]
        per = sub.groupby("fold")[LABEL_COLS].sum()
        ideal = sub[LABEL_COLS].sum() / 5
        # each labelset adds at most one row of imbalance per fold
        assert ((per - ideal).abs().max() <= 5).all()


def test_iterative_stratify_balance(gold):
    rows = S.iterative_stratify(gold).join(gold, "post_id").toPandas()
    assert len(rows) == gold.count() * 5
    for r in range(5):
        sub = rows[rows.repeat == r]
        sizes = sub.groupby("fold").size()
        assert sizes.max() - sizes.min() <= 1
        per = sub.groupby("fold")[LABEL_COLS].sum()
        ideal = sub[LABEL_COLS].sum() / 5
        assert ((per - ideal).abs().max() <= 3).all()


def test_greedy_quotas_conserve_counts():
    import numpy as np

    codes = np.array([0, 1, 3, 8, 12], dtype=np.int64)
    counts = np.array([100, 7, 3, 11, 2], dtype=np.int64)
    q = S._greedy_quotas(codes, counts, 4, 5)
    assert (q.sum(axis=1) == counts).all()
    sizes = q.sum(axis=0)
    assert sizes.max() - sizes.min() <= 1


def test_hot_labelset_is_split_over_buckets(spark):
    # a third of the rows share one labelset: its rows are numbered in many
    # (labelset, bucket) groups, never in a single window partition
    df = spark.range(0, 3000).select(F.col("id").alias("post_id"),
                                     *[(F.col("id") % 3 == 0).cast("int").alias(c) for c in LABEL_COLS])
    got = S.ms_kfold(df, seeds=[7]).toPandas()
    assert got.fold.value_counts().max() - got.fold.value_counts().min() <= 1
    d = S._seeded(df, "post_id", LABEL_COLS, [7]).withColumn("_b", F.substring("_h", 1, 2))
    assert d.select("_code", "_b").distinct().count() > 256


def test_splits_wide_names(gold):
    w = S.splits_wide(S.assign_splits(gold), name="fold{repeat}.{fold}")
    assert "fold0.0" in w.columns and "fold4.4" in w.columns
    assert w.count() == gold.count()


def test_by_group_equals_separate_runs(spark, sf_small):
    docs = fx.table(spark, sf_small, "documents", ["doc_id", "source", "text"])
    parts = {v: fx.corpus_from_documents(docs, v).select("post_id", *LABEL_COLS) for v in ("full", "conservative")}
    both = parts["full"].withColumn("dataset_version", F.lit("full")).unionByName(
        parts["conservative"].withColumn("dataset_version", F.lit("conservative")))
    joint = S.assign_splits(both, by=["dataset_version"])
    for v, df in parts.items():
        alone = S.assign_splits(df)
        mine = joint.filter(F.col("dataset_version") == v).drop("dataset_version")
        assert mine.exceptAll(alone).count() == 0 and alone.exceptAll(mine).count() == 0


def test_prepare_rejects_duplicate_ids(spark):
    from cvframe.plans.prepare import prepare_corpus

    rows = [(1, "i", "t", *([0] * 14)), (1, "i", "u", *([1] * 14))]
    from cvframe.schema import corpus_schema

    df = spark.createDataFrame(rows, corpus_schema()).withColumn("dataset_version", F.lit("x"))
    with pytest.raises(ValueError):
        prepare_corpus(df)


def test_iterative_by_group_and_feeding_splits(spark, sf_small):
    docs = fx.table(spark, sf_small, "documents", ["doc_id", "source", "text"])
    both = fx.corpus_from_documents(docs, "full").select("post_id", *LABEL_COLS) \
        .withColumn("dataset_version", F.lit("full")).unionByName(
        fx.corpus_from_documents(docs, "conservative").select("post_id", *LABEL_COLS)
        .withColumn("dataset_version", F.lit("conservative")))
    it = S.iterative_stratify(both, by=["dataset_version"], keep_code=True)
    rows = it.toPandas()
    assert len(rows) == both.count() * 5
    sizes = rows.groupby(["dataset_version", "repeat", "fold"]).size()
    assert (sizes.groupby(level=[0, 1]).agg(lambda x: x.max() - x.min()) <= 1).all()
    sp = S.assign_splits(both, by=["dataset_version"], test_folds=it).toPandas()
    test = sp[sp.split == "TEST"].merge(rows, on=["dataset_version", "post_id", "repeat", "fold"])
    assert len(test) == len(rows)


def test_direct_wide_equals_pivot_of_long(gold):
    a = S.assign_splits_wide(gold)
    b = S.splits_wide(S.assign_splits(gold))
    assert sorted(a.columns) == sorted(b.columns)
    assert a.exceptAll(b.select(*a.columns)).count() == 0 and a.count() == b.count()


@pytest.mark.parametrize("assign", [S.ms_kfold, S.iterative_stratify])
def test_repeats_differ_for_rare_labelsets(spark, assign):
    """A post keeps one fold over all five repeats about as often as chance (0.16 %)."""
    gold = fx.gold(spark, "/root/testdata/sf0.1")
    folds = assign(gold).groupBy("post_id").agg(F.count_distinct("fold").alias("n"))
    assert folds.filter("n = 1").count() / folds.count() < 0.005


def test_iterative_balance(gold):
    b = S.stratification_balance(S.iterative_stratify(gold, keep_code=True)).toPandas()
    assert b.spread_within_one.all() and b.sizes_within_one.all() and (b.n_folds == 5).all()


def test_prepare_refuses_null_texts(spark, sf_small):
    from cvframe.plans.prepare import prepare_corpus

    docs = fx.table(spark, sf_small, "documents", ["doc_id", "source", "text"])
    c = fx.corpus_from_documents(docs).withColumn("dataset_version", F.lit("v"))
    c = c.withColumn("issue", F.when(F.col("post_id") != 3, F.col("issue")))
    with pytest.raises(ValueError, match="no issue or no text"):
        prepare_corpus(c)
