"""Hierarchy repair on hand rows and on the fixture predictions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cvframe.operators import scoring as G
from cvframe.plans import fixtures as fx
from cvframe.schema import LABEL_COLS, TREE

K = {d: i for i, d in enumerate(LABEL_COLS)}


def row(**logits):
    base = [-5.0] * len(LABEL_COLS)
    for d, v in logits.items():
        base[K[d]] = v
    return base


def repaired(spark, rows, mode):
    schema = "id int, " + ", ".join(f"logit_{k} double" for k in range(len(LABEL_COLS)))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
    out = G.repair(df, mode).orderBy("id").collect()
    return [{d: r[f"pred_{d}"] for d in LABEL_COLS} for r in out]


def test_root_zero_clears_everything(spark):
    r = repaired(spark, [row(emotions=3.0, emotional_intensity=2.0)], "reference")[0]
    assert sum(r.values()) == 0


def test_parent_without_child_gets_most_probable_child(spark):
    r = repaired(spark, [row(appropriateness=1.0, emotions=1.0, emotional_intensity=-2.0,
                             emotional_typology=-1.0)], "reference")[0]
    assert r["emotional_typology"] == 1 and r["emotional_intensity"] == 0 and r["emotions"] == 1


def test_tied_children_pick_first(spark):
    r = repaired(spark, [row(appropriateness=1.0, commitment=1.0, committed_seriousness=-1.0,
                             committed_openness=-1.0)], "corrected")[0]
    assert r["committed_seriousness"] == 1 and r["committed_openness"] == 0


def test_organization_never_picked_in_reference_mode(spark):
    logits = row(appropriateness=1.0, intelligibility=1.0, intelligible_position=-3.0,
                 intelligible_relevance=-2.0, intelligible_organization=-0.1)
    ref = repaired(spark, [logits], "reference")[0]
    cor = repaired(spark, [logits], "corrected")[0]
    assert ref["intelligible_relevance"] == 1 and ref["intelligible_organization"] == 0
    assert cor["intelligible_organization"] == 1 and cor["intelligible_relevance"] == 0


def test_root_without_parent_left_alone(spark):
    r = repaired(spark, [row(appropriateness=1.0)], "reference")[0]
    assert r["appropriateness"] == 1 and sum(r.values()) == 1


def test_child_kept_when_any_child_set(spark):
    r = repaired(spark, [row(appropriateness=1.0, other=1.0, orthography=-1.0, not_classified=0.5)],
                 "reference")[0]
    assert r["not_classified"] == 1 and r["orthography"] == 0


@pytest.mark.parametrize("mode", ["reference", "corrected"])
def test_fixture_repair_consistent_and_idempotent(spark, sf_small, mode):
    rep = G.repair(fx.preds(spark, sf_small), mode)
    assert rep.filter(~G.is_consistent()).count() == 0
    # every set parent has at least one set child after repair
    for parent, kids in TREE.items():
        bad = rep.filter((F.col(f"pred_{parent}") == 1) & (F.greatest(*[F.col(f"pred_{c}") for c in kids]) == 0))
        assert bad.count() == 0
    # idempotent: feeding 0/1 labels back as +-1 logits changes nothing
    again = rep.select("approach", "post_id", *[(F.col(f"pred_{d}") * 2 - 1).cast("double").alias(f"logit_{k}")
                                                for k, d in enumerate(LABEL_COLS)])
    twice = G.repair(again, mode)
    assert twice.exceptAll(rep).count() == 0


@pytest.mark.parametrize("mode", ["reference", "corrected"])
def test_repair_of_unknown_logits(spark, mode):
    """NULL and NaN give NULL, and NULL only for what depends on them."""
    def fixed(**known):
        row = {d: -1.0 for d in LABEL_COLS} | known
        df = spark.createDataFrame([tuple(row[d] for d in LABEL_COLS)], ", ".join(f"logit_{k} double" for k in range(len(LABEL_COLS))))
        return G.repair(df, mode).first().asDict()

    for none in (None, float("nan")):
        assert set(fixed(appropriateness=none).values()) == {None, 0}
        got = fixed(appropriateness=none, emotions=1.0, emotional_typology=1.0)
        assert got["pred_appropriateness"] is got["pred_emotions"] is got["pred_emotional_typology"] is None
        assert got["pred_commitment"] == got["pred_orthography"] == 0
        assert set(fixed(emotions=none).values()) == {0}            # the root decides
        on = {"appropriateness": 1.0, "emotions": 1.0}
        got = fixed(**on, emotional_intensity=none)                   # is a child to be picked?
        assert got["pred_emotions"] == 1 and got["pred_emotional_intensity"] is got["pred_emotional_typology"] is None
        got = fixed(**on, emotional_intensity=none, emotional_typology=2.0)
        assert got["pred_emotional_typology"] == 1 and got["pred_emotional_intensity"] is None
        got = fixed(appropriateness=1.0, emotions=none, emotional_typology=1.0)
        assert got["pred_emotional_typology"] is None and got["pred_commitment"] == 0


@pytest.mark.parametrize("width", [3, 1024])
def test_linear_head_of_any_width(spark, width):
    r = np.random.default_rng(2)
    w, b = r.normal(size=(14, width)), r.normal(size=14)
    v = r.normal(size=(50, width)).round(3)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(90, None), (91, [1.0] * (width - 1)), (92, [None] + [1.0] * (width - 1)), (93, [])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = {r["id"]: [r[f"logit_{k}"] for k in range(14)] for r in G.score_linear(df, "v", w.tolist(), b.tolist()).collect()}
    want = v.astype(np.float32).astype(float) @ w.T + b
    assert all(got[i] == pytest.approx(want[i].tolist(), abs=1e-9) for i in range(50))
    assert all(got[i] == [None] * 14 for i in (90, 91, 92, 93))
