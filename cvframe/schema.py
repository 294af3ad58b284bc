"""Label schema of the appropriateness study.

Everything in the block below is a fixed value: it must equal the study's
own label inventory, order, renaming and seeds for results to line up.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the study's; do not reorder)
# ---------------------------------------------------------------------------
# The 14 labels in study order, as written in the study's result keys.
DIMS = [
    "Appropriateness",
    "Emotions",
    "Emotional Intensity",
    "Emotional Typology",
    "Commitment",
    "Committed Seriousness",
    "Committed Openness",
    "Intelligibility",
    "Intelligible Position",
    "Intelligible Relevance",
    "Intelligible Organization",
    "Other",
    "Orthography",
    "Not classified",
]
# Old corpus names and the names they were renamed to.
RENAME_LABELS = {
    "Clarity": "Intelligibility",
    "Clear Position": "Intelligible Position",
    "Clear Relevance": "Intelligible Relevance",
    "Clear Organization": "Intelligible Organization",
}
# Seeds of the five repeated k-fold splits, and of the inner holdout.
KFOLD_SEEDS = [2746317213, 1181241943, 958682846, 3163119785, 1812140441]
HOLDOUT_SEED = 42
N_FOLDS = 5
HOLDOUT_EVERY = 8  # 12.5 % of the non-test rows go to VALID
# Corpus variants (one file each in the study).
VARIANTS = ["full", "majority", "conservative"]
# ---------------------------------------------------------------------------


def snake(name: str) -> str:
    """Canonical column name: lower case, spaces to underscores."""
    return name.strip().lower().replace(" ", "_")


LABEL_COLS = [snake(d) for d in DIMS]
DISPLAY = dict(zip(LABEL_COLS, DIMS))

# Hierarchy: root -> parents -> children (derived from the repair rule).
ROOT = "appropriateness"
TREE = {
    "emotions": ["emotional_intensity", "emotional_typology"],
    "commitment": ["committed_seriousness", "committed_openness"],
    "intelligibility": [
        "intelligible_position",
        "intelligible_relevance",
        "intelligible_organization",
    ],
    "other": ["orthography", "not_classified"],
}

SPLITS = ("TRAIN", "VALID", "TEST")


def corpus_schema(label_names=None) -> T.StructType:
    """Explicit corpus schema: ids, issue, text and 14 integer labels."""
    names = label_names or LABEL_COLS
    return T.StructType(
        [
            T.StructField("post_id", T.LongType(), True),
            T.StructField("issue", T.StringType(), True),
            T.StructField("post_text", T.StringType(), True),
        ]
        + [T.StructField(n, T.IntegerType(), True) for n in names]
    )
