"""Timeline plan: unify -> user split -> targets -> features (entry 2 of the survey).

One exchange on ``user_id`` serves the user split join, the rolling/lag/lead
target rules and all nine features: every window shares the same
partitioning and ordering, so Catalyst stacks the Window operators on one sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.splits import user_split
from ..operators.timeline import DETERIORATION_FEATURES, deterioration_features, deterioration_targets
from ..sources import fixtures

FEATURE_OUTPUT = ["user_id", "timepoint", "Source", "Split", "Target", *DETERIORATION_FEATURES]


def build_features(timeline: DataFrame, noise_std: float = 0.0, seed: int = 42, keep=()) -> DataFrame:
    """Timeline rows -> (user_id, timepoint, Source, Split, Target, 9 features[, keep...])."""
    with_split = user_split(timeline, seed=seed)
    targeted = deterioration_targets(with_split, keep_unlabelled=True)
    feats = deterioration_features(targeted, noise_std=noise_std, seed=seed)
    return feats.filter(F.col("Target").isNotNull()).select(*FEATURE_OUTPUT, *keep)


def timeline_audit(features: DataFrame, source: str = "Depression_14D", crisis: int = 3,
                   split: str = "test", prob_col: str | None = None) -> DataFrame:
    """The first test user of ``source`` reaching the crisis class, all its rows in order.

    "First" is the smallest user key (file order does not exist in Spark).  The
    user is one scalar from one aggregation; filtering on it afterwards lets
    Catalyst push the predicate below the user-partitioned windows, so the
    second pass only touches that user's rows (a semi join would recompute the
    whole timeline for every user).
    """
    test = features.filter(F.col("Split") == split)
    uid = (test.filter((F.col("Target") == crisis) & (F.col("Source") == source))
           .agg(F.min("user_id").alias("user_id")).first()["user_id"])
    rows = test.filter(F.col("user_id") == F.lit(uid)) if uid is not None else test.filter(F.lit(False))
    cols = ["user_id", "timepoint", "CompositeRisk", "Target"] + ([prob_col] if prob_col else [])
    return rows.select(*cols).orderBy("timepoint")


def deterioration_features_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_features(fixtures.timeline(spark, sf_dir))
