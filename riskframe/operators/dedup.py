"""Priority de-duplication (E13) and distinct rows, skew-proof.

A fingerprint shared by a third of all rows must not land in one task with
all its rows.  ``min_by`` is a declarative aggregate with a partial
(map-side) phase: each task reduces its share of a hot fingerprint to one
candidate before the shuffle, so the exchange carries at most one row per
(task, fingerprint).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import map_lookup


def priority_dedup(df: DataFrame, fingerprint: Sequence[str], priority: dict, source: str = "DatasetSource",
                   tie_break: str = "rec_id", missing_priority: int = 99) -> DataFrame:
    """Keep, per fingerprint, the row from the best-priority source (ties: smallest ``tie_break``).

    NULLs in the fingerprint compare equal (pandas ``drop_duplicates``).
    """
    prio = map_lookup({k: int(v) for k, v in priority.items()}, source, missing_priority)
    others = [c for c in df.columns if c not in fingerprint]
    best = df.groupBy(*fingerprint).agg(
        F.min_by(F.struct(*others), F.struct(prio.alias("p"), F.col(tie_break).alias("t"))).alias("_keep"))
    return best.select(*[F.col(f"_keep.{c}") for c in others if c in df.columns], *fingerprint).select(*df.columns)
