"""Feature selection and importance (J11, J13/J14 rules, J23 share part).

Mutual information is computed exactly on discrete (or equal-width binned)
values from one contingency aggregation: features are unpivoted with
``stack`` into (feature, value, label) and counted, so only the small count
table is ever materialised per feature; no rows reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .aggregates import importance_share  # noqa: F401  (re-exported)


def _long(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str] = ()) -> DataFrame:
    pairs = ", ".join(f"'{f}', CAST(`{f}` AS DOUBLE)" for f in features)
    return df.selectExpr(*[f"`{k}`" for k in keys], f"`{label}` AS _y",
                         f"stack({len(features)}, {pairs}) AS (feature, x)")


def equal_width_bins(df: DataFrame, features: Sequence[str], n_bins: int = 10) -> DataFrame:
    """Replace each feature by its equal-width bin over [min, max] (min/max from one aggregation)."""
    row = df.agg(*[F.min(f).alias(f"{f}__lo") for f in features], *[F.max(f).alias(f"{f}__hi") for f in features]).first()
    out = {}
    for f in features:
        lo, hi = row[f"{f}__lo"], row[f"{f}__hi"]
        if lo is None or hi is None or hi <= lo:
            out[f] = F.when(F.col(f).isNotNull(), F.lit(0))
        else:
            out[f] = F.least(F.floor((F.col(f) - lo) * (n_bins / (hi - lo))), F.lit(n_bins - 1)).cast("int")
    return df.withColumns(out)


def mutual_info(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Exact discrete mutual information (nats) between each feature and the label.

    Rows with a NULL feature value are left out of that feature's estimate.
    """
    long = _long(df, features, label).filter(F.col("x").isNotNull())
    joint = long.groupBy("feature", "x", "_y").agg(F.count(F.lit(1)).alias("n_xy"))
    wf = Window.partitionBy("feature")
    j = joint.select("*", F.sum("n_xy").over(wf).alias("n"),
                     F.sum("n_xy").over(Window.partitionBy("feature", "x")).alias("n_x"),
                     F.sum("n_xy").over(Window.partitionBy("feature", "_y")).alias("n_y"))
    nxy, n = F.col("n_xy").cast("double"), F.col("n").cast("double")
    term = nxy / n * F.log(nxy * n / (F.col("n_x").cast("double") * F.col("n_y").cast("double")))
    return j.groupBy("feature").agg(F.sum(term).alias("mi"))


def top_k(scores: DataFrame, k: int, value: str = "mi", name: str = "feature") -> DataFrame:
    """the k best features (ties by name)."""
    return scores.orderBy(F.col(value).desc(), F.col(name)).limit(k)


def linear_contributions(df: DataFrame, features: Sequence[str], coef: dict, mean: dict, key: str) -> DataFrame:
    """J23 (exact linear form): per row and feature ``coef * (x - mean)``, long form."""
    pairs = ", ".join(
        f"'{f}', CAST({float(coef[f])!r} AS DOUBLE) * (CAST(`{f}` AS DOUBLE) - CAST({float(mean[f])!r} AS DOUBLE))"
        for f in features)
    return df.selectExpr(f"`{key}`", f"stack({len(features)}, {pairs}) AS (feature, importance)")


def consensus_with_fallback(lists: DataFrame, fallback: DataFrame, min_lists: int = 2, min_size: int = 10,
                            name: str = "feature") -> list[str]:
    """Names in >= 2 lists; when fewer than ``min_size`` agree, use the fallback list.

    Returns a feature list (metadata, small)."""
    from .schema import consensus
    agreed = [r[name] for r in consensus(lists, name, "list_id", min_lists).collect()]
    if len(agreed) >= min_size:
        return sorted(agreed)
    return [r[name] for r in fallback.collect()]
