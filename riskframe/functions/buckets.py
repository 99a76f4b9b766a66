"""Piecewise and linear mappings as ``when`` chains (no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import ColumnOrName, col
from .maps import RISK_LEVEL_BANDS, RISK_LEVEL_FLOOR


def step_bucket(c: ColumnOrName, steps, fill: float | None = None) -> Column:
    """Three-level step: ``steps = ([(bound, value), ...], else_value)``, bounds exclusive."""
    bounds, top = steps
    x = col(c)
    if fill is not None:
        x = F.coalesce(x, F.lit(float(fill)))
    out = None
    for bound, value in bounds:
        out = (F.when(x < bound, F.lit(float(value))) if out is None else out.when(x < bound, F.lit(float(value))))
    return out.otherwise(F.lit(float(top)))


def map_granular(c: ColumnOrName, scale_min=1.0, scale_max=10.0, target_min=1.0, target_max=10.0) -> Column:
    """Linear rescale of a slider value to a target range, clipped to it."""
    x = col(c).cast("double")
    scaled = F.lit(float(target_min)) + (x - scale_min) / (scale_max - scale_min) * (target_max - target_min)
    return F.when(x.isNull(), None).otherwise(F.least(F.greatest(scaled, F.lit(float(target_min))), F.lit(float(target_max))))


def score_100(prob: ColumnOrName, threshold: ColumnOrName) -> Column:
    """Calibrated probability to a 0-100 severity score with ``threshold`` at 70."""
    p, t = col(prob), col(threshold)
    if not isinstance(threshold, Column) and not isinstance(threshold, str):
        t = F.lit(float(threshold))
    raw = F.when(p >= t, 70.0 + (p - t) / (1.0 - t + 1e-9) * 30.0).otherwise(p / t * 69.0)
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(100.0))


def risk_level(score: ColumnOrName) -> Column:
    s = col(score)
    out = None
    for bound, name in RISK_LEVEL_BANDS:
        out = F.when(s >= bound, name) if out is None else out.when(s >= bound, name)
    return out.otherwise(RISK_LEVEL_FLOOR)
