"""Column-expression helpers (all JVM-side)."""

from .buckets import map_granular, risk_level, score_100, step_bucket  # noqa: F401
from .exprs import (  # noqa: F401
    any_not_null, capitalize, clip, coerce_numeric, half_even, is_true, isin_false_on_null,
    literal_map, map_lookup, nan_to_null, norm_key, numeric_col, pct_change, row_count, row_mean, row_sum,
    safe_ratio, stable_hash_order, unit_uniform, word_or_number,
)
