"""Column-expression helpers that reproduce pandas missing-value rules on Spark.

Spark differs from pandas on NULL/NaN handling in ways that change results:
``greatest(1, NULL) = 1`` (pandas ``clip`` keeps NaN), ``NaN > 7`` is true,
ANSI division by zero raises, ``initcap`` is not ``str.capitalize``.  The
helpers below encode the pandas behaviour explicitly so every operator gets
it right, and all of them stay JVM-side expressions (whole-stage codegen).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Plain decimal / exponent literal.  ``try_cast`` alone also accepts '1d',
# 'nan', 'Infinity', which pandas ``to_numeric(errors='coerce')`` would not.
NUMERIC_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_double() -> Column:
    return F.lit(None).cast("double")


def nan_to_null(c: ColumnOrName) -> Column:
    """Missing is NULL, never NaN: map NaN to NULL on a double column."""
    c = col(c).cast("double")
    return F.nanvl(c, null_double())


def coerce_numeric(c: ColumnOrName) -> Column:
    """pandas ``to_numeric(errors='coerce')`` on a string (or numeric) column."""
    s = F.trim(col(c).cast("string"))
    return F.when(s.rlike(NUMERIC_PATTERN), s.cast("double")).otherwise(null_double())


def numeric_col(df, c: str) -> Column:
    """``coerce_numeric`` that looks at the column type first: a numeric column is
    only cast (NaN -> NULL), so the string round trip and regex run only on text."""
    from pyspark.sql import types as T
    if isinstance(df.schema[c].dataType, T.NumericType):
        return nan_to_null(c)
    return coerce_numeric(c)


def clip(c: ColumnOrName, lo: float | None = None, hi: float | None = None) -> Column:
    """pandas ``clip``: bounds applied, NULL stays NULL."""
    c = col(c)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(c.isNull(), null_double()).otherwise(out)


def safe_ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """Division that yields NULL for a zero divisor (ANSI mode would raise)."""
    return F.try_divide(col(num), col(den))


def pct_change(cur: ColumnOrName, prev: ColumnOrName, big: float = float("inf")) -> Column:
    """pandas ``pct_change`` semantics: (cur-prev)/prev; prev=0 gives +/-inf, 0/0 NaN.

    ``big`` is the value used for a division of a non-zero change by zero.
    NULL when ``prev`` is NULL; NaN (0/0) is returned as NULL.
    """
    cur, prev = col(cur), col(prev)
    diff = cur - prev
    return (
        F.when(prev.isNull() | cur.isNull(), null_double())
        .when(prev == 0, F.when(diff > 0, F.lit(big)).when(diff < 0, F.lit(-big)).otherwise(null_double()))
        .otherwise(diff / prev)
    )


def row_sum(cols: Iterable[ColumnOrName]) -> Column:
    """pandas ``sum(axis=1)``: NaN skipped, all-NaN gives 0."""
    parts = [F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in cols]
    return sum(parts[1:], parts[0]) if parts else F.lit(0.0)


def row_count(cols: Iterable[ColumnOrName]) -> Column:
    parts = [col(c).isNotNull().cast("int") for c in cols]
    return sum(parts[1:], parts[0]) if parts else F.lit(0)


def row_mean(cols: Iterable[ColumnOrName]) -> Column:
    """pandas ``mean(axis=1)``: NaN skipped, all-NaN gives NULL."""
    cols = list(cols)
    return F.try_divide(row_sum(cols), row_count(cols).cast("double"))


def any_not_null(cols: Iterable[ColumnOrName]) -> Column:
    parts = [col(c).isNotNull() for c in cols]
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def is_true(cond: Column) -> Column:
    """A comparison with NULL is false (pandas NaN comparison rule)."""
    return F.coalesce(cond, F.lit(False))


def capitalize(c: ColumnOrName) -> Column:
    """Python ``str.capitalize``: first character upper, the rest lower."""
    c = col(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def norm_key(c: ColumnOrName) -> Column:
    """``astype(str).str.lower().str.strip()`` with NULL kept NULL."""
    return F.lower(F.trim(col(c).cast("string")))


def half_even(c: ColumnOrName, scale: int = 0) -> Column:
    """numpy/pandas ``round``: half to even (2.5 -> 2)."""
    return F.bround(col(c).cast("double"), scale)


def isin_false_on_null(c: ColumnOrName, values: Iterable) -> Column:
    return F.coalesce(col(c).isin(list(values)), F.lit(False))


def literal_map(mapping: dict) -> Column:
    """A literal ``map<k,v>`` built from a small fixed dict."""
    items = []
    for k, v in mapping.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def map_lookup(mapping: dict, key: ColumnOrName, default=None) -> Column:
    """Look a key up in a small fixed map; unmatched (or NULL key) gives ``default``."""
    m = literal_map(mapping)
    hit = F.try_element_at(m, col(key))
    if default is None:
        return hit
    return F.coalesce(hit, F.lit(default))


def word_or_number(c: ColumnOrName, words: dict[str, float]) -> Column:
    """Map known words (case-insensitive, trimmed); otherwise parse a number."""
    key = norm_key(c)
    return F.coalesce(map_lookup({k.lower(): float(v) for k, v in words.items()}, key), coerce_numeric(key))


def stable_hash_order(key: ColumnOrName, seed: int | str = 42) -> Column:
    """A portable pseudo-random order key: md5 of ``key#seed`` (hex string).

    md5 is standard, so any engine reproduces the same order; it is evaluated
    per row on the executors.
    """
    return F.md5(F.concat(col(key).cast("string"), F.lit(f"#{seed}")))


def unit_uniform(key: ColumnOrName, seed: int | str = 42, tag: str = "") -> Column:
    """Deterministic U[0,1) per row from md5 of (key, seed, tag): 52 bits of the digest."""
    h = F.md5(F.concat(col(key).cast("string"), F.lit(f"#{seed}#{tag}")))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(1 << 52)
