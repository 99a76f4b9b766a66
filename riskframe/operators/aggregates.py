"""Aggregations (D1-D16).  Every statistic over many columns is one ``agg``
(one scan, partial aggregation before the exchange); results are small
metric tables.  Only those tables (never rows) are ever collected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .ranks import null_safe, quantiles

NUMERIC_TYPES = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.DecimalType)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in set(exclude)]


def _stack(wide: DataFrame, columns: Sequence[str], value: str, keys: Sequence[str] = ()) -> DataFrame:
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    return wide.selectExpr(*[f"`{k}`" for k in keys], f"stack({len(columns)}, {pairs}) AS (column, {value})")


def medians(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """Median per column (per group when ``by``), wide.  Exact ones come from distributed ranks
    (:mod:`.ranks`); ``exact=False`` takes ``percentile_approx`` in one aggregation."""
    if not exact:
        aggs = [F.percentile_approx(F.col(f"`{c}`").cast("double"), 0.5, 100000).alias(c) for c in columns]
        return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    return quantiles(df, columns, [0.5], by).withColumnsRenamed({f"q0_{i}": c for i, c in enumerate(columns)})


def collect_medians(df: DataFrame, columns: Sequence[str], exact: bool = True) -> dict[str, float | None]:
    """Global medians as a small dict (one row reaches the driver)."""
    if not columns:
        return {}
    row = medians(df, columns, (), exact).first()
    return {c: (None if row[c] is None else float(row[c])) for c in columns}


def group_median_fill(df: DataFrame, columns: Sequence[str], by: str = "DatasetSource", exact: bool = True) -> DataFrame:
    """C2 + D3: fill with the group's median, falling back to the global median.

    Group medians are a small table (one row per source) joined back on the
    source key (AQE broadcasts it once its measured size is small); the global
    medians are one row, brought to the driver and applied as literals.  Both come
    from the same scans: every value counts for its group and for the whole.
    """
    both = F.explode(F.array(F.struct(F.lit(False).alias("_all"), F.col(f"`{by}`").alias("_by")),
                             F.struct(F.lit(True).alias("_all"), F.lit(None).alias("_by"))))
    rows = df.select(*[F.col(f"`{c}`") for c in columns], both.alias("_k")).select(*[F.col(f"`{c}`") for c in columns], "_k.*")
    found = medians(rows, columns, ["_all", "_by"], exact).checkpoint()  # a row per group
    total = found.where("_all").first()
    glob = {c: None if total is None else total[c] for c in columns}
    per = found.where("NOT _all AND _by IS NOT NULL").select(F.col("_by").alias(by), *[F.col(f"`{c}`").alias(f"_gm_{c}") for c in columns])
    out = df.join(per, on=by, how="left")
    filled = {c: F.coalesce(F.col(c), F.col(f"_gm_{c}"), F.lit(glob[c]).cast("double")) for c in columns}
    return out.withColumns(filled).drop(*[f"_gm_{c}" for c in columns])


def global_median_fill(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """Fill NULLs with the global median of each column (pandas ``fillna(median())``)."""
    glob = collect_medians(df, columns, exact)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(glob[c]).cast("double")) for c in columns})


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count / mean / std / min / 25% / 50% / 75% / max per column (exact quartiles).

    One wide aggregation, and the quartiles of all columns from one pass of distributed ranks; then one row per column.
    """
    aggs = []
    for c in columns:
        aggs += [F.count(c).cast("double").alias(f"{c}__count"), F.avg(c).alias(f"{c}__mean"),
                 F.stddev_samp(c).alias(f"{c}__std"), F.min(c).cast("double").alias(f"{c}__min"),
                 F.max(c).cast("double").alias(f"{c}__max")]
    stats = ["count", "mean", "std", "min", "max"]
    structs = ", ".join(f"'{c}', " + ", ".join(f"`{c}__{s}`" for s in stats) for c in columns)
    moments = df.agg(*aggs).selectExpr(f"stack({len(columns)}, {structs}) AS (column, {', '.join(stats)})")
    quarts = ["q25", "q50", "q75"]
    structs = ", ".join(f"'{c}', " + ", ".join(f"q{j}_{i}" for j in range(3)) for i, c in enumerate(columns))
    cuts = quantiles(df, columns, [0.25, 0.5, 0.75]).selectExpr(
        f"stack({len(columns)}, {structs}) AS (column, {', '.join(quarts)})")
    return moments.join(cuts, "column").select("column", "count", "mean", "std", "min", *quarts, "max")


def dup_count(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Number of rows that duplicate an earlier row (rows - distinct rows)."""
    cols = list(subset or df.columns)
    groups = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.sum(F.col("_n") - 1).cast("long").alias("duplicates"),
                      F.sum("_n").cast("long").alias("rows"), F.count(F.lit(1)).cast("long").alias("distinct_rows"))


def value_share(df: DataFrame, column: str) -> DataFrame:
    """Normalised value counts (NULL values dropped, as pandas) with a percent label."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0  # one number; the values stay spread
    share = counts.withColumn("share", F.col("n") / F.lit(total))
    return share.withColumn("share_pct", F.format_string("%.1f%%", F.col("share") * 100))


def source_coverage(df: DataFrame, columns: Sequence[str], source: str = "DatasetSource",
                    target: str = "RiskCategory") -> DataFrame:
    """Per source, share of rows with any listed column non-null, rows, target rate."""
    from ..functions import any_not_null
    return df.groupBy(source).agg(
        (F.avg(any_not_null(columns).cast("double")) * 100).alias("coverage_pct"),
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.col(target).cast("double")).alias("target_rate"),
    )


def quantile_label(df: DataFrame, column: str, q: float = 0.85, out: str = "label",
                   inclusive: bool = True) -> DataFrame:
    """label = value at or above the interpolated q-quantile (``inclusive``,
    as the reference's ``>=``; strict ``>`` otherwise).  Null values label 0.
    The cut is one number from distributed ranks."""
    cut = quantiles(df, [column], [q]).first()[0]
    x = F.col(column)
    hit = x >= F.lit(cut) if inclusive else x > F.lit(cut)
    return df.withColumn(out, F.coalesce(hit, F.lit(False)).cast("int"))


def mode_by_group(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Most frequent value; ties resolved to the smallest value; NULL for a group without values.
    Values are counted first, so no task holds a group's values."""
    counts = df.groupBy(*by, F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min_by("_v", F.struct(F.col("_v").isNull(), -F.col("_n"), F.col("_v"))).alias(f"{column}_mode")
    return counts.groupBy(*by).agg(best) if by else counts.agg(best)


def distinct_count(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct values per group."""
    agg = F.count_distinct(column).alias(f"distinct_{column}")
    return df.groupBy(*by).agg(agg) if by else df.agg(agg)


def min_max(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Min and max per column, long form."""
    aggs = []
    for c in columns:
        aggs += [F.min(c).cast("double").alias(f"{c}__min"), F.max(c).cast("double").alias(f"{c}__max"),
                 F.count(c).alias(f"{c}__n")]
    wide = df.agg(*aggs)
    pairs = ", ".join(f"'{c}', `{c}__min`, `{c}__max`, `{c}__n`" for c in columns)
    return wide.selectExpr(f"stack({len(columns)}, {pairs}) AS (column, min, max, non_null)")


def pos_weight(df: DataFrame, label: str = "RiskCategory") -> DataFrame:
    """Negatives / positives (``scale_pos_weight``)."""
    y = F.col(label)
    return df.agg(F.sum((y == 0).cast("long")).alias("negatives"), F.sum((y == 1).cast("long")).alias("positives")) \
        .withColumn("scale_pos_weight", F.try_divide(F.col("negatives").cast("double"), F.col("positives")))


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation for every column pair, one aggregation, long form.

    Pairwise-complete like pandas ``corr``: each pair uses rows where both are non-null.
    """
    aggs = []
    pairs = []
    for i, a in enumerate(columns):
        for b in columns[i:]:
            name = f"{a}__{b}"
            aggs.append(F.corr(a, b).alias(name))
            pairs.append((a, b, name))
    wide = df.agg(*aggs)
    rows = []
    for a, b, name in pairs:
        rows.append(f"'{a}', '{b}', `{name}`")
        if a != b:
            rows.append(f"'{b}', '{a}', `{name}`")
    return wide.selectExpr(f"stack({len(rows)}, {', '.join(rows)}) AS (col_a, col_b, corr)")


def importance_share(imp: DataFrame, feature: str = "feature", value: str = "importance") -> DataFrame:
    """Mean |importance| per feature and its percent share of the total."""
    per = imp.groupBy(feature).agg(F.avg(F.abs(F.col(value))).alias("mean_abs"))
    return per.withColumn("share_pct", F.col("mean_abs") / F.sum("mean_abs").over(Window.partitionBy()) * 100)


def minmax10(df: DataFrame, columns: Sequence[str], words: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """H9: per column: numeric coerce, median fill, then min-max to 0-10.

    ``words`` {column: {Word: number}} maps text columns first (trimmed, capitalised);
    there anything else, NULL too, is 5.
    A column with no values becomes 5; a column without spread becomes 5.
    Statistics come from one aggregation (one small row on the driver).
    """
    from ..functions import capitalize, map_lookup, numeric_col
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    mapped = {c: w for c, w in (words or {}).items() if c in texts}
    num = df.withColumns({c: map_lookup(mapped[c], capitalize(F.trim(F.col(c))), 5.0) if c in mapped else numeric_col(df, c)
                          for c in [*columns, *[c for c in mapped if c not in columns]]})
    med = collect_medians(num, columns)
    filled = num.withColumns({c: F.coalesce(F.col(c), F.lit(med[c]).cast("double")) for c in columns})
    row = filled.agg(*[F.min(c).alias(f"{c}__lo") for c in columns], *[F.max(c).alias(f"{c}__hi") for c in columns]).first()
    out = {}
    for c in columns:
        lo, hi = row[f"{c}__lo"], row[f"{c}__hi"]
        if med[c] is None or lo is None or not hi > lo:
            out[c] = F.lit(5.0)
        else:
            out[c] = 10 * (F.col(c) - F.lit(lo)) / F.lit(hi - lo)
    return filled.withColumns(out)
