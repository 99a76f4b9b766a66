"""Exact ranks in a global order without a one-task sort, and exact quantiles by brackets.

For ranks, rows are collapsed to distinct values with counts, range-partitioned by (group, value) and written once with the
number of their range.  A small table of range totals then gives the counts that lie before each range, and only
inside a range are values ordered.  Ranges follow the data, so a hot group or a narrow value range is spread over many
tasks.  NULL group keys form a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner equi-join in which NULL keys match NULL keys; the right side's keys are dropped."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [left[k].eqNullSafe(right[f"_r_{k}"]) for k in keys]
    return left.join(right, on, "inner").drop(*[f"_r_{k}" for k in keys])


def in_ranges(values: DataFrame, keys: Sequence[str], value: str, out: str = "_range") -> DataFrame:
    """``values`` (one row per distinct value of each group) with its range number, cut off from its lineage.
    Ranges of one group do not overlap; their numbers only name them."""
    ranged = values.repartitionByRange(*[F.col(k) for k in keys], F.col(value))
    return ranged.withColumn(out, F.spark_partition_id()).checkpoint()


def before_in_order(sums: DataFrame, keys: Sequence[str], top: str, sizes: Sequence[str],
                    descending: bool = False) -> DataFrame:
    """For the table of range totals: ``<size>_before`` and ``<size>_total`` of the group, for each size column."""
    order = F.col(top).desc() if descending else F.col(top).asc()
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    return sums.select("*", *[(F.sum(s).over(before) - F.col(s)).alias(f"{s}_before") for s in sizes],
                       *[F.sum(s).over(whole).alias(f"{s}_total") for s in sizes])


#: Accuracy of the sketch, and half the width of a bracket as a share of the rows: five times the sketch's rank error.
ACCURACY = 2000
HALF_WIDTH = 5 / ACCURACY
#: A group of fewer values than this, or one with NaN, has all its values inside its brackets.
FEW = 4 / HALF_WIDTH
#: Above so many values inside all brackets they are ranked in ranges, below by one window per group and column.
RANGED_ABOVE = 5_000_000
#: Brackets of at most so many groups go to the driver and are broadcast; those of more are a joined table.
FEW_GROUPS = 10_000


def _brackets(df: DataFrame, groups: Sequence[str], cols: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """Per group, for column i: n_i, and for quantile j of it the bracket lo_i_j .. hi_i_j that holds its two ranks."""
    ends = [e for q in qs for e in (max(0.0, q - HALF_WIDTH), min(1.0, q + HALF_WIDTH))]
    aggs = []
    for i, c in enumerate(cols):
        plain = F.nanvl(c, F.lit(None).cast("double"))
        aggs += [F.count(c).alias(f"n_{i}"), F.count(plain).alias(f"plain_{i}"), F.min(c).alias(f"min_{i}"), F.max(c).alias(f"max_{i}"),
                 F.percentile_approx(plain, ends, ACCURACY).alias(f"s_{i}")]
    sketch = df.groupBy(*groups).agg(*aggs)
    out = [f"n_{i}" for i in range(len(cols))]
    for i in range(len(cols)):
        whole = (F.col(f"n_{i}") < FEW) | (F.col(f"plain_{i}") < F.col(f"n_{i}"))
        for j, q in enumerate(qs):
            low, high = F.col(f"s_{i}")[2 * j], F.col(f"s_{i}")[2 * j + 1]
            out.append(F.when(whole | F.lit(q <= HALF_WIDTH), F.col(f"min_{i}")).otherwise(low).alias(f"lo_{i}_{j}"))
            out.append(F.when(whole | F.lit(q >= 1 - HALF_WIDTH), F.col(f"max_{i}")).otherwise(high).alias(f"hi_{i}_{j}"))
    return sketch.select(*groups, *out)


def _ordered(counts: DataFrame, keys: Sequence[str], ranged: bool) -> DataFrame:
    """``counts`` with _end, the number of values of the group up to each distinct value."""
    if not ranged:
        upto = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return counts.withColumn("_end", F.sum("_n").over(upto))
    counts = in_ranges(counts, keys, "_v")
    sums = counts.groupBy(*keys, "_range").agg(F.sum("_n").alias("_size"), F.max("_v").alias("_top"))
    sums = before_in_order(sums, keys, "_top", ["_size"]).select(*keys, "_range", "_size_before")
    upto = Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = null_safe(counts, sums, [*keys, "_range"])
    return placed.withColumn("_end", F.sum("_n").over(upto) + F.col("_size_before"))


def quantiles(df: DataFrame, columns: Sequence[str], qs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact interpolated quantiles of every column, wide: ``by`` columns, then ``q<j>_<i>`` for quantile j of column i.

    A mergeable sketch brackets every wanted quantile.  A second scan counts the values below each bracket and keeps the
    few inside (about ``2 * HALF_WIDTH`` of the rows), both folded in the task; only those counts are shuffled, put in
    order and read off at the wanted rank.  A sketch that missed its bound would raise an error.  NULLs are left out, NaN
    is the largest value; a group without a value in a column gets NULL.  Without ``by`` the result is one row.
    """
    spark = df.sparkSession
    groups = [f"_g{i}" for i in range(len(by))]
    names = [f"_c{i}" for i in range(len(columns))]
    rows = df.select(*[F.col(f"`{b}`").alias(g) for b, g in zip(by, groups)],
                     *[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(columns, names)])
    cells = [(i, j) for i in range(len(columns)) for j in range(len(qs))]
    brackets = _brackets(rows, groups, [F.col(n) for n in names], qs)
    if groups:
        few = brackets.limit(FEW_GROUPS + 1).collect()
        brackets = brackets.checkpoint() if len(few) > FEW_GROUPS else F.broadcast(spark.createDataFrame(few, brackets.schema))
        placed = null_safe(rows, brackets, groups)
        most = max([r[f"n_{i}"] for r in few for i in range(len(columns))], default=0) * len(few)
    else:
        only = brackets.first()
        placed = rows.withColumns({c: F.lit(only[c]).cast(t) for c, t in brackets.dtypes})
        most = max(only[f"n_{i}"] for i in range(len(columns)))

    def entry(i: int, j: int) -> Column:
        v, low = F.col(names[i]), F.col(f"lo_{i}_{j}")
        kept = F.when((v < low) | (v <= F.col(f"hi_{i}_{j}")), F.struct(
            F.lit(i).alias("_i"), F.lit(j).alias("_j"), F.when(v >= low, v).alias("_v")))  # below: one row without a value
        return kept

    keys = [*groups, "_i", "_j"]
    entries = placed.select(*groups, F.explode(F.array(*[entry(i, j) for i, j in cells])).alias("_e")).where(F.col("_e").isNotNull())
    counts = entries.select(*groups, "_e.*").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    ranged = 2 * HALF_WIDTH * most * len(cells) > RANGED_ABOVE
    ordered = _ordered(counts, keys, ranged)

    size = F.element_at(F.array(*[F.col(f"n_{i}") for i in range(len(columns))]), F.col("_i") + 1)
    totals = [f"n_{i}" for i in range(len(columns))]
    if groups:
        sized = null_safe(ordered, brackets.select(*groups, *totals), groups)
    else:
        sized = ordered.withColumns({c: F.lit(only[c]) for c in totals})
    q = F.element_at(F.array(*[F.lit(float(v)) for v in qs]), F.col("_j") + 1)
    sized = sized.withColumn("_pos", q * (size - 1))
    at_low, at_high = (F.min(F.when(F.col("_end") > f(F.col("_pos")), F.col("_v"))) for f in (F.floor, F.ceil))
    ends = sized.groupBy(*keys).agg(at_low.alias("_low"), at_high.alias("_high"), F.max("_pos").alias("_pos"),
                                    F.max(F.when(F.col("_v").isNull(), F.col("_end"))).alias("_below"))
    lo, hi, pos = F.col("_low"), F.col("_high"), F.col("_pos")
    value = F.when(lo == hi, lo).otherwise((F.ceil(pos) - pos) * lo + (pos - F.floor(pos)) * hi)
    missed = F.raise_error(F.lit("quantiles: a bracket missed its rank")).cast("double")
    outside = lo.isNull() | hi.isNull() | F.coalesce(F.col("_below") > F.floor(pos), F.lit(False))
    found = ends.select(*groups, "_i", "_j", F.when(outside, missed).otherwise(value).alias("_q"))
    if groups:  # keeps groups without a value
        found = found.unionByName(brackets.select(*groups, F.lit(-1).alias("_i"), F.lit(-1).alias("_j"), F.lit(None).cast("double").alias("_q")))
    out = found.groupBy(*groups).agg(*[
        F.max(F.when((F.col("_i") == i) & (F.col("_j") == j), F.col("_q"))).alias(f"q{j}_{i}") for i, j in cells])
    return out.withColumnsRenamed(dict(zip(groups, by)))
