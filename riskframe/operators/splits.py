"""Exact, distributed splits and weights (J5-J9, A4 cap).

The reference shuffles a list on the driver.  Here every record gets a portable
pseudo-random order key (md5 of key and seed; rows without a key hash their whole
content) and a bucket, the leading hex digits of that key.  A split needs only the
cut, not every rank: counts per (stratum, bucket) find the one bucket of each
stratum that holds the cut (:func:`mark_first`), only that bucket's rows are
ordered, and every other row is compared with the bucket's number.  Rows are not
shuffled.  :func:`hash_rank` gives full ranks where an operator needs them.

A NULL stratum is a stratum of its own.  The bucket prefix keeps the hash order, so
results do not depend on the number of digits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stable_hash_order


def bucket_digits(n: int, rows_per_bucket: int = 50_000) -> int:
    """Hex digits of the hash prefix for buckets of about ``rows_per_bucket`` rows; at most
    65,536 buckets, the table of their counts stays small."""
    return max(1, min(4, math.ceil(math.log(max(n, 1) / rows_per_bucket, 16)) if n > rows_per_bucket else 1))


def _hashed(df: DataFrame, key: str, seed: int, digits: int) -> DataFrame:
    row = F.md5(F.concat(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])), F.lit(f"#{seed}")))
    return df.withColumn("_h", F.coalesce(stable_hash_order(key, seed), row)).withColumn(
        "_bucket", F.conv(F.substring("_h", 1, digits), 16, 10).cast("int"))


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join on ``keys`` in which NULL matches NULL; the right side's keys are dropped."""
    renamed = right.select(*[F.col(f"`{k}`").alias(f"_k_{k}") for k in keys],
                           *[F.col(f"`{c}`") for c in right.columns if c not in keys])
    on = [left[k].eqNullSafe(renamed[f"_k_{k}"]) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_k_{k}" for k in keys])


def _bucket_offsets(h: DataFrame, strata: list[str], size_col: str) -> DataFrame:
    """Per (stratum, bucket): rows before it, its rows and the stratum's size (a table of counts)."""
    counts = h.groupBy(*strata, "_bucket").agg(F.count(F.lit(1)).alias("_bn"))
    ow = Window.partitionBy(*strata).orderBy("_bucket")
    return counts.select(
        *strata, "_bucket", "_bn",
        F.coalesce(F.sum("_bn").over(ow.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_bn").over(Window.partitionBy(*strata)).alias(size_col))


def hash_rank(df: DataFrame, key: str, strata: Sequence[str] = (), seed: int = 42,
              prefix_hex: int | None = None, rank_col: str = "_rank", size_col: str = "_stratum_n") -> DataFrame:
    """Add the exact 1-based rank of each row inside its stratum, ordered by md5(key#seed).
    NULL strata form a stratum; no row is lost."""
    strata = list(strata)
    h = _hashed(df, key, seed, prefix_hex or bucket_digits(df.count()))
    offsets = _bucket_offsets(h, strata, size_col).drop("_bn")
    within = Window.partitionBy(*strata, "_bucket").orderBy("_h", key)
    ranked = h.withColumn("_rn", F.row_number().over(within))
    out = _join_null_safe(ranked, offsets, [*strata, "_bucket"], "inner")
    return out.withColumn(rank_col, (F.col("_off") + F.col("_rn")).cast("long")).drop("_h", "_bucket", "_rn", "_off")


def mark_first(df: DataFrame, key: str, take: Callable[[Column], Column] | DataFrame, strata: Sequence[str] = (),
               seed: int = 42, out: str = "is_test") -> DataFrame:
    """Mark the first rows, in hash order, of each stratum.

    ``take`` gives their number: a function of the stratum's size, or a table
    (``strata``, n_take).  Sizes are exact: in the bucket that holds the cut rows are
    ranked, in the others the bucket's number decides.
    """
    strata = list(strata)
    h = _hashed(df, key, seed, bucket_digits(df.count()))
    offsets = _bucket_offsets(h, strata, "_n")
    if isinstance(take, DataFrame):
        offsets = _join_null_safe(offsets, take.select(*strata, "n_take"), strata, "inner")
    else:
        offsets = offsets.withColumn("n_take", take(F.col("_n")))
    cuts = offsets.where((F.col("_off") < F.col("n_take")) & (F.col("_off") + F.col("_bn") >= F.col("n_take")))
    cuts = cuts.select(*strata, F.col("_bucket").alias("_cut"), (F.col("n_take") - F.col("_off")).alias("_need"))
    if strata:
        placed = _join_null_safe(h, cuts, strata, "left")
    else:  # one row
        cut = cuts.first()
        placed = h.withColumn("_cut", F.lit(cut["_cut"] if cut else None).cast("int")).withColumn(
            "_need", F.lit(cut["_need"] if cut else None).cast("long"))
    at = F.col("_bucket").eqNullSafe(F.col("_cut"))
    clear = placed.where(~at).withColumn(out, F.coalesce(F.col("_bucket") < F.col("_cut"), F.lit(False)))
    within = Window.partitionBy(*strata, "_bucket").orderBy("_h", key)
    split = placed.where(at).withColumn(out, F.row_number().over(within) <= F.col("_need"))
    return clear.unionByName(split).drop("_h", "_bucket", "_cut", "_need")


def user_split(df: DataFrame, user: str = "user_id", source: str = "Source",
               primed_source: str = "Depression_14D", primed_train_frac: float = 0.4,
               train_frac: float = 0.8, seed: int = 42) -> DataFrame:
    """User-level split.  Users of ``primed_source``: first 40 % train,
    rest test; all other users: first 80 % train, rest val.  Cut = floor(frac * n).
    Returns ``df`` with a ``Split`` column (joined back on the user key)."""
    split = user_split_table(df, user, source, primed_source, primed_train_frac, train_frac, seed)
    return _join_null_safe(df, split, [user], "left")


def user_split_table(df: DataFrame, user: str = "user_id", source: str = "Source",
                     primed_source: str = "Depression_14D", primed_train_frac: float = 0.4,
                     train_frac: float = 0.8, seed: int = 42) -> DataFrame:
    """The split itself, one row per user: (``user``, Split)."""
    users = df.select(user, F.col(source)).groupBy(user).agg(
        F.coalesce(F.max(F.col(source) == primed_source), F.lit(False)).alias("_primed"))
    # the distinct-user table feeds the counts and the marks: written once to the
    # shared checkpoint folder instead of re-scanning the row table for each
    users = users.checkpoint()
    sizes = users.groupBy("_primed").agg(F.count(F.lit(1)).alias("_n"))
    frac = F.when(F.col("_primed"), F.lit(primed_train_frac)).otherwise(F.lit(train_frac))
    take = sizes.select("_primed", F.floor(F.col("_n") * frac).alias("n_take"))
    marked = mark_first(users, user, take, ["_primed"], seed, "_train")
    return marked.select(
        user, F.when(F.col("_train"), "train").when(F.col("_primed"), "test").otherwise("val").alias("Split"))


def holdout_split(df: DataFrame, key: str, test_frac: float = 0.2, seed: int = 42,
                  strata: Sequence[str] = ()) -> DataFrame:
    """J6 (and J5 with ``strata``): mark ``is_test``; n_test = ceil(test_frac * n) per stratum
    when ``strata`` is given through :func:`stratified_split`, else overall."""
    if strata:
        return stratified_split(df, key, strata, test_frac, seed)
    return mark_first(df, key, lambda n: F.ceil(n * test_frac), seed=seed)


def stratified_allocation(df: DataFrame, strata: Sequence[str], test_frac: float = 0.2) -> DataFrame:
    """Per-stratum test counts: total ceil(frac*n), floor per stratum, the rest
    by largest remainder (ties by stratum name).  Works on the small strata table."""
    strata = list(strata)
    counts = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n_s"))
    total = Window.partitionBy()
    c = counts.withColumn("n", F.sum("n_s").over(total))
    c = c.withColumn("n_test_total", F.ceil(F.col("n") * test_frac))
    c = c.withColumn("exact", F.col("n_test_total") * F.col("n_s") / F.col("n"))
    c = c.withColumn("base", F.floor("exact"))
    c = c.withColumn("left", F.col("n_test_total") - F.sum("base").over(total))
    order = [F.col("exact") - F.col("base").cast("double")]
    rw = Window.orderBy(order[0].desc(), *[F.col(s).asc() for s in strata])
    c = c.withColumn("_r", F.row_number().over(rw))
    return c.select(*strata, "n_s", (F.col("base") + (F.col("_r") <= F.col("left")).cast("long")).alias("n_test"))


def stratified_split(df: DataFrame, key: str, strata: Sequence[str], test_frac: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Exact stratified hold-out; the first ``n_test`` rows of each stratum by hash order are test."""
    strata = list(strata)
    alloc = stratified_allocation(df, strata, test_frac).withColumnRenamed("n_test", "n_take")
    return mark_first(df, key, alloc, strata, seed)


def cap_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """A4: keep exactly ``min(n, rows)`` rows chosen by hash order (deterministic)."""
    marked = mark_first(df, key, lambda rows: F.least(rows, F.lit(n)), seed=seed, out="_kept")
    return marked.filter("_kept").drop("_kept")


def source_weight(df: DataFrame, weights: dict, source: str = "DatasetSource", default: float = 1.0,
                  name: str = "sample_weight") -> DataFrame:
    """Per-source sample weight from a small fixed map."""
    from ..functions import map_lookup
    return df.withColumn(name, map_lookup({k: float(v) for k, v in weights.items()}, source, float(default)))


def class_weights(df: DataFrame, label: str = "Target", boost: dict | None = None,
                  name: str = "class_weight") -> DataFrame:
    """Balanced weights n / (k * n_c), optionally multiplied per class; one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy()
    out = counts.withColumn("n", F.sum("n_c").over(w)).withColumn("k", F.count(F.lit(1)).over(w))
    weight = F.col("n") / (F.col("k") * F.col("n_c"))
    if boost:
        from ..functions import map_lookup
        weight = weight * map_lookup({int(k): float(v) for k, v in boost.items()}, label, 1.0)
    return out.select(label, "n_c", weight.alias(name))
