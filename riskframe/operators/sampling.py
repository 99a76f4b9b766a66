"""SMOTE oversampling (J10) over exact nearest neighbours (:mod:`.neighbours`).

Synthetic rows are an ``explode`` of replica numbers and one equi-join to the chosen neighbour: ``x + u * (nn - x)``, with
the neighbour and ``u`` drawn from md5 of (id, replica, seed), so any engine draws the same.  The replica count per
row is exact: ``n_new // n_min`` each, plus one for the first ``n_new % n_min`` rows in hash order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .neighbours import knn_within
from .splits import hash_rank


def draw(tag: str, digits: int, seed: int) -> Column:
    """An integer of ``digits`` hex digits out of md5 of the columns id and _j."""
    text = F.concat_ws("#", F.col("id").cast("string"), F.col("_j").cast("string"), F.lit(f"{seed}"), F.lit(tag))
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def smote(df: DataFrame, id_col: str, vec_col: str, label: str, minority=1, k: int = 5, seed: int = 42,
          n_new: int | None = None, tile_rows: int = 4096) -> DataFrame:
    """Add synthetic minority rows until the classes balance (or ``n_new`` rows).

    Output: (id_col, vec_col, label, is_synthetic); synthetic ids are negative
    and below every source id: ``lowest - (rank + replica * n_minority)``.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"),
                     F.col(label).alias("y"))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_min = counts.get(minority, 0)
    if n_new is None:
        n_new = max(counts.values(), default=0) - n_min
    original = rows.select(F.col("id").alias(id_col), F.col("vec").alias(vec_col), F.col("y").alias(label),
                           F.lit(False).alias("is_synthetic"))
    if n_min < 2 or n_new <= 0:
        return original
    kk = min(k, n_min - 1)
    mino = rows.filter(F.col("y") == minority).select("id", "vec")
    nn = knn_within(mino, "id", "vec", kk, tile_rows, seed=seed)
    base_rep, extra = divmod(n_new, n_min)
    lowest = min(0, rows.agg(F.min("id")).first()[0] or 0)
    ranked = hash_rank(mino, "id", [], seed)
    reps = ranked.withColumn("_reps", F.lit(base_rep) + (F.col("_rank") <= extra).cast("int"))
    rep = reps.filter(F.col("_reps") > 0).select(
        "id", "vec", "_rank", F.explode(F.sequence(F.lit(0), F.col("_reps") - 1)).alias("_j"))
    rep = rep.select("id", "vec", "_rank", "_j", F.pmod(draw("nn", 8, seed), F.lit(kk)).cast("int").alias("nn_rank"),
                     (draw("gap", 12, seed).cast("double") / float(1 << 48)).alias("_u"))
    pick = rep.join(nn.select(F.col("qid").alias("id"), "nn_rank", "rid"), ["id", "nn_rank"])
    nbr = mino.select(F.col("id").alias("rid"), F.col("vec").alias("_nv"))
    syn = pick.join(nbr, "rid").select(
        (F.lit(lowest) - (F.col("_rank") + F.col("_j").cast("long") * F.lit(n_min))).alias(id_col),
        F.zip_with("vec", "_nv", lambda a, b: a + F.col("_u") * (b - a)).alias(vec_col),
        F.lit(minority).alias(label), F.lit(True).alias("is_synthetic"))
    return original.unionByName(syn)
