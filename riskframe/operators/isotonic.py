"""Isotonic regression (J21, J22) without a list of blocks on the driver.

Rows collapse to one per distinct score.  The scores are cut into ranges of their order; pool-adjacent-violators runs in
each, which leaves a rising list of blocks per range.  Where the last block of a range lies above the first of the
next, the two ranges' blocks are pooled together, as one group with all neighbours that violate in a row, until no
border does.  Pooling a run of neighbouring blocks is exact whatever was pooled before, so the result is the
least-squares solution over all rows.  The driver sees two means and a count per range, never a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import scratch_path
from .ranks import in_ranges

BLOCK = "_range int, lo double, hi double, total double, weight double"
#: Neighbouring ranges are pooled in one group while they have at most so many blocks together (two always may).
GROUP_BLOCKS = 200_000
#: Up to so many knots are sent to the workers; a longer curve is looked up by sorting scores and knots together.
SENT_KNOTS = 100_000


def pooled(blocks: pd.DataFrame) -> pd.DataFrame:
    """Pool adjacent violators over blocks (lo, hi, total, weight) in the order of lo."""
    b = blocks.sort_values("lo")
    out: list[list[float]] = []
    for lo, hi, total, weight in zip(b["lo"], b["hi"], b["total"], b["weight"]):
        out.append([lo, hi, total, weight])
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            _, hi, total, weight = out.pop()
            out[-1][1:] = [hi, out[-1][2] + total, out[-1][3] + weight]
    return pd.DataFrame(out, columns=["lo", "hi", "total", "weight"])


def _written(df: DataFrame) -> DataFrame:
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "isotonic")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _pool(blocks: DataFrame, key: str) -> DataFrame:
    """The blocks of every group of ``key`` pooled; they take its number."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pooled(pdf)
        out.insert(0, "_range", np.int32(pdf[key].iloc[0]))
        return out

    return blocks.groupBy(key).applyInPandas(run, BLOCK)


def merges(ends: list[tuple[int, float, float, int]], most: int = GROUP_BLOCKS) -> dict[int, int]:
    """{range: first range of its group} for ranges (number, first mean, last mean, blocks) in order: runs of neighbours in
    which each last mean is not below the next first mean."""
    group: dict[int, int] = {}
    i = 0
    while i < len(ends):
        j, size = i, ends[i][3]
        while j + 1 < len(ends) and ends[j][2] >= ends[j + 1][1] and (j == i or size + ends[j + 1][3] <= most):
            j += 1
            size += ends[j][3]
        if j > i:
            group.update({r[0]: ends[i][0] for r in ends[i:j + 1]})
        i = j + 1
    return group


class IsotonicMap:
    """A fitted rising step curve, linear between its steps and level beyond its ends.  ``blocks`` has a row per step."""

    def __init__(self, blocks: DataFrame, count: int, score: str = "p", prediction: str = "p_cal"):
        self.blocks, self.count, self.score, self.prediction = blocks, count, score, prediction

    def setFeaturesCol(self, name: str) -> "IsotonicMap":
        self.score = name
        return self

    def setPredictionCol(self, name: str) -> "IsotonicMap":
        self.prediction = name
        return self

    def knots(self) -> DataFrame:
        """(x, y) at both ends of every step, once where they are one score."""
        ends = F.array_distinct(F.array("lo", "hi"))
        return self.blocks.select(F.explode(ends).alias("x"), (F.col("total") / F.col("weight")).alias("y"))

    def _sorted(self) -> list:
        return sorted((r["x"], r["y"]) for r in self.knots().collect())

    @property
    def boundaries(self) -> list[float]:
        return [x for x, _ in self._sorted()]

    @property
    def predictions(self) -> list[float]:
        return [y for _, y in self._sorted()]

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the prediction; a NULL or NaN score, or a curve without steps, gives NULL."""
        score = F.col(f"`{self.score}`").cast("double")
        if self.count == 0:
            return df.withColumn(self.prediction, F.lit(None).cast("double"))
        if 2 * self.count <= SENT_KNOTS:
            xs, ys = (np.array(v) for v in zip(*self._sorted()))

            @F.pandas_udf("double")
            def curve(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
                for s in batches:
                    yield pd.Series(np.interp(s.to_numpy(np.float64, na_value=np.nan), xs, ys))

            return df.withColumn(self.prediction, F.nanvl(curve(score), F.lit(None).cast("double")))
        return self.looked_up(df)

    def looked_up(self, df: DataFrame) -> DataFrame:
        """The same by sorting: distinct scores and knots in ranges of their order, the neighbouring knots by windows inside a
        range, and those of the ranges before and after by one row per range."""
        score = F.nanvl(F.col(f"`{self.score}`").cast("double"), F.lit(None).cast("double"))
        asked = df.select(score.alias("_x")).where("_x IS NOT NULL").distinct()
        knot = self.knots().select(F.col("x").alias("_x"), F.struct(F.col("x"), F.col("y")).alias("_k"))
        both = asked.withColumn("_k", F.lit(None).cast("struct<x:double,y:double>")).unionByName(knot)
        both = in_ranges(both.groupBy("_x").agg(F.max("_k").alias("_k")), [], "_x")
        inside = Window.partitionBy("_range").orderBy("_x")
        left = F.last("_k", True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        right = F.first("_k", True).over(inside.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        ends = both.groupBy("_range").agg(F.max("_k").alias("_last"), F.min("_k").alias("_first"))
        order = Window.orderBy("_range")  # a row per range
        ends = ends.select("_range",
                           F.last("_last", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
                           F.first("_first", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
        at = both.select("_x", "_range", left.alias("_l"), right.alias("_r")).join(ends, "_range")
        at = at.select("_x", F.coalesce("_l", "_before", "_r", "_after").alias("_l"), F.coalesce("_r", "_after", "_l", "_before").alias("_r"))
        x0, x1, y0, y1 = F.col("_l.x"), F.col("_r.x"), F.col("_l.y"), F.col("_r.y")
        y = F.when((x0 == x1) | (F.col("_x") <= x0), y0).when(F.col("_x") >= x1, y1).otherwise(
            (y1 - y0) / (x1 - x0) * (F.col("_x") - x0) + y0)
        found = at.select("_x", y.alias(self.prediction))
        return df.withColumn("_score", score).join(found, F.col("_score") == F.col("_x"), "left").drop("_score", "_x")

    def save(self, path: str) -> str:
        self.blocks.write.mode("overwrite").parquet(path)
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "IsotonicMap":
        blocks = spark.read.schema(BLOCK).parquet(path)
        return cls(blocks, blocks.count())


def isotonic_fit(scores: DataFrame, score: str = "p", label: str = "y", weight: str | None = None) -> IsotonicMap:
    """Isotonic map score -> calibrated probability (clips outside the fitted range).  Rows without a score, a label or a
    weight take no part; rows of equal score count as one with their mean label."""
    w = F.lit(1.0) if weight is None else F.col(f"`{weight}`").cast("double")
    x = F.nanvl(F.col(f"`{score}`").cast("double"), F.lit(None).cast("double"))
    rows = scores.select(x.alias("lo"), F.col(f"`{label}`").cast("double").alias("_y"), w.alias("_w")).dropna().where("_w > 0")
    table = rows.groupBy("lo").agg(F.sum(F.col("_y") * F.col("_w")).alias("total"), F.sum("_w").alias("weight"))
    ranged = in_ranges(table, [], "lo").withColumn("hi", F.col("lo"))
    blocks = _written(_pool(ranged, "_range"))
    mean = F.col("total") / F.col("weight")
    while True:
        ends = blocks.groupBy("_range").agg(F.min("lo").alias("lo"), F.min_by(mean, "lo").alias("first"), F.max_by(mean, "lo").alias("last"),
                                            F.count("*").alias("n")).collect()  # a row per range
        ends.sort(key=lambda r: r["lo"])
        group = merges([(r["_range"], r["first"], r["last"], r["n"]) for r in ends])
        if not group:
            return IsotonicMap(blocks, sum(r["n"] for r in ends), score)
        spark = scores.sparkSession
        to = F.broadcast(spark.createDataFrame(list(group.items()), "_range int, _group int"))  # at most a row per range
        known = blocks.join(to, "_range", "left")
        merged = _pool(known.where("_group IS NOT NULL").drop("_range"), "_group")
        blocks = _written(merged.unionByName(known.where("_group IS NULL").select(*blocks.columns)))
