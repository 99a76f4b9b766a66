"""ML preparation (J1-J4) as fit/transform pairs over DataFrames.

Fitting is one aggregation whose small result (medians, means, category
lists) is kept as a model; transforming is a projection with literals, so it
runs inside whole-stage codegen on the executors.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .aggregates import collect_medians


#: Rows of a fit that one task reads, pass after pass.
ROWS_PER_TASK = 200_000


def spread(df: DataFrame, n: int) -> DataFrame:
    """``df``, of about ``n`` rows, dealt out so that no task of the fits on it holds much more than ``ROWS_PER_TASK`` rows:
    the number of tasks grows with the rows, whatever files or shuffles ``df`` comes from.  Small tables stay as they are."""
    if n <= ROWS_PER_TASK:
        return df
    return df.repartition(max(math.ceil(n / ROWS_PER_TASK), df.sparkSession.sparkContext.defaultParallelism))


@dataclass
class MedianImputer:
    """Exact median imputation fitted on the training rows."""
    columns: Sequence[str]
    exact: bool = True
    medians: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> "MedianImputer":
        self.medians = collect_medians(df, self.columns, self.exact)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(m).cast("double"))
                               for c, m in self.medians.items()})


@dataclass
class PopulationScaler:
    """Z-score with the population std (ddof=0); a constant column scales by 1."""
    columns: Sequence[str]
    stats: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> "PopulationScaler":
        aggs = []
        for c in self.columns:
            aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
        row = df.agg(*aggs).first()
        self.stats = {c: (row[f"{c}__mean"], row[f"{c}__std"]) for c in self.columns}
        return self

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        out = {}
        for c, (mean, std) in self.stats.items():
            scale = 1.0 if (std is None or std == 0) else float(std)
            out[c + suffix] = (F.col(c) - F.lit(mean).cast("double")) / scale
        return df.withColumns(out)


@dataclass
class OneHot:
    """One 0/1 column per category seen in training; unknown -> all zero.

    ``drop_first`` drops the first level in sorted order (pandas ``get_dummies``).
    """
    column: str
    drop_first: bool = False
    prefix: str | None = None
    categories: list = field(default_factory=list)
    max_levels: int = 5_000

    def fit(self, df: DataFrame) -> "OneHot":
        """One output column per level, so all levels reach the driver: beyond ``max_levels`` the fit raises, and
        :class:`OneHotLong` does the same with a row per level."""
        distinct = df.select(self.column).filter(F.col(self.column).isNotNull()).distinct().limit(self.max_levels + 1)
        levels = [r[0] for r in distinct.collect()]
        if len(levels) > self.max_levels:
            raise ValueError(f"{self.column}: more than {self.max_levels} levels; use OneHotLong")
        self.categories = sorted(levels)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        levels = self.categories[1:] if self.drop_first else self.categories
        pre = self.prefix or self.column
        return df.withColumns({f"{pre}_{v}": F.coalesce((F.col(self.column) == F.lit(v)).cast("double"), F.lit(0.0))
                               for v in levels})


@dataclass
class OneHotLong:
    """J3 / J4 for any number of levels: the encoding as the position of the one that is set.

    ``fit`` numbers the training levels from 0 in sorted order, as a table (level, index) that is written once; ranges
    of levels are numbered apart and joined with the counts before them, so no task and no driver holds all levels.
    ``transform`` adds ``<prefix>_index``: the number, or NULL where all columns of the wide form would be 0 (NULL, a
    level that training has not seen, or the dropped first level).  Row for row it says what :class:`OneHot` says.
    """
    column: str
    drop_first: bool = False
    prefix: str | None = None
    levels: DataFrame | None = None

    def fit(self, df: DataFrame) -> "OneHotLong":
        from .ranks import before_in_order, in_ranges
        distinct = df.select(F.col(self.column).alias("level")).where("level is not null").distinct()
        ranged = in_ranges(distinct, [], "level")
        sums = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.min("level").alias("least"))
        before = before_in_order(sums.withColumn("_all", F.lit(0)), ["_all"], "least", ["n"]).select("_range", "n_before")
        place = F.row_number().over(Window.partitionBy("_range").orderBy("level")) - 1
        self.levels = (ranged.withColumn("place", place).join(before, "_range")
                       .select("level", (F.col("n_before") + F.col("place") - int(self.drop_first)).alias("index"))
                       .where("index >= 0").checkpoint())
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        name = f"{self.prefix or self.column}_index"
        levels = self.levels.select(F.col("level").alias("_level"), F.col("index").alias(name))
        return df.join(levels, df[self.column] == levels["_level"], "left").drop("_level")
