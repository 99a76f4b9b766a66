"""Exact Shapley values of a fitted forest (tree SHAP, path-dependent) and their means per feature (J14's third list).

A leaf answers ``value`` times one factor per feature of its path: 1 or 0 for a known feature (does the row take the path's
turns at it?), the share of the training rows that take them for an unknown one.  The Shapley values of such a product
depend on the row by these bits alone, so a leaf of ``d`` features needs one table of ``2 ** d`` lines, made once per task.
Rows are read once, on the executors; only one sum per feature leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import blocks as BL
from .prep import MedianImputer, spread
from .train import classifier, fits_in_blocks

#: Leaves with more features than this get no table; the bits that occur in a batch are worked out instead.
TABLE_FEATURES = 10


@dataclass
class Leaf:
    """A leaf's path: per feature the bounds (``low`` < x <= ``high``) and the share of rows inside them, and the value."""
    features: list[int]
    low: list[float]
    high: list[float]
    share: list[float]
    value: float

    def bits(self, x: np.ndarray) -> np.ndarray:
        """Bit j says that the row lies within the bounds of feature j.  NaN goes right at every split, as in Spark."""
        out = np.zeros(len(x), np.int64)
        for j, f in enumerate(self.features):
            inside = np.ones(len(x), bool)
            if self.low[j] > -np.inf:
                inside &= ~(x[:, f] <= self.low[j])
            if self.high[j] < np.inf:
                inside &= x[:, f] <= self.high[j]
            out |= inside.astype(np.int64) << j
        return out

    def shapley(self, bits: np.ndarray) -> np.ndarray:
        """(bits, feature) Shapley values: the polynomial over the other features counts the known ones."""
        d = len(self.features)
        known = (bits[:, None] >> np.arange(d) & 1).astype(np.float64)
        weights = np.array([1 / (d * comb(d - 1, s)) for s in range(d)])
        out = np.empty((len(bits), d))
        for i in range(d):
            c = np.zeros((len(bits), d))
            c[:, 0] = 1.0
            for j in range(d):
                if j != i:
                    c[:, 1:] = c[:, 1:] * self.share[j] + c[:, :-1] * known[:, j:j + 1]
                    c[:, 0] *= self.share[j]
            out[:, i] = self.value * (known[:, i] - self.share[i]) * (c @ weights)
        return out


def walk(split, weight, value) -> list[Leaf]:
    """The leaves below node 0: ``split(i)`` is (feature, cut, left, right) or None, ``weight(i)`` and ``value(i)`` a node's."""
    leaves, todo = [], [(0, {})]
    while todo:
        at, bounds = todo.pop()
        found = split(at)
        if found is None:
            if bounds and value(at):
                f = sorted(bounds)
                low, high, share = zip(*[bounds[i] for i in f])
                leaves.append(Leaf(f, list(low), list(high), list(share), value(at)))
            continue
        f, cut, left, right = found
        low, high, share = bounds.get(f, (-np.inf, np.inf, 1.0))
        for child, own in ((left, (low, min(high, cut))), (right, (max(low, cut), high))):
            todo.append((child, {**bounds, f: (*own, share * weight(child) / weight(at))}))
    return leaves


def forest_leaves(spark: SparkSession, model, cls: int = 1) -> list[list[Leaf]]:
    """The leaves of every tree of a forest of continuous features, with the probability of class ``cls`` as their value."""
    path = scratch_path(spark, "shap-forest")
    model.write().save(path)
    trees: dict[int, dict] = {}
    for r in spark.read.parquet(f"{path}/data").collect():  # trees x nodes
        trees.setdefault(r["treeID"], {})[r["nodeData"]["id"]] = r["nodeData"]

    def leaves(nodes: dict) -> list[Leaf]:
        def split(i):
            n = nodes[i]
            return None if n["leftChild"] < 0 else (n["split"]["featureIndex"], n["split"]["leftCategoriesOrThreshold"][0],
                                                    n["leftChild"], n["rightChild"])

        def value(i):
            stats = nodes[i]["impurityStats"]
            return stats[cls] / sum(stats) if len(stats) > cls and sum(stats) else 0.0

        return walk(split, lambda i: sum(nodes[i]["impurityStats"]), value)

    return [leaves(nodes) for _, nodes in sorted(trees.items())]


def block_leaves(trees: Sequence[BL.Tree], edges: Sequence[np.ndarray]) -> list[list[Leaf]]:
    """The same of a forest that was grown on blocks."""
    out = []
    for t in trees:
        inner, value = t.cutoff(t.depth, True)
        out.append(walk(lambda i: (int(t.feature[i]), float(edges[t.feature[i]][t.cut[i]]), int(t.left[i]), int(t.left[i]) + 1) if inner[i] else None,
                        lambda i: float(t.w[i]), lambda i: float(value[i])))
    return out


def shap_values(trees: Sequence[Sequence[Leaf]], dim: int):
    """A function from (rows, ``dim``) values to their Shapley values, the mean over the trees."""
    tables = {}

    def values(x: np.ndarray) -> np.ndarray:
        total = np.zeros((len(x), dim))
        for t, leaves in enumerate(trees):
            for i, leaf in enumerate(leaves):
                bits = leaf.bits(x)
                if len(leaf.features) <= TABLE_FEATURES:
                    if (t, i) not in tables:
                        tables[t, i] = leaf.shapley(np.arange(1 << len(leaf.features)))
                    found = tables[t, i][bits]
                else:
                    seen, place = np.unique(bits, return_inverse=True)
                    found = leaf.shapley(seen)[place]
                for j, f in enumerate(leaf.features):
                    total[:, f] += found[:, j]
        return total / max(len(trees), 1)

    return values


def mean_abs_shap(df: DataFrame, features: Sequence[str], trees: Sequence[Sequence[Leaf]]) -> DataFrame:
    """(feature, shap): the mean absolute Shapley value of each feature over all rows of ``df``."""
    names = list(features)
    dim = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, total, n = shap_values(trees, dim), np.zeros(dim), 0
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            total += np.abs(values(x)).sum(axis=0)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(total), pa.array([n] * dim, pa.int64())],
                                         names=["feature", "total", "n"])

    rows = df.select(F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in names]).alias("x"))
    sums = rows.mapInArrow(run, "feature string, total double, n long").groupBy("feature").agg(F.sum("total").alias("t"), F.sum("n").alias("n"))
    return sums.select("feature", F.when(F.col("n") > 0, F.col("t") / F.col("n")).otherwise(0.0).alias("shap"))


def forest_shap(spark: SparkSession, df: DataFrame, features: Sequence[str], label: str, **params) -> DataFrame:
    """A forest on all ``features`` (missing values take their median) and its mean absolute Shapley values over the
    rows it was fitted on, as a (feature, shap) table."""
    n = df.count()
    imp = MedianImputer(list(features)).fit(df)
    opts = {"numTrees": 50, "maxDepth": 8, "minInstancesPerNode": 1, "seed": 42, **params}
    if fits_in_blocks(df, n, label, opts, ("numTrees", "maxDepth", "minInstancesPerNode", "seed"), opts["maxDepth"]):
        filled = imp.transform(df)
        edges = BL.find_edges(filled, features)
        data = BL.pack(spread(filled, n), features, F.col(label), edges)
        trees = BL.forest(data, range(len(features)), opts["numTrees"], opts["maxDepth"], [opts["minInstancesPerNode"]], opts["seed"])[0]
        return mean_abs_shap(filled, features, block_leaves(trees, edges))
    data = imp.transform(spread(df, n)).select(*features, F.col(label).cast("double").alias("_label")).checkpoint()
    vectors = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(data)
    model = classifier("forest", "_label", "features", **params).fit(vectors.select("features", "_label"))
    return mean_abs_shap(data, features, forest_leaves(spark, model))
