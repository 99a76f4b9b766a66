"""Multi-class gradient boosting with the softmax objective (J18): one regression tree per class and round.

The training rows are written once as bytes (the bin of every feature) with label and weight.  All trees of a round grow
together, level by level: a pass over the rows adds up gradients and curvatures per (class, node, feature, bin) in
numpy, a ``groupBy`` adds the tasks' sums, and the driver, which only sees these histograms, picks the splits.  Their
size depends on classes, depth, features and bins, never on rows.  A row holds no state but its margins so far, which
are written anew every ``refresh`` rounds; trees since then are applied on the way.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Gains that differ by less than this share are ties; they go to the first feature and the lowest cut.
TIE = 1e-9


@dataclass
class Tree:
    """A binary tree in heap order: node i has the children 2 i + 1 (bin <= cut) and 2 i + 2."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def blank(cls, depth: int) -> "Tree":
        size = 2 ** (depth + 1) - 1
        return cls(np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row has reached."""
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        for _ in range(int(math.log2(len(self.feature) + 1)) - 1):
            f = self.feature[at]
            at = np.where(f >= 0, 2 * at + 1 + (bins[rows, np.maximum(f, 0)] > self.cut[at]), at)
        return at


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def unit(seeds: np.ndarray, turn: int) -> np.ndarray:
    """A number in [0, 1) per row and round out of the row's 64-bit hash."""
    with np.errstate(over="ignore"):
        x = (seeds.astype(np.uint64) ^ np.uint64(turn * 0x9E3779B97F4A7C15 % 2 ** 64)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(11)).astype(np.float64) / 2.0 ** 53


def best_split(g: np.ndarray, h: np.ndarray, allowed: np.ndarray, ridge: float, least: float) -> tuple[int, int] | None:
    """(feature, cut) with the largest gain of a node's (feature, bin) histograms, or None."""
    total_g, total_h = g[0].sum(), h[0].sum()
    left_g, left_h = g.cumsum(axis=1)[:, :-1], h.cumsum(axis=1)[:, :-1]
    right_g, right_h = total_g - left_g, total_h - left_h
    gain = left_g ** 2 / (left_h + ridge) + right_g ** 2 / (right_h + ridge) - total_g ** 2 / (total_h + ridge)
    gain = np.where((left_h >= least) & (right_h >= least) & allowed[:, None], gain, 0.0)
    top = gain.max(initial=0.0)
    if top <= 1e-12:
        return None
    return tuple(int(i) for i in np.argwhere(gain >= top * (1 - TIE))[0])


@dataclass
class SoftmaxBoost:
    """The booster and its fitted trees.  ``losses[r]`` is the weighted log-loss of the training rows after r rounds."""

    features: Sequence[str]
    classes: int
    rounds: int = 300
    depth: int = 6
    rate: float = 0.03
    subsample: float = 0.8
    columns: float = 0.8
    bins: int = 64
    ridge: float = 1.0
    least: float = 1.0
    seed: int = 42
    refresh: int = 10
    edges: list = field(default_factory=list)
    trees: list = field(default_factory=list)
    losses: list = field(default_factory=list)

    # ---------------------------------------------------------------- rows
    def binned(self, x: np.ndarray) -> np.ndarray:
        """The bin of every value: how many edges lie below it.  NaN goes to the last bin."""
        out = np.empty(x.shape, np.uint8)
        for i, edges in enumerate(self.edges):
            out[:, i] = np.searchsorted(edges, x[:, i], side="left")
        return out

    def vectors(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_x", F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in self.features]))

    def find_edges(self, df: DataFrame) -> None:
        """Cut points: the distinct ones of ``bins`` - 1 approximate quantiles of each feature, in one aggregation."""
        qs = [i / self.bins for i in range(1, self.bins)]
        x = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in self.features]
        row = df.agg(*[F.percentile_approx(c, qs, 10_000).alias(f"q{i}") for i, c in enumerate(x)]).first()
        self.edges = [np.unique(np.array(row[f"q{i}"] or [], dtype=np.float64)) for i in range(len(self.features))]

    def margins(self, bins: np.ndarray, trees: Sequence[Sequence[Tree]], start: np.ndarray | None = None) -> np.ndarray:
        out = np.zeros((len(bins), self.classes)) if start is None else start.copy()
        for group in trees:
            for c, tree in enumerate(group):
                out[:, c] += tree.value[tree.nodes(bins)]
        return out

    # ---------------------------------------------------------------- fit
    def fit(self, df: DataFrame, label: str, key: str, weight: str | None = None) -> "SoftmaxBoost":
        """Fit on the rows of ``df`` whose label is one of 0 .. classes - 1; NULL labels and weights take no part.

        A round takes the rows whose hash of ``key`` falls below ``subsample`` and that share of the features, the same
        in every run.  The log-loss is taken over all rows."""
        spark = df.sparkSession
        w = F.lit(1.0) if weight is None else F.col(f"`{weight}`").cast("double")
        known = df.where(F.col(f"`{label}`").between(0, self.classes - 1) & w.isNotNull())
        self.find_edges(known)
        self.trees, self.losses = [], []
        dim, classes = len(self.features), self.classes
        model = self

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                rows = [b.tobytes() for b in model.binned(x)]
                zero = [[0.0] * classes] * len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), *batch.columns[1:],
                                                  pa.array(zero, pa.list_(pa.float64()))], names=["b", "y", "w", "s", "m"])

        rows = self.vectors(known).select("_x", F.col(f"`{label}`").cast("int"), w.alias("w"),
                                          F.xxhash64(F.col(f"`{key}`"), F.lit(self.seed)).alias("s"))
        schema = "b binary, y int, w double, s long, m array<double>"
        data = self.written(spark, rows.mapInArrow(pack, schema), schema)
        applied = 0
        for turn in range(self.rounds):
            if turn - applied >= self.refresh:
                data, applied = self.written(spark, data.mapInArrow(self.advance(self.trees[applied:]), schema), schema), turn
            self.trees.append(self.grow(data, turn, self.trees[applied:]))
        self.losses.append(self.loss(data, self.trees[applied:]))
        return self

    @staticmethod
    def written(spark: SparkSession, df: DataFrame, schema: str) -> DataFrame:
        path = scratch_path(spark, "boosting")
        df.write.parquet(path)
        return spark.read.schema(schema).parquet(path)

    def unpacked(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        bins = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, len(self.features))
        margins = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, self.classes)
        return (bins, batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy(), margins)

    def advance(self, trees: list):
        model = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins, _, _, _, start = model.unpacked(batch)
                m = pa.array(model.margins(bins, trees, start).tolist(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], m], names=batch.schema.names)

        return run

    def sums(self, data: DataFrame, cells: int, add) -> np.ndarray:
        """(cells, 2) totals of what ``add(bins, y, w, seeds, margins, totals)`` adds per batch: tasks send their cells."""
        model = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals = np.zeros((cells, 2))
            for batch in batches:
                if batch.num_rows:
                    add(*model.unpacked(batch), totals)
            used = np.flatnonzero(totals.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(totals[used, 0]), pa.array(totals[used, 1])],
                                             names=["cell", "g", "h"])

        out = np.zeros((cells, 2))
        parts = data.mapInArrow(run, "cell int, g double, h double")
        for r in parts.groupBy("cell").agg(F.sum("g"), F.sum("h")).collect():  # at most ``cells`` rows
            out[r[0]] = r[1], r[2]
        return out

    def grow(self, data: DataFrame, turn: int, recent: list) -> list[Tree]:
        """The trees of a round, one per class, all grown level by level in ``depth`` + 1 passes."""
        dim, classes, width, model = len(self.features), self.classes, self.bins, self
        rng = np.random.default_rng([self.seed, turn])
        allowed = np.zeros((classes, dim), bool)
        for c in range(classes):
            allowed[c, rng.permutation(dim)[:max(1, round(self.columns * dim))]] = True
        trees = [Tree.blank(self.depth) for _ in range(classes)]
        open_nodes = [[0] for _ in range(classes)]
        for level in range(self.depth + 1):
            spots = [(c, node) for c in range(classes) for node in open_nodes[c]]
            if not spots:
                break
            slot = np.full((classes, 2 ** (self.depth + 1) - 1), -1)
            for i, (c, node) in enumerate(spots):
                slot[c, node] = i
            leaves = level == self.depth  # the last pass needs the nodes' totals alone
            size = len(spots) * (1 if leaves else dim * width)

            def add(bins, y, w, seeds, start, totals):
                p = softmax(model.margins(bins, recent, start))
                if level == 0:
                    totals[size] += (-(w * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum(), w.sum())
                taken = unit(seeds, turn) < model.subsample
                bins, y, w, p = bins[taken], y[taken], w[taken], p[taken]
                for c in range(classes):
                    at = slot[c, trees[c].nodes(bins)]
                    here = at >= 0
                    g = (w * (p[:, c] - (y == c)))[here]
                    h = np.maximum(2 * w * p[:, c] * (1 - p[:, c]), 1e-16)[here]
                    cell = at[here] if leaves else at[here] * dim * width
                    for f in range(1 if leaves else dim):
                        cells = cell if leaves else cell + f * width + bins[here, f]
                        for k, v in enumerate((g, h)):
                            totals[:size, k] += np.bincount(cells, v, size)

            found = self.sums(data, size + 1, add)
            if level == 0:
                self.losses.append(found[size, 0] / found[size, 1] if found[size, 1] else 0.0)
            open_nodes = [[] for _ in range(classes)]
            for i, (c, node) in enumerate(spots):
                if leaves:
                    g, h = found[i]
                else:
                    hist = found[i * dim * width:(i + 1) * dim * width].reshape(dim, width, 2)
                    g, h = hist[0].sum(axis=0)
                    split = best_split(hist[:, :, 0], hist[:, :, 1], allowed[c], self.ridge, self.least)
                    if split:
                        trees[c].feature[node], trees[c].cut[node] = split
                        open_nodes[c] += [2 * node + 1, 2 * node + 2]
                trees[c].value[node] = -self.rate * g / (h + self.ridge)
        return trees

    def loss(self, data: DataFrame, recent: list) -> float:
        model = self

        def add(bins, y, w, seeds, start, totals):
            p = softmax(model.margins(bins, recent, start))
            totals[0] += (-(w * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum(), w.sum())

        found = self.sums(data, 1, add)
        return float(found[0, 0] / found[0, 1]) if found[0, 1] else 0.0

    # ---------------------------------------------------------------- use
    def transform(self, df: DataFrame, out: str = "probability", prediction: str = "prediction") -> DataFrame:
        """``df`` with the array of class probabilities and the likeliest class (the lowest of equals); columns of these
        names are replaced."""
        model, dim = self, len(self.features)
        kept = [f for f in df.schema.fields if f.name not in (out, prediction)]
        columns = [f.name for f in kept]
        flat = self.vectors(df).select(*[F.col(f"`{c}`") for c in columns], "_x")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                p = softmax(model.margins(model.binned(x), model.trees))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(p.tolist(), pa.list_(pa.float64())), pa.array(p.argmax(axis=1).astype(np.int32))],
                    names=[*columns, out, prediction])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
        return flat.mapInArrow(run, f"{schema}, `{out}` array<double>, `{prediction}` int")

    def to_json(self) -> str:
        plain = {k: v for k, v in self.__dict__.items() if k not in ("edges", "trees")}
        return json.dumps({**plain, "features": list(self.features), "edges": [e.tolist() for e in self.edges],
                           "trees": [[[t.feature.tolist(), t.cut.tolist(), t.value.tolist()] for t in g] for g in self.trees]})

    @classmethod
    def from_json(cls, text: str) -> "SoftmaxBoost":
        d = json.loads(text)
        d["edges"] = [np.array(e, dtype=np.float64) for e in d["edges"]]
        d["trees"] = [[Tree(np.array(f, np.int32), np.array(c, np.int32), np.array(v)) for f, c, v in g] for g in d["trees"]]
        return cls(**d)

    def save(self, spark: SparkSession, path: str) -> str:
        spark.createDataFrame([(self.to_json(),)], "model string").coalesce(1).write.mode("overwrite").text(path)
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "SoftmaxBoost":
        return cls.from_json(spark.read.text(path).first()[0])
