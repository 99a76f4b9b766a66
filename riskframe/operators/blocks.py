"""Forests and boosted trees of a 0/1 label over large tables: rows are binned once and kept as blocks of bytes.

Spark ML keeps an object per row and fit (some 300 bytes, for every fold, trial and round anew).  Here a row of a fit is
one byte per feature, and a block of :data:`BLOCK` rows is one table row, so a task holds one batch of blocks whatever the
table's size.  All trees that are wanted grow together, level by level: a pass adds up (node, feature, bin) sums in
numpy, the sums of a tree meet in one task, which picks the splits, and only the splits reach the driver.

The methods are those of Spark ML: 32 bins, Poisson bootstrap, a sample of sqrt(features) per node, Gini gain, siblings
of one prediction merged (forests); log-loss residuals, variance gain, all rows and features (boosted trees).  For a 0/1
label the Gini gain is twice the variance gain, so one rule finds the splits of both.  Draws are functions of (seed,
tree, block or node): a tree of few levels is the beginning of a deeper one, and few trees that of many.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 32_768
BINS = 32
#: Sums (node, feature, bin) that a task holds in one pass; more open nodes take more passes.
CELLS = 2_000_000
#: Trees are kept in heap order; deeper ones are left to Spark ML.
DEEPEST = 12
#: Gains that differ by less than this share are ties (the first feature and the lowest cut win); smaller ones are noise.
TIE, NOISE = 1e-9, 1e-14
#: Poisson(1) by a 16-bit draw.
POISSON = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)]) * 65536, np.arange(65536), side="right").astype(np.uint8)

SCHEMA = "id long, b binary, y binary, m binary"
SPLITS = "tree int, node int, feature int, cut int, gain double, w double, s double, wl double, sl double"


class Tree:
    """Heap order: node i has the children ``left[i]`` (bin <= cut) and ``left[i]`` + 1; a leaf leads to itself.  ``w`` and
    ``s`` are the weight and the sum of the target in a node."""

    def __init__(self, depth: int):
        size = 2 ** (depth + 1) - 1
        self.depth, self.levels = depth, 0
        self.feature, self.left, self.cut = np.zeros(size, np.int64), np.arange(size), np.full(size, 255)
        self.gain, self.w, self.s = np.zeros(size), np.zeros(size), np.zeros(size)

    def nodes(self, flat: np.ndarray, n: int, rows: np.ndarray) -> np.ndarray:
        """The node that each of ``rows`` has reached; ``flat`` has the bins of n rows, feature by feature."""
        at = np.zeros(len(rows), np.int64)
        start, cut = self.feature * n, self.cut.astype(np.uint8)
        for _ in range(self.levels):
            i = start.take(at)
            i += rows
            right = flat.take(i) > cut.take(at)
            at = self.left.take(at)
            at += right
        return at

    def cutoff(self, depth: int, merge: bool) -> tuple[np.ndarray, np.ndarray]:
        """(inner, value) of the tree cut at ``depth``: which nodes split, and for every node of the whole tree the mean of
        the leaf that it lies in.  ``merge``: sibling leaves of the same class are one leaf, as in Spark."""
        size = len(self.left)
        inner = self.left != np.arange(size)
        inner[2 ** depth - 1:] = False
        one = self.s > self.w - self.s
        if merge:
            for i in np.flatnonzero(inner)[::-1]:
                a, b = self.left[i], self.left[i] + 1
                inner[i] = inner[a] or inner[b] or one[a] != one[b]
        value = np.divide(self.s, self.w, out=np.zeros(size), where=self.w > 0)
        for i in range(1, size):
            parent = (i - 1) // 2
            if not inner[parent]:
                value[i] = value[parent]
        return inner, value


# -------------------------------------------------------------------- rows
def as_array(columns: Sequence[str | Column]) -> Column:
    return F.array(*[F.coalesce((F.col(f"`{c}`") if isinstance(c, str) else c).cast("double"), F.lit(float("nan"))) for c in columns])


def find_edges(df: DataFrame, columns: Sequence[str]) -> list[np.ndarray]:
    """Cut points of every column: its least value and ``BINS`` - 2 approximate quantiles over all rows, in one aggregation."""
    qs = [i / (BINS - 1) for i in range(1, BINS - 1)]
    x = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in columns]
    row = df.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(x)
                   for k, f in (("q", lambda c: F.percentile_approx(c, qs, 10_000)), ("a", F.min), ("z", F.max))]).first()
    out = []
    for i in range(len(x)):
        edges = np.unique(np.array([*([row[f"a{i}"]] if row[f"a{i}"] is not None else []), *(row[f"q{i}"] or [])], np.float64))
        out.append(edges[edges < row[f"z{i}"]] if len(edges) else edges)
    return out


def binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """(feature, row) bins: how many cut points lie below a value.  NaN goes to the last bin."""
    return np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)]).astype(np.uint8)


def pack(df: DataFrame, columns: Sequence[str], y: Column, edges: Sequence[np.ndarray], held: Column | None = None) -> DataFrame:
    """The rows as blocks (id, bins, y, no margins), written once.  Rows that are ``held`` take no part in fits."""
    dim = len(columns)
    code = y.cast("int") + (F.lit(0) if held is None else F.when(held, 2).otherwise(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, turn, xs, ys, size = TaskContext.get().partitionId(), 0, [], [], 0

        def block():
            b = binned(np.concatenate(xs), edges).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | turn], pa.int64()), pa.array([b], pa.binary()),
                                               pa.array([np.concatenate(ys).tobytes()], pa.binary()), pa.array([b""], pa.binary())],
                                              names=["id", "b", "y", "m"])

        for batch in batches:
            if batch.num_rows:
                xs.append(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                ys.append(batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint8))
                size += batch.num_rows
            if size >= BLOCK:
                yield block()
                turn, xs, ys, size = turn + 1, [], [], 0
        if size:
            yield block()

    rows = df.select(as_array(columns).alias("x"), code.alias("y"))
    return rows.mapInArrow(run, SCHEMA).checkpoint()


def few_tasks(data: DataFrame) -> DataFrame:
    """Blocks are read in batches of bounded bytes, so a task may read many parts and sends its sums once."""
    return data.coalesce(4 * data.sparkSession.sparkContext.defaultParallelism)


def blocks(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(0)[i].as_py(), *[np.frombuffer(batch.column(k)[i].as_buffer(), t) for k, t in ((1, np.uint8), (2, np.uint8), (3, np.float64))]


def draws(seed: int, tree: int, block: int, n: int) -> np.ndarray:
    """How often each row of a block is in a tree's bootstrap sample."""
    return POISSON[np.random.default_rng([seed, tree, block]).integers(0, 65536, n, np.uint16)]


def residual(y: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """Negative gradient of Spark's log-loss; the first tree (no margin) fits the labels as -1 and 1."""
    sign = 2.0 * y - 1.0
    return sign if margin is None else 4.0 * sign / (1.0 + np.exp(2.0 * sign * margin))


# -------------------------------------------------------------------- growth
@dataclass
class Plan:
    """A tree to grow: its number for the draws (None: every row once), the margin its target comes from (None: the label;
    -1: the label as -1 and 1), the features it may use and how many a node sees, the least weight of a child."""
    features: np.ndarray
    per_node: int
    draw: int | None = None
    margin: int | None = None
    least: float = 1.0


def best_splits(h: np.ndarray, subset: np.ndarray, least: float):
    """Per node (feature, cut, gain, w, s, wl, sl) of its best split, out of (node, feature, bin, 2) sums; feature -1: none."""
    w, s = h[:, 0, :, 0].sum(axis=1), h[:, 0, :, 1].sum(axis=1)
    wl, sl = h[..., 0].cumsum(axis=2)[..., :-1], h[..., 1].cumsum(axis=2)[..., :-1]
    wr, sr = w[:, None, None] - wl, s[:, None, None] - sl
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (sl * sl / wl + sr * sr / wr - (s * s / w)[:, None, None]) / w[:, None, None]
    gain = np.where((wl >= least) & (wr >= least) & (wl > 0) & (wr > 0), gain, 0.0).reshape(len(h), -1)
    top = gain.max(axis=1, initial=0.0)
    first = (gain >= (top * (1 - TIE))[:, None]).argmax(axis=1)
    k, cut = np.divmod(first, h.shape[2] - 1)
    rows = np.arange(len(h))
    return np.where(top > NOISE, subset[rows, k], -1), cut, top, w, s, wl[rows, k, cut], sl[rows, k, cut]


def grow(data: DataFrame, plans: Sequence[Plan], depth: int, seed: int = 42) -> list[Tree]:
    """One tree per plan, all grown together in a pass per level (more where the open nodes' sums pass ``CELLS``)."""
    trees = [Tree(depth) for _ in plans]
    opened = [(i, 0) for i in range(len(plans))]
    small = few_tasks(data)
    for level in range(depth):
        for t in trees:
            t.levels = level
        todo, opened, found = opened, [], []
        while todo:
            group, cells = [], 0
            while todo and (not group or cells + plans[todo[0][0]].per_node * BINS <= CELLS):
                cells += plans[todo[0][0]].per_node * BINS
                group.append(todo.pop(0))
            found += one_pass(small, plans, trees, group, seed)
        for r in found:
            t, i = trees[r["tree"]], r["node"]
            t.w[i], t.s[i] = r["w"], r["s"]
            if r["feature"] >= 0:
                t.feature[i], t.left[i], t.cut[i], t.gain[i] = r["feature"], 2 * i + 1, r["cut"], r["gain"]
                for child, w, s in ((2 * i + 1, r["wl"], r["sl"]), (2 * i + 2, r["w"] - r["wl"], r["s"] - r["sl"])):
                    t.w[child], t.s[child] = w, s
                    if w >= 2 * plans[r["tree"]].least and not (plans[r["tree"]].margin is None and s in (0.0, w)):
                        opened.append((r["tree"], child))
        opened.sort()
    for t in trees:
        t.levels = depth
    return trees


def one_pass(data: DataFrame, plans: Sequence[Plan], trees: Sequence[Tree], group: Sequence[tuple[int, int]], seed: int) -> list:
    """The best splits of the open nodes ``group``, from one pass over the blocks."""
    nodes: dict[int, list[int]] = {}
    for i, node in group:
        nodes.setdefault(i, []).append(node)
    slots, subsets = {}, {}
    for i, own in nodes.items():
        p = plans[i]
        slots[i] = np.full(len(trees[i].left), -1)
        slots[i][own] = np.arange(len(own))
        pick = [np.sort(np.random.default_rng([seed, p.draw or 0, node]).permutation(len(p.features))[:p.per_node]) for node in own]
        subsets[i] = np.asarray(p.features)[np.array(pick)]
    grown = {i: trees[i] for i in nodes}
    used = {i: plans[i] for i in nodes}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {i: np.zeros(len(own) * used[i].per_node * BINS * 2) for i, own in nodes.items()}
        drawn_for, drawn = None, {}
        for block, flat, y, m in blocks(batches):
            n = len(y)
            fit = y < 2
            classes = (flat.reshape(-1, n) * 2 + (y & 1)).ravel()  # bin and class in one
            margins = m.reshape(-1, n) if len(m) else None
            if drawn_for != block:
                drawn_for, drawn = block, {}
            for i, p in used.items():
                if p.draw not in drawn:
                    w = None if p.draw is None else draws(seed, p.draw, block, n)
                    drawn[p.draw] = np.flatnonzero(fit if w is None else fit & (w > 0)), w
                rows, w = drawn[p.draw]
                at = slots[i][grown[i].nodes(flat, n, rows)]
                if at.min(initial=0) < 0:
                    rows, at = rows[at >= 0], at[at >= 0]
                if not len(rows):
                    continue
                k, size = p.per_node, len(totals[i])
                sums = totals[i].reshape(-1, k, BINS * 2)
                whole = k == len(p.features)  # every node sees the same features: columns are read as they lie
                starts = None if whole else np.ascontiguousarray(subsets[i].T * n)
                if p.margin is None:  # a 0/1 target: one count per class
                    values, weights = classes, None if w is None else w.take(rows).astype(np.float64)
                else:
                    values, weights = flat, residual(y[rows], None if p.margin < 0 else margins[p.margin][rows])
                width = BINS * 2 if p.margin is None else BINS
                base = at * width
                for j in range(k):
                    if whole:
                        f = p.features[j]
                        column = values[f * n:(f + 1) * n]
                        cell = base + (column if len(rows) == n else column.take(rows))
                    else:
                        spot = starts[j].take(at)
                        spot += rows
                        cell = base + values.take(spot)
                    if p.margin is None:
                        sums[:, j] += np.bincount(cell, weights, len(sums) * width).reshape(-1, width)
                    else:
                        sums[:, j, ::2] += np.bincount(cell, None, len(sums) * width).reshape(-1, width)
                        sums[:, j, 1::2] += np.bincount(cell, weights, len(sums) * width).reshape(-1, width)
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())],
                                             names=["tree", "sums"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(part.as_buffer(), np.float64)
                totals[i] = totals[i] + part if i in totals else part.copy()
        for i, t in totals.items():
            h = t.reshape(len(nodes[i]), used[i].per_node, BINS, 2)
            if used[i].margin is None:
                h = np.stack([h.sum(axis=3), h[..., 1]], axis=3)
            columns = best_splits(h, subsets[i], used[i].least)
            kinds = [pa.int32(), pa.int32(), *[pa.float64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(h), pa.int32()), pa.array(nodes[i], pa.int32()),
                                              *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=[f.split()[0] for f in SPLITS.split(", ")])

    sums = data.mapInArrow(add, "tree int, sums binary").repartition(min(len(nodes), data.sparkSession.sparkContext.defaultParallelism), "tree")
    return sums.mapInArrow(choose, SPLITS).collect()  # one row per open node


# -------------------------------------------------------------------- forests
def forest(data: DataFrame, features: Sequence[int], trees: int, depth: int, least: Sequence[float] = (1.0,), seed: int = 42) -> list[list[Tree]]:
    """A forest per value of ``least`` (the smallest child), all from the same bootstrap samples and feature draws."""
    features = np.asarray(features)
    per_node = len(features) if trees == 1 else math.ceil(math.sqrt(len(features)))
    plans = [Plan(features, per_node, t, None, float(v)) for v in least for t in range(trees)]
    grown = grow(data, plans, depth, seed)
    return [grown[i * trees:(i + 1) * trees] for i in range(len(least))]


def importances(trees: Sequence[Tree], dim: int) -> np.ndarray:
    """Gain times weight per feature, each tree's shares summed and normed (Spark's ``featureImportances``)."""
    total = np.zeros(dim)
    for t in trees:
        inner, _ = t.cutoff(t.depth, True)
        own = np.bincount(t.feature[inner], (t.gain * t.w)[inner], dim)
        total += own / own.sum() if own.sum() > 0 else 0.0
    return total / total.sum() if total.sum() > 0 else total


def recalls(data: DataFrame, forests: Sequence[Sequence[Tree]], trials: Sequence[tuple[int, int, int]]) -> list[float]:
    """Positive-class recall over the held rows of every trial (forest, trees, depth), from one pass."""
    values = [[forests[f][t].cutoff(depth, True)[1] for t in range(n)] for f, n, depth in trials]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit, positive = np.zeros(len(trials), np.int64), 0
        for _, flat, y, _ in blocks(batches):
            rows = np.flatnonzero(y == 3)
            positive += len(rows)
            votes = np.zeros((len(trials), len(rows)))
            for f, trees in enumerate(forests):
                for t, tree in enumerate(trees):
                    at = tree.nodes(flat, len(y), rows)
                    for i, (own, n, _) in enumerate(trials):
                        if own == f and t < n:
                            votes[i] += values[i][t][at]
            hit += (2 * votes > np.array([[n] for _, n, _ in trials])).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(trials)), pa.int32()), pa.array(hit), pa.array([positive] * len(trials), pa.int64())],
                                         names=["trial", "hit", "positive"])

    sums = few_tasks(data).mapInArrow(run, "trial int, hit long, positive long").groupBy("trial").agg(F.sum("hit"), F.sum("positive")).collect()
    out = {r[0]: (r[1], r[2]) for r in sums}
    if not out[0][1]:
        raise ValueError("no held row has the label 1")
    return [out[i][0] / out[i][1] for i in range(len(trials))]


# -------------------------------------------------------------------- boosted trees
def boost(data: DataFrame, variants: Sequence[Sequence[int]], rounds: int, depth: int, rate: float, least: float = 1.0) -> list[list[Tree]]:
    """Boosted trees per variant (its features), all grown in the same passes.  The margins so far stand beside the rows and
    are replaced after every round."""
    out: list[list[Tree]] = [[] for _ in variants]
    state = data
    try:
        for turn in range(rounds):
            plans = [Plan(np.asarray(v), len(v), None, i if turn else -1, least) for i, v in enumerate(variants)]
            for own, tree in zip(out, grow(state, plans, depth)):
                own.append(tree)
            if turn + 1 < rounds:
                before, state = state, state.mapInArrow(advance([own[-1] for own in out], 1.0 if turn == 0 else rate), SCHEMA).persist(StorageLevel.MEMORY_AND_DISK)
                if before is not data:
                    state.count()
                    before.unpersist()
    finally:
        if state is not data:
            state.unpersist()
    return out


def advance(trees: Sequence[Tree], rate: float):
    values = [t.cutoff(t.depth, False)[1] * rate for t in trees]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, flat, y, m in blocks(batches):
            rows = np.arange(len(y))
            margins = m.reshape(-1, len(y)) if len(m) else np.zeros((len(trees), len(y)))
            margins = margins + np.stack([v[t.nodes(flat, len(y), rows)] for t, v in zip(trees, values)])
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *[pa.array([a.tobytes()], pa.binary()) for a in (flat, y, margins)]],
                                             names=["id", "b", "y", "m"])

    return run


def boosted_probabilities(df: DataFrame, columns: Sequence[str], edges: Sequence[np.ndarray], variants: Sequence[Sequence[Tree]], rate: float,
                          keep: Sequence[str]) -> DataFrame:
    """``keep`` of every row and the array of its class-1 probabilities, one per variant."""
    dim = len(columns)
    values = [[t.cutoff(t.depth, False)[1] * (rate if i else 1.0) for i, t in enumerate(trees)] for trees in variants]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            flat = binned(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), edges).ravel()
            rows = np.arange(n)
            margins = np.array([sum(v[t.nodes(flat, n, rows)] for t, v in zip(trees, own)) for trees, own in zip(variants, values)])
            p = 1.0 / (1.0 + np.exp(-2.0 * margins))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(variants), pa.int32()), pa.array(p.T.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], lists], names=[*keep, "p"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(as_array(columns).alias("x"), *keep).mapInArrow(run, f"{kinds}, p array<double>")
