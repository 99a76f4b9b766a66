"""Embedding whitening by polarisation covariance: exact squared centred values of every dimension and every sum of two
dimensions are aggregated in Spark; differences of these variances give all covariances, and eigh the components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: Entries become floor(SCALE * c) + OFFSET.
SCALE = 64
OFFSET = 1_000_000
#: Entries beyond this do not fit the integers that the method adds up.
LARGEST = 2.0 ** 52
LIMB = 1 << 32


@dataclass
class Whitening:
    """The fitted model: it grows with the dimensions, never with the rows.

    ``floor[d]`` and ``rest[d]`` are the quotient and remainder of the sum of dimension d by ``n``, so the centred
    value n * x - S is n * (x - floor) - rest, an exact integer. ``basis`` has a unit eigenvector per column."""

    n: int
    floor: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    basis: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly; Python integers where 64 bits may not hold the sum of the squares."""
        y = x - self.floor
        most = int(np.abs(y).max(initial=0)) + 1
        if x.shape[1] * (self.n * most) ** 2 >= 1 << 63:
            return y.astype(object) * self.n - self.rest.astype(object)
        return y * self.n - self.rest

    def whiten(self, z: np.ndarray) -> np.ndarray:
        """Whitened values of centred rows, one column per component."""
        return (z.astype(np.float64) / self.n) @ self.basis / np.sqrt(self.values)


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of an Arrow list column, which all have the same length, as one matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def integer_vectors(df: DataFrame, vec_col: str, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """``df`` with the column ``_x``: the integers floor(scale * c) + offset. Rows whose vector is null, empty, or holds
    a null or non-finite entry go. Entries beyond 2**52 raise, and so do vectors of several lengths (see ``fit``)."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    large = F.exists(v, lambda c: F.abs(c * scale) > LARGEST)
    x = F.transform(v, lambda c: F.floor(c * scale).cast("long") + F.lit(offset).cast("long"))
    return df.where(good).withColumn("_x", F.when(large, F.raise_error(F.lit(
        "whitening: an entry is too large for exact integers")).cast("array<bigint>")).otherwise(x))


def summed(df: DataFrame, dim: int, cells: int, add: Callable[[np.ndarray], list[int]]) -> list[int]:
    """The exact totals, over all rows of ``df``, of the ``cells`` integers that ``add`` makes of each matrix of rows.

    A task adds up its own rows and hands on one row per cell, cut into 32-bit limbs so that no sum overflows; Spark
    adds the limbs, and only ``cells`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [0] * cells
        for batch in batches:
            x = matrix(batch.column(0))
            for at in range(0, len(x), 4096):
                totals = [a + b for a, b in zip(totals, add(x[at:at + 4096]))]
        used = [i for i, t in enumerate(totals) if t]
        limbs = [[totals[i] >> 64, totals[i] >> 32 & LIMB - 1, totals[i] & LIMB - 1] for i in used]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), *[pa.array([x[k] for x in limbs], pa.int64()) for k in range(3)]],
            names=["cell", "high", "mid", "low"])

    parts = df.select("_x").mapInArrow(run, "cell int, high long, mid long, low long")
    out = [0] * cells
    for r in parts.groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("high", "mid", "low")]).collect():
        out[r["cell"]] = (r["high"] << 64) + (r["mid"] << 32) + r["low"]
    return out


def squares(y: np.ndarray) -> list[int]:
    """Sums of squares of every dimension i and every sum of dimensions i < j: cells (i, i), (i, i + 1) ... in order."""
    if 4 * len(y) * (int(np.abs(y).max(initial=0)) + 1) ** 2 >= 1 << 63:
        y = y.astype(object)
    out: list[int] = []
    for i in range(y.shape[1]):
        pair = y[:, i:] + y[:, i:i + 1]
        pair[:, 0] = y[:, i]
        out.extend(int(s) for s in (pair * pair).sum(axis=0))
    return out


def covariance(n: int, rest: list[int], cells: list[int]) -> np.ndarray:
    """The covariance matrix by polarisation, (Var(i + j) - Var(i) - Var(j)) / 2, from exact integers.

    With z = n * y - rest and sum(y) = rest, the sum of (z_i + z_j)**2 is n**2 * cell - n * (rest_i + rest_j)**2; the
    covariance is the difference of such sums over 2 * n**3, rounded once."""
    dim = len(rest)
    square = {}
    it = iter(cells)
    for i in range(dim):
        for j in range(i, dim):
            shift = rest[i] if i == j else rest[i] + rest[j]
            square[i, j] = n * n * next(it) - n * shift * shift
    v = np.empty((dim, dim))
    for i in range(dim):
        v[i, i] = square[i, i] / n ** 3
        for j in range(i + 1, dim):
            v[i, j] = v[j, i] = (square[i, j] - square[i, i] - square[j, j]) / (2 * n ** 3)
    return v


def fit(vectors: DataFrame, components: int = 16) -> Whitening | None:
    """The model of the distinct vectors of ``vectors`` (from ``integer_vectors``); None for an empty table.

    The distinct vectors are written once: equal vectors are folded before the shuffle, so a vector that a third of
    all rows hold costs no more than another. Three passes over them follow: sums, squared centred values, and the
    covariance of the whitened values. Components whose eigenvalue is zero to double precision cannot be whitened and
    are left out, so constant dimensions or few vectors give fewer than ``components``."""
    distinct = written(vectors.select("_x").distinct(), "whitening-fit")
    sizes = distinct.groupBy(F.size("_x").alias("d")).agg(F.count("*").alias("n")).limit(2).collect()
    if not sizes:
        return None
    if len(sizes) > 1:
        raise ValueError("whitening: the vectors have several lengths")
    dim, n = sizes[0]["d"], sizes[0]["n"]

    total = summed(distinct, dim, dim, lambda x: [int(s) for s in (
        x if len(x) * (int(np.abs(x).max(initial=0)) + 1) < 1 << 63 else x.astype(object)).sum(axis=0)])
    floor, rest = [s // n for s in total], [s % n for s in total]
    middle = np.array(floor, dtype=np.int64)
    v = covariance(n, rest, summed(distinct, dim, dim * (dim + 1) // 2, lambda x: squares(x - middle)))
    values, basis = np.linalg.eigh(v)
    values, basis = values[::-1], basis[:, ::-1]
    trace = float(np.trace(v))
    kept = [i for i in range(min(components, dim)) if values[i] > dim * np.finfo(float).eps * max(trace, 0.0)]
    model = Whitening(n, middle, np.array(rest, dtype=np.int64), values[kept], basis[:, kept],
                      values[kept] / trace if kept else values[kept])
    model.identity_error = identity_error(distinct, model)
    return model


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit vectors minus the identity, measured on them."""
    k = len(model.values)
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k + 1, k + 1))
        for batch in batches:
            x = matrix(batch.column(0))
            for at in range(0, len(x), 4096):
                w = model.whiten(model.centred(x[at:at + 4096]))
                w = np.hstack([w, np.ones((len(w), 1))])
                sums += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(sums.size), pa.int32()), pa.array(sums.ravel())],
                                         names=["cell", "value"])

    sums = np.zeros((k + 1) ** 2)
    for r in distinct.select("_x").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value")).collect():
        sums[r[0]] = r[1]
    sums = sums.reshape(k + 1, k + 1) / model.n
    return float(np.abs(sums[:k, :k] - np.outer(sums[k, :k], sums[k, :k]) - np.eye(k)).max())


SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
    T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()),
    T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])


def whitened(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 16) -> DataFrame:
    """``id_col``, component, n, deviation, whitened, explained, identity_error: a row per vector and component.

    Rows whose vector is null, empty, or holds a null or non-finite entry go; a null id stays null, and rows repeat as
    they do in ``df``, though equal vectors count once in the fit. Ties between eigenvalues are ordered as eigh gives
    them, the same for all rows. An empty table, or one whose vectors are all equal, gives an empty result. Other
    columns are not read, whatever their names. Vectors of several lengths, entries beyond 2**52 and deviations beyond
    64 bits raise an error."""
    spark = df.sparkSession
    rows = integer_vectors(df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{vec_col}`").alias("_v")), "_v")
    rows = rows.select("_id", "_x")
    schema = T.StructType([T.StructField(id_col, T.LongType()), *SCHEMA.fields[1:]])
    model = fit(rows, components)
    if model is None or not len(model.values):
        return spark.createDataFrame([], schema)
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                z = model.centred(matrix(part.column(1)))
                rows = len(z)
                deviation = [int(s) for s in (z * z).sum(axis=1)]
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, model.n, dtype=np.int64)),
                    pa.array([s for s in deviation for _ in range(k)], pa.int64()),
                    pa.array(model.whiten(z).ravel()),
                    pa.array(np.tile(model.explained, rows)),
                    pa.array(np.full(rows * k, model.identity_error))], names=schema.names)

    return rows.mapInArrow(run, schema)
