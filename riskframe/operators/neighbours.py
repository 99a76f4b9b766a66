"""Exact k nearest neighbours over pivot lists, pruned by the triangle inequality.

Rows go to the nearest of a bounded number of pivots; a pivot's rows are cut into rings by their distance to it, and a
ring that is still too large (many equal rows) into parts, so a list has about ``tile_rows`` rows whatever the data.
A row first searches its own list, which bounds the distance of its k-th neighbour.  After that only the lists that can
hold a nearer row are visited: those whose ring, or whose side of the plane between two pivots, comes within the bound.
Rows in clusters visit a few lists however many rows there are; where nothing can be pruned, all lists are visited and
the result is exact still.  A list that many rows visit is searched in parts of ``query_rows`` of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import scratch_path

PAIR = "qid long, rid long, dist double"
#: Relative room for rounding in bounds and in distances from a matrix product.
SLACK = 1e-9


def _written(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, dim))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T
    return np.sqrt(np.maximum(d2, 0.0))


def nearest_pairs(q: np.ndarray, qid: np.ndarray, limit: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int,
                  chunk: int = 256) -> pd.DataFrame:
    """Per query its k nearest candidates within ``limit``, without itself; ties go to the smaller id.  A matrix product
    proposes candidates with room for its rounding; the distance itself is the root of the summed squared differences."""
    out = []
    norms = (x * x).sum(1)
    for at in range(0, len(q), chunk):
        part, ids = q[at:at + chunk], qid[at:at + chunk]
        own = (part * part).sum(1)
        d2 = own[:, None] + norms[None, :] - 2.0 * part @ x.T
        d2[ids[:, None] == xid[None, :]] = np.inf
        kth = np.partition(d2, k - 1, axis=1)[:, k - 1] if len(x) >= k else np.full(len(part), np.inf)
        room = SLACK * (own + norms.max(initial=0.0)) + SLACK
        bound = np.minimum(kth, limit[at:at + chunk] ** 2) + room
        i, j = np.nonzero((d2 <= bound[:, None]) & np.isfinite(d2))
        dist = np.sqrt(((part[i] - x[j]) ** 2).sum(1))
        order = np.lexsort((xid[j], dist, i))
        i, j, dist = i[order], j[order], dist[order]
        top = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append(pd.DataFrame({"qid": ids[i[top]], "rid": xid[j[top]], "dist": dist[top]}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame(
        {"qid": pd.Series(dtype="int64"), "rid": pd.Series(dtype="int64"), "dist": pd.Series(dtype="float64")})


class Lists:
    """Pivots and, for each list, its pivot, its ring and its rows: one row per list on the driver, never one per row."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.between = distances(pivots, pivots)
        self.edges: list[np.ndarray] = []
        self.first = np.zeros(0, np.int64)

    def cut(self, rings: list[np.ndarray]) -> None:
        """Rings by inner edges: ring r of a pivot holds distances in (edges[r - 1], edges[r]]."""
        self.edges = rings
        self.first = np.cumsum([0] + [len(e) + 1 for e in rings])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pivot, distance to it) of every row; the distance is computed without a matrix product."""
        pivot = distances(x, self.pivots).argmin(1)
        return pivot, np.sqrt(((x - self.pivots[pivot]) ** 2).sum(1))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distance to the pivot, ring number) of every row."""
        pivot, dist = self.nearest(x)
        ring = self.first[pivot].copy()
        for p in np.unique(pivot):
            here = pivot == p
            ring[here] += np.searchsorted(self.edges[p], dist[here], side="left")
        return dist, ring

    def measured(self, stats: pd.DataFrame) -> None:
        """The non-empty rings: ring number, pivot, least and greatest distance, rows."""
        stats = stats.sort_values("ring")
        self.ring = stats["ring"].to_numpy(np.int64)
        self.pivot = np.searchsorted(self.first, self.ring, side="right") - 1
        self.low, self.high, self.rows = (stats[c].to_numpy() for c in ("low", "high", "n"))

    def visits(self, x: np.ndarray, limit: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per row (limit, rings that may hold a row within it).  A row whose own list was too short to bound it takes the
        bound that the nearest rings give together: all their rows lie within distance to the pivot plus ring radius."""
        to = distances(x, self.pivots)
        home = to.argmin(1)
        for i in range(len(x)):
            reach = to[i, self.pivot] + self.high
            if not np.isfinite(limit[i]):
                order = np.argsort(reach)
                enough = np.searchsorted(np.cumsum(self.rows[order]), k + 1)
                limit[i] = reach[order[enough]] * (1 + SLACK) if enough < len(order) else np.inf
            low = np.maximum(to[i, self.pivot] - self.high, self.low - to[i, self.pivot])
            gap = self.between[home[i], self.pivot]
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = np.where(gap > 0, (to[i, self.pivot] ** 2 - to[i, home[i]] ** 2) / (2 * gap), 0.0)
            least = np.maximum(low, plane)
            room = SLACK * (1 + reach)
            yield limit[i], self.ring[least <= limit[i] + room]


def knn_within(df: DataFrame, id_col: str, vec_col: str, k: int = 5, tile_rows: int = 4096, query_rows: int = 8192,
               most_pivots: int = 1024, seed: int = 42) -> DataFrame:
    """Exact ``k`` nearest neighbours (Euclidean) of every row among the rows of ``df``.

    Returns (qid, rid, dist, nn_rank) with ``nn_rank`` 0..k-1, ties to the smaller id.  Ids are unique; vectors have one
    length and finite entries.  Fewer than ``k`` other rows give fewer neighbours, an empty table an empty result."""
    spark = df.sparkSession
    base = _written(df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")), "knn-rows")
    n = base.count()
    if n == 0:
        return spark.createDataFrame([], PAIR + ", nn_rank int")
    count = min(most_pivots, math.ceil(n / tile_rows))
    share = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)) < 4 * count  # about 4 times as many as are needed
    picked = base.where(share).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(count).select("vec").collect()
    pivots = np.unique(np.array([r["vec"] for r in picked] or [base.first()["vec"]], dtype=np.float64), axis=0)
    dim, lists = pivots.shape[1], Lists(pivots)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pivot, dist = lists.nearest(_matrix(pdf["vec"], dim))
            yield pd.DataFrame({"pivot": pivot, "dist": dist})

    wanted = [i / 64 for i in range(1, 64)]
    cells = base.select("vec").mapInPandas(measure, "pivot int, dist double").groupBy("pivot").agg(
        F.count("*").alias("n"), F.percentile_approx("dist", wanted, 1000).alias("q"))
    rings = [np.zeros(0)] * len(pivots)
    for r in cells.collect():  # a row per pivot
        parts = min(64, math.ceil(r["n"] / tile_rows))
        rings[r["pivot"]] = np.unique([r["q"][round(i * 64 / parts) - 1] for i in range(1, parts)])
    lists.cut(rings)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            dist, ring = lists.place(_matrix(pdf["vec"], dim))
            yield pd.DataFrame({"id": pdf["id"], "vec": pdf["vec"], "ring": ring, "dist": dist})

    placed = _written(base.mapInPandas(place, "id long, vec array<double>, ring long, dist double"), "knn-lists")
    stats = placed.groupBy("ring").agg(F.min("dist").alias("low"), F.max("dist").alias("high"), F.count("*").alias("n")).toPandas()
    lists.measured(stats)
    parts_of = {int(r): math.ceil(m / tile_rows) for r, m in zip(stats["ring"], stats["n"])}
    table = spark.createDataFrame([(r, p) for r, p in parts_of.items()], "ring long, parts int")
    rows = placed.join(table, "ring").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = _matrix(pdf["vec"], dim), pdf["id"].to_numpy(np.int64)
        found = nearest_pairs(x, ids, np.full(len(x), np.inf), x, ids, k)
        ring, part = pdf["ring"].iloc[0], pdf["part"].iloc[0]
        lists_of = found.groupby("qid", sort=False).agg(dist=("dist", list))["dist"]
        limit = [d[-1] if len(d) == k else None for d in (lists_of.get(i, []) for i in ids.tolist())]
        near = found.groupby("qid", sort=False).agg(rid=("rid", list))["rid"]
        return pd.DataFrame({"id": ids, "vec": pdf["vec"], "ring": ring, "part": part, "limit": pd.array(limit, dtype="Float64"),
                             "rids": pd.Series([near.get(i, []) for i in ids.tolist()], dtype=object, index=pdf.index),
                             "dists": pd.Series([lists_of.get(i, []) for i in ids.tolist()], dtype=object, index=pdf.index)})

    first = _written(rows.groupBy("ring", "part").applyInPandas(own, "id long, vec array<double>, ring long, part int, "
                     "limit double, rids array<long>, dists array<double>"), "knn-own")

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            limits = pdf["limit"].astype("float64").fillna(np.inf).to_numpy(copy=True)
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at:at + 256]
                found = list(lists.visits(_matrix(part["vec"], dim), limits[at:at + 256], k))
                sizes = [len(r) for _, r in found]
                take = np.repeat(np.arange(len(part)), sizes)
                yield pd.DataFrame({
                    "qid": part["id"].to_numpy()[take], "qvec": part["vec"].to_numpy()[take],
                    "home": part["ring"].to_numpy()[take], "home_part": part["part"].to_numpy()[take],
                    "limit": np.repeat([v for v, _ in found], sizes),
                    "ring": np.concatenate([r for _, r in found]) if found else np.zeros(0, np.int64)})

    visits = first.select("id", "vec", "ring", "part", "limit").mapInPandas(
        choose, "qid long, qvec array<double>, home long, home_part int, limit double, ring long")
    visits = visits.join(table, "ring").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    visits = visits.where(~((F.col("ring") == F.col("home")) & (F.col("part") == F.col("home_part"))))  # searched already
    visits = _written(visits.select("qid", "qvec", "limit", "ring", "part"), "knn-visits")
    load = visits.groupBy("ring", "part").agg(F.ceil(F.count("*") / F.lit(query_rows)).cast("int").alias("blocks"))
    load = _written(load, "knn-load")  # a row per visited list
    asked = visits.join(load, ["ring", "part"]).withColumn("block", F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int"))
    asked = asked.select("ring", "part", "block", "qid", "qvec", "limit")
    offered = first.select("ring", "part", "id", "vec").join(load, ["ring", "part"]).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("ring", "part", "block", "id", "vec")

    def visit(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return nearest_pairs(np.zeros((0, dim)), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, dim)), np.zeros(0, np.int64), k)
        return nearest_pairs(_matrix(q["qvec"], dim), q["qid"].to_numpy(np.int64), q["limit"].to_numpy(np.float64),
                             _matrix(x["vec"], dim), x["id"].to_numpy(np.int64), k)

    keys = ["ring", "part", "block"]
    later = asked.groupBy(*keys).cogroup(offered.groupBy(*keys)).applyInPandas(visit, PAIR)
    pairs = F.explode(F.arrays_zip(F.col("rids").alias("rid"), F.col("dists").alias("dist")))
    early = first.select(F.col("id").alias("qid"), pairs.alias("p")).select("qid", "p.rid", "p.dist")
    order = Window.partitionBy("qid").orderBy("dist", "rid")
    return early.unionByName(later).withColumn("nn_rank", F.row_number().over(order) - 1).where(F.col("nn_rank") < k)
