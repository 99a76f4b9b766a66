"""Exact neighbours over pivot lists: equal to brute force with ties, equal rows, clusters and few rows; work by data size."""

import numpy as np
import pytest

from riskframe.operators import neighbours as N


def frame(spark, x):
    return spark.createDataFrame([(int(i) + 1, [float(c) for c in v]) for i, v in enumerate(x)], "id long, vec array<double>")


def brute(x, k):
    out = set()
    for i, v in enumerate(x):
        d = np.sqrt(((x - v) ** 2).sum(1))
        order = [j for j in np.lexsort((np.arange(len(x)), d)) if j != i][:k]
        out |= {(i + 1, j + 1, r, round(float(d[j]), 9)) for r, j in enumerate(order)}
    return out


def found(spark, x, k, **options):
    rows = N.knn_within(frame(spark, x).repartition(5), "id", "vec", k, **options).collect()
    return {(r["qid"], r["rid"], r["nn_rank"], round(r["dist"], 9)) for r in rows}


def clustered(groups, size, dim=6, seed=1):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(size=dim) * 100 + rng.normal(size=(size, dim)) for _ in range(groups)]).round(4)


@pytest.mark.parametrize("kind", ["random", "clustered", "equal", "line", "grid"])
def test_neighbours_equal_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    x = {"random": rng.normal(size=(160, 12)), "clustered": clustered(7, 25), "line": np.arange(120.0)[:, None] * [1.0, 0.0],
         "equal": np.concatenate([np.ones((90, 3)), rng.normal(size=(40, 3))]),
         "grid": np.array([[i % 10, i // 10] for i in range(100)], dtype=float)}[kind]
    assert found(spark, x, 4, tile_rows=16, query_rows=20) == brute(x, 4)


def test_few_rows_and_none(spark):
    for n in (1, 2, 3, 6):
        x = np.arange(2.0 * n).reshape(n, 2)
        assert found(spark, x, 4, tile_rows=2) == brute(x, 4)
    assert N.knn_within(frame(spark, np.zeros((0, 2))), "id", "vec", 4).count() == 0


def test_visits_per_row_do_not_grow_with_clustered_rows():
    """Twice the clusters, twice the lists: a row still visits the lists of its own cluster."""
    per_row = []
    for groups in (20, 40):
        x = clustered(groups, 50)
        lists = N.Lists(x[::50].copy())  # a pivot per cluster
        lists.cut([np.zeros(0)] * groups)
        dist, ring = lists.place(x)
        import pandas as pd
        stats = pd.DataFrame({"ring": ring, "dist": dist}).groupby("ring")["dist"].agg(low="min", high="max", n="size").reset_index()
        lists.measured(stats)
        d = N.distances(x, x)
        limit = np.sort(d, axis=1)[:, 5]
        per_row.append(np.mean([len(r) for _, r in lists.visits(x, limit, 5)]))
    assert per_row[0] < 1.5 and per_row[1] < 1.5


def test_bound_of_rows_without_enough_neighbours_at_home():
    x = clustered(3, 4)
    lists = N.Lists(x[::4].copy())
    lists.cut([np.zeros(0)] * 3)
    dist, ring = lists.place(x)
    import pandas as pd
    lists.measured(pd.DataFrame({"ring": ring, "dist": dist}).groupby("ring")["dist"].agg(low="min", high="max", n="size").reset_index())
    d = np.sort(N.distances(x, x), axis=1)
    for i, (limit, rings) in enumerate(lists.visits(x, np.full(len(x), np.inf), 5)):
        assert limit >= d[i, 5] and len(rings) >= 2
    for _, rings in lists.visits(x, np.full(len(x), np.inf), 50):  # fewer rows than asked for: all lists
        assert len(rings) == 3
