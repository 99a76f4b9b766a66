"""Softmax boosting against a plain version, with NULLs, weights, repeated runs and empty tables."""

import math
import random

import numpy as np
import pytest

from riskframe.operators.boosting import SoftmaxBoost, Tree, best_split

SCHEMA = "key long, a double, b double, c double, y int, w double, probability string, m double"


def rows(n=300, seed=2):
    r = random.Random(seed)
    out = []
    for i in range(n):
        y = r.choice([0, 0, 0, 1, 1, 2])
        out.append((i, r.gauss(y, 0.7), float(r.randint(0, 4)), None if i % 9 == 0 else r.gauss(-y, 2), y, [1.0, 2.0, 4.0][y], "x", 0.0))
    return out


def plain(data, edges, classes, rounds, depth, rate, ridge=1.0, least=1.0):
    """Row by row, node by node: (losses, probabilities)."""
    x = [[sum(e < v for e in edges[f]) if v is not None else len(edges[f]) for f, v in enumerate(d[1:4])] for d in data]
    margin = [[0.0] * classes for _ in data]
    losses = []

    def probs():
        out = []
        for m in margin:
            e = [math.exp(v - max(m)) for v in m]
            out.append([v / sum(e) for v in e])
        return out

    def loss(p):
        return -sum(d[5] * math.log(q[d[4]]) for d, q in zip(data, p)) / sum(d[5] for d in data)

    def build(members, g, h, level):
        gs, hs = sum(g[i] for i in members), sum(h[i] for i in members)
        best = None
        for f in range(3):
            for cut in range(len(edges[f])):
                left = [i for i in members if x[i][f] <= cut]
                gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                if level == depth or hl < least or hs - hl < least:
                    continue
                gain = gl ** 2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs ** 2 / (hs + ridge)
                if gain > 1e-12 and (best is None or gain > best[0] * (1 + 1e-9)):
                    best = (gain, f, cut, left)
        if best is None:
            return {i: -rate * gs / (hs + ridge) for i in members}
        _, _, _, left = best
        inside = set(left)
        return {**build(left, g, h, level + 1), **build([i for i in members if i not in inside], g, h, level + 1)}

    for _ in range(rounds):
        p = probs()
        losses.append(loss(p))
        steps = []
        for c in range(classes):
            g = [d[5] * (q[c] - (d[4] == c)) for d, q in zip(data, p)]
            h = [2 * d[5] * q[c] * (1 - q[c]) for d, q in zip(data, p)]
            steps.append(build(list(range(len(data))), g, h, 0))
        for c, step in enumerate(steps):
            for i, v in step.items():
                margin[i][c] += v
    return [*losses, loss(probs())], probs()


def booster(**more):
    return SoftmaxBoost(["a", "b", "c"], 3, **{"rounds": 5, "depth": 3, "rate": 0.4, "subsample": 1.0, "columns": 1.0, "bins": 16,
                                               "refresh": 2, **more})


def test_boosting_equals_a_plain_version(spark):
    data = rows()
    df = spark.createDataFrame(data + [(999, 1.0, 1.0, 1.0, None, 1.0, "x", 0.0), (998, 1.0, 1.0, 1.0, 1, None, "x", 0.0)], SCHEMA)
    model = booster().fit(df.repartition(3), "y", "key", "w")
    losses, probs = plain(data, [e.tolist() for e in model.edges], 3, 5, 3, 0.4)
    assert model.losses == pytest.approx(losses, abs=1e-9)
    assert all(b < a for a, b in zip(model.losses, model.losses[1:]))
    scored = model.transform(df.drop("probability"))
    assert scored.columns == [*df.drop("probability").columns, "probability", "prediction"]
    got = {r["key"]: r for r in scored.collect()}
    for d, p in zip(data, probs):
        assert got[d[0]]["probability"] == pytest.approx(p, abs=1e-9)
        assert got[d[0]]["prediction"] == int(np.argmax(got[d[0]]["probability"]))
    assert abs(sum(got[999]["probability"]) - 1) < 1e-12  # rows without a label are scored too


def test_same_model_from_any_partitioning_and_after_a_reload(spark, tmp_path):
    df = spark.createDataFrame(rows(200, 4), SCHEMA)
    a = booster(subsample=0.7, columns=0.6, rounds=4).fit(df.repartition(1), "y", "key", "w")
    b = booster(subsample=0.7, columns=0.6, rounds=4, refresh=100).fit(df.repartition(7, "b"), "y", "key", "w")
    for x, y in zip(a.trees, b.trees):
        for s, t in zip(x, y):
            assert s.feature.tolist() == t.feature.tolist() and s.cut.tolist() == t.cut.tolist()
            assert s.value == pytest.approx(t.value, abs=1e-9)
    assert len({tuple(t.feature.tolist()) for g in a.trees for t in g}) > 1
    again = SoftmaxBoost.load(spark, a.save(spark, f"{tmp_path}/m"))
    assert again.to_json() == a.to_json()


def test_boosting_without_rows_or_with_one_class(spark):
    df = spark.createDataFrame(rows(40), SCHEMA)
    none = booster(rounds=2).fit(df.where("false"), "y", "key")
    assert [r["probability"] for r in none.transform(df.limit(1)).collect()] == [pytest.approx([1 / 3] * 3)]
    one = booster(rounds=3, depth=2).fit(df.where("y = 0"), "y", "key")
    p = [r["probability"] for r in one.transform(df).collect()]
    assert all(q[0] > q[1] == pytest.approx(q[2]) for q in p)


def test_split_ties_go_to_the_first_feature_and_lowest_cut():
    g = np.array([[3.0, 0.0, -3.0], [3.0, 0.0, -3.0]])
    h = np.array([[2.0, 0.0, 2.0], [2.0, 0.0, 2.0]])
    assert best_split(g, h, np.array([True, True]), 1.0, 1.0) == (0, 0)
    assert best_split(g, h, np.array([False, True]), 1.0, 1.0) == (1, 0)
    assert best_split(g, h, np.array([True, True]), 1.0, 3.0) is None
    tree = Tree.blank(2)
    assert tree.nodes(np.zeros((2, 1), np.uint8)).tolist() == [0, 0]
