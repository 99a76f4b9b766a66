"""Distributed isotonic fit against a plain one, and the curve's two ways of use."""

import random

import numpy as np
import pandas as pd
import pytest

from riskframe.operators import isotonic as I


def plain(rows):
    """max over starts of the min over ends of the weighted means."""
    known = [r for r in rows if None not in r and r[0] == r[0] and r[2] > 0]
    xs = sorted({r[0] for r in known})
    s = [sum(y * w for x, y, w in known if x == v) for v in xs]
    w = [sum(w for x, _, w in known if x == v) for v in xs]
    return {v: max(min(sum(s[a:b + 1]) / sum(w[a:b + 1]) for b in range(i, len(xs))) for a in range(i + 1))
            for i, v in enumerate(xs)}


CASES = {
    "noise": lambda r: [(round(r.uniform(0, 1), 2), r.random() < 0.5, r.choice([1.0, 2.0])) for _ in range(400)],
    "rising": lambda r: [(i / 40, i >= 20, 1.0) for i in range(40)],
    "falling": lambda r: [(float(i), 60 - i, 1.0) for i in range(60)],
    "signal": lambda r: [(x, r.random() < x, 1.0) for x in [round(r.random(), 2) for _ in range(300)]],
    "odd": lambda r: [(None, 1, 1.0), (0.5, None, 1.0), (float("nan"), 1, 1.0), (0.5, 1, 0.0), (0.2, 1, 1.0), (0.2, 0, 3.0), (0.9, 0, 1.0)],
    "one": lambda r: [(0.3, 1, 1.0)] * 5,
}


@pytest.mark.parametrize("case", CASES)
def test_fit_equals_the_max_min_formula(spark, case):
    rows = [(x, None if y is None else float(y), w) for x, y, w in CASES[case](random.Random(4))]
    iso = I.isotonic_fit(spark.createDataFrame(rows, "p double, y double, w double").repartition(6), weight="w")
    want = plain(rows)
    got = {r["p"]: r["p_cal"] for r in iso.transform(spark.createDataFrame([(x,) for x in want], "p double")).collect()}
    assert got == {x: pytest.approx(y, abs=1e-12) for x, y in want.items()}


def test_both_ways_of_use_agree(spark, tmp_path):
    r = random.Random(9)
    data = [(x, float(r.random() < x), "kept") for x in [round(r.random(), 3) for _ in range(500)]]
    iso = I.isotonic_fit(spark.createDataFrame(data, "p double, y double, p_cal_note string"))
    asked = spark.createDataFrame([(x, i) for i, x in enumerate([-1.0, 0.0, 0.1234, 0.5, 0.5, 0.77777, 2.0, None, float("nan")])], "p double, i int")
    a = {v["i"]: v["p_cal"] for v in iso.transform(asked).collect()}
    b = {v["i"]: v["p_cal"] for v in iso.looked_up(asked).collect()}
    c = {v["i"]: v["p_cal"] for v in I.IsotonicMap.load(spark, iso.save(f"{tmp_path}/iso")).transform(asked).collect()}
    assert a[7] is None and a[8] is None and a == c
    assert a == {k: v if v is None else pytest.approx(v, abs=1e-12) for k, v in b.items()}
    xs, ys = iso.boundaries, iso.predictions
    assert [a[i] for i in range(7)] == pytest.approx(np.interp([-1.0, 0.0, 0.1234, 0.5, 0.5, 0.77777, 2.0], xs, ys).tolist())


def test_empty_table(spark):
    iso = I.isotonic_fit(spark.createDataFrame([], "p double, y double"))
    assert [r["p_cal"] for r in iso.transform(spark.createDataFrame([(0.5,)], "p double")).collect()] == [None]


def test_only_neighbouring_violators_are_grouped():
    ends = [(0, 0.1, 0.2, 5), (1, 0.3, 0.6, 5), (2, 0.5, 0.55, 5), (3, 0.5, 0.7, 5), (4, 0.8, 0.9, 5)]
    assert I.merges(ends) == {1: 1, 2: 1, 3: 1}
    assert I.merges(ends, most=10) == {1: 1, 2: 1}
    assert I.merges([]) == {} and I.merges(ends[:2]) == {}


def test_pooling_in_parts_is_pooling_at_once():
    r = random.Random(2)
    table = pd.DataFrame({"lo": range(200), "hi": range(200), "total": [r.random() * i for i in range(200)], "weight": [1.0] * 200})
    parts = pd.concat([I.pooled(table.iloc[a:a + 30]) for a in range(0, 200, 30)])
    whole, again = I.pooled(table), I.pooled(parts)
    assert np.allclose(whole.to_numpy(), again.to_numpy())
