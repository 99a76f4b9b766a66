"""Distributed quantiles, modes and curves against plain computations, with NULL groups, ties and empty input."""

import random

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from riskframe.operators import aggregates as A
from riskframe.operators import metrics as M
from riskframe.operators.ranks import quantiles
from riskframe.operators.train import isotonic_fit


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    out = []
    for i in range(3000):
        g = r.choice(["a", "a", "a", "b", None])
        out.append((i, g, r.choice([1.5, 2.0, 7.0]), None if i % 7 == 0 else r.gauss(0, 1),
                    None if g == "b" else r.randint(0, 9)))
    return out


SCHEMA = "id long, g string, tied double, x double, n int"


def test_quantiles_equal_numpy_by_group(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r["g"]: r for r in quantiles(df, ["tied", "x", "n"], [0.0, 0.25, 0.5, 0.85, 1.0], ["g"]).collect()}
    pdf = pd.DataFrame(rows, columns=["id", "g", "tied", "x", "n"])
    assert set(got) == {"a", "b", None}
    for g in got:
        part = pdf[pdf["g"].isna() if g is None else pdf["g"] == g]
        for i, c in enumerate(["tied", "x", "n"]):
            values = part[c].dropna().astype(float)
            for j, q in enumerate([0.0, 0.25, 0.5, 0.85, 1.0]):
                if len(values) == 0:
                    assert got[g][f"q{j}_{i}"] is None
                else:
                    assert got[g][f"q{j}_{i}"] == pytest.approx(np.quantile(values, q), abs=1e-12)


def test_quantiles_equal_builtin_percentile(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    want = df.agg(*[F.percentile(c, q) for c in ("tied", "x", "n") for q in (0.1, 0.5, 0.85)]).first()
    assert list(want) == list(quantiles(df, ["tied", "x", "n"], [0.1, 0.5, 0.85]).first())


def test_quantiles_without_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quantiles(empty, ["x"], [0.5]).collect() == [(None,)]
    assert quantiles(empty, ["x"], [0.5], ["g"]).collect() == []
    nulls = spark.createDataFrame([(1, None, None, None, None)], SCHEMA)
    assert [tuple(r) for r in quantiles(nulls, ["x", "n"], [0.5], ["g"]).collect()] == [(None, None, None)]
    assert A.collect_medians(nulls, []) == {}


def test_group_median_fill_keeps_rows_of_a_null_group(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = A.group_median_fill(df, ["n"], "g").toPandas()
    assert len(out) == len(rows) and out["n"].notna().all()


def test_mode_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", None), ("a", None), ("a", None), ("b", None), (None, "z")],
                               "g string, v string")
    assert {r["g"]: r["v_mode"] for r in A.mode_by_group(df, "v", ["g"]).collect()} == {"a": "x", "b": None, None: "z"}
    assert A.mode_by_group(df, "v").first()[0] == "x"


def auc(pairs):
    pos, neg = [p for p, y in pairs if y == 1], [p for p, y in pairs if y == 0]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_auc_per_group_with_null_group_and_null_scores(spark):
    r = random.Random(5)
    data = [(r.choice(["a", "b", None]), None if i % 11 == 0 else round(r.random(), 2), r.randint(0, 1))
            for i in range(900)]
    df = spark.createDataFrame(data, "g string, p double, y int")
    got = {x["g"]: x["roc_auc"] for x in M.roc_auc(df, by=["g"]).collect()}
    for g in ("a", "b", None):
        assert got[g] == pytest.approx(auc([(p, y) for h, p, y in data if h == g and p is not None]))


def test_isotonic_on_score_table_equals_pooled_means(spark):
    data = [(0.1, 0), (0.1, 1), (0.1, 0), (0.4, 1), (0.6, 0), (0.6, 1), (0.9, 1), (None, 1), (0.9, None)]
    model = isotonic_fit(spark.createDataFrame(data, "p double, y int"))
    at = dict(zip(list(model.boundaries), list(model.predictions)))
    assert at[0.1] == pytest.approx(1 / 3) and at[0.4] == pytest.approx(2 / 3) and at[0.9] == pytest.approx(1.0)
