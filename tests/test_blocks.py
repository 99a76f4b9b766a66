"""Trees on blocks of bytes against Spark ML: boosted trees equal, forests alike, draws, growth in several passes."""

import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskframe.operators import blocks as BL
from riskframe.operators import experiments as X
from riskframe.operators import shap as SH
from riskframe.operators import train as TR

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    """2,000 rows; ``a`` and ``b`` carry the label, ``c`` a little of it, ``d`` none.  12 values a feature at the most."""
    r = random.Random(7)
    data = []
    for i in range(2_000):
        a, b, c, d = r.randrange(12), r.randrange(10), r.randrange(8), r.randrange(12)
        data.append((i, float(a), b / 4, float(c), float(d), int(a + 5 * (b > 6) + 0.3 * c + r.gauss(0, 2) > 9)))
    return spark.createDataFrame(data, "k long, a double, b double, c double, d double, y int").repartition(4, "k").cache()


def _blocks(rows, monkeypatch, held=None):
    monkeypatch.setattr(BL, "BLOCK", 150)
    edges = BL.find_edges(rows, NAMES)
    return edges, BL.pack(rows, NAMES, F.col("y"), edges, held)


def test_boosted_trees_equal_those_of_spark(spark, rows, monkeypatch):
    edges, data = _blocks(rows, monkeypatch)
    variants = [[0, 1, 2, 3], [2, 1]]
    trees = BL.boost(data, variants, rounds=6, depth=3, rate=0.1)
    got = {r["k"]: r["p"] for r in BL.boosted_probabilities(rows, NAMES, edges, trees, 0.1, ["k"]).collect()}
    assert len(got) == 2_000
    for i, v in enumerate(variants):
        vectors = VectorAssembler(inputCols=[NAMES[j] for j in v], outputCol="features").transform(rows)
        model = TR.classifier("gbt", "y", maxIter=6, maxDepth=3, stepSize=0.1).fit(vectors)
        for k, p in model.transform(vectors).select("k", vector_to_array("probability")[1]).collect():
            assert got[k][i] == pytest.approx(p, abs=1e-9)


def test_forest_is_as_good_as_sparks_and_ranks_features_alike(spark, rows, monkeypatch):
    _, data = _blocks(rows, monkeypatch, F.col("k") % 4 == 0)
    trees = BL.forest(data, range(4), 20, 5)[0]
    ours = BL.importances(trees, 4)
    vectors = VectorAssembler(inputCols=NAMES, outputCol="features").transform(rows)
    model = TR.classifier("forest", "y", numTrees=20, maxDepth=5).fit(vectors.where("k % 4 <> 0"))
    theirs = model.featureImportances.toArray()
    assert ours.sum() == pytest.approx(1) and np.abs(ours - theirs).max() < 0.1
    found = model.transform(vectors.where("k % 4 = 0 AND y = 1")).agg(F.avg("prediction")).first()[0]
    assert BL.recalls(data, [trees], [(0, 20, 5)])[0] == pytest.approx(found, abs=0.08)


def test_small_forests_and_shallow_trees_are_parts_of_large_ones(spark, rows, monkeypatch):
    """A trial's recall does not depend on the trials grown beside it, nor on the number of passes."""
    _, data = _blocks(rows, monkeypatch, F.col("k") % 4 == 0)
    forests = BL.forest(data, range(4), 6, 4, [1, 40])
    together = BL.recalls(data, forests, [(0, 3, 2), (1, 6, 4)])
    monkeypatch.setattr(BL, "CELLS", 200)
    alone = [BL.recalls(data, BL.forest(data, range(4), 3, 2), [(0, 3, 2)])[0],
             BL.recalls(data, BL.forest(data, range(4), 6, 4, [40]), [(0, 6, 4)])[0]]
    assert together == alone
    assert all(t.w[t.left[i] + s] >= 40 for t in forests[1] for i in np.flatnonzero(t.left != np.arange(31)) for s in (0, 1))


def test_draws_are_poisson_and_differ_by_tree_and_block():
    d = BL.draws(42, 1, 5, 100_000)
    assert abs(d.mean() - 1) < 0.02 and abs(d.var() - 1) < 0.03 and (d == BL.draws(42, 1, 5, 100_000)).all()
    assert (d != BL.draws(42, 2, 5, 100_000)).any() and (d != BL.draws(42, 1, 6, 100_000)).any()


def test_cut_points_split_rare_low_values_and_missing_ones(spark):
    df = spark.createDataFrame([(0.0 if i == 0 else 1.0, None, float(i)) for i in range(200)], "rare double, none double, wide double")
    edges = BL.find_edges(df, ["rare", "none", "wide"])
    assert edges[0].tolist() == [0.0] and len(edges[1]) == 0 and 20 <= len(edges[2]) < BL.BINS
    x = np.array([[0.0, np.nan, np.nan], [1.0, np.nan, -5.0]])
    assert BL.binned(x, edges).T.tolist() == [[0, 0, len(edges[2])], [1, 0, 0]]


# ------------------------------------------------------------------ the harnesses, with parts of few rows
def _no_spark_fits(monkeypatch):
    def fail(*args, **kw):
        raise AssertionError("fitted by Spark ML")

    monkeypatch.setattr(TR, "ROWS_PER_TASK", 500)
    monkeypatch.setattr(TR, "classifier", fail)


def test_ablation_of_many_rows_grows_its_variants_on_blocks(spark, rows, monkeypatch):
    """the metrics are those of Spark's boosted trees, without a fit per variant."""
    variants = {"all": NAMES, "weak": ["c", "d"]}
    want = {r["variant"]: r for r in X.ablation(rows, "k", "y", variants, "gbt", maxIter=4, maxDepth=3).collect()}
    _no_spark_fits(monkeypatch)
    got = {r["variant"]: r for r in X.ablation(rows, "k", "y", variants, "gbt", maxIter=4, maxDepth=3).collect()}
    assert got.keys() == want.keys()
    for v in want:
        assert list(got[v].asDict()) == list(want[v].asDict())
        for c, x in want[v].asDict().items():
            assert got[v][c] == (x if isinstance(x, str) else pytest.approx(x, abs=1e-9))


def test_random_search_of_many_rows_fits_its_trials_on_blocks(spark, rows, monkeypatch):
    """F1: no vectors and no objects per row; equal settings have equal recalls."""
    holes = rows.withColumn("a", F.when(F.col("k") % 10 != 0, F.col("a")))
    space = {"numTrees": [5, 10], "maxDepth": [2, 4]}
    args = (spark, holes, NAMES, "y", "forest", space, 5, 2)
    want = {r["trial"]: r for r in TR.random_search(*args, key="k").collect()}
    _no_spark_fits(monkeypatch)
    got = {r["trial"]: r for r in TR.random_search(*args, key="k").collect()}
    by = {}
    for i, r in got.items():
        assert r["params"] == want[i]["params"] and abs(r["mean_recall"] - want[i]["mean_recall"]) < 0.1
        assert by.setdefault(r["params"], r["mean_recall"]) == r["mean_recall"]
    assert sorted(r["rank"] for r in got.values()) == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError, match="empty"):
        TR.random_search(*args[:-1], 1, key="k")


def test_elimination_of_many_rows_grows_its_forests_on_blocks(spark, rows, monkeypatch):
    """the weak features go first, as with Spark's forests."""
    want = {r["feature"]: r["eliminated_round"] for r in TR.recursive_elimination(spark, rows, NAMES, "y", 2, numTrees=10, maxDepth=4).collect()}
    _no_spark_fits(monkeypatch)
    got = {r["feature"]: r["eliminated_round"] for r in TR.recursive_elimination(spark, rows, NAMES, "y", 2, numTrees=10, maxDepth=4).collect()}
    assert got == want == {"a": 0, "b": 0, "c": 2, "d": 1}


def test_other_labels_and_parameters_stay_with_spark(spark, rows, monkeypatch):
    monkeypatch.setattr(TR, "ROWS_PER_TASK", 500)
    taken = ("numTrees",)
    assert TR.fits_in_blocks(rows, 2_000, "y", ["numTrees"], taken, 5)
    assert not TR.fits_in_blocks(rows, 400, "y", ["numTrees"], taken, 5)
    assert not TR.fits_in_blocks(rows, 2_000, "y", ["impurity"], taken, 5)
    assert not TR.fits_in_blocks(rows, 2_000, "y", ["numTrees"], taken, 13)
    assert not TR.fits_in_blocks(rows.withColumn("y", F.when(F.col("k") > 3, F.col("y"))), 2_000, "y", ["numTrees"], taken, 5)
    assert not TR.fits_in_blocks(rows.withColumn("y", F.col("a")), 2_000, "y", ["numTrees"], taken, 5)


def test_shapley_values_of_many_rows_come_from_the_blocks(spark, rows, monkeypatch):
    """the values of a forest on blocks add up to its answers; the ranking is that of Spark's forest."""
    edges, data = _blocks(rows, monkeypatch)
    trees = BL.forest(data, range(4), 5, 3)[0]
    x = np.array([[r[c] for c in NAMES] for r in rows.limit(50).collect()])
    flat = BL.binned(x, edges).ravel()
    answers = np.mean([t.cutoff(3, True)[1][t.nodes(flat, 50, np.arange(50))] for t in trees], axis=0)
    gaps = answers - SH.shap_values(SH.block_leaves(trees, edges), 4)(x).sum(axis=1)
    assert np.ptp(gaps) < 1e-12 and 0 < gaps[0] < 1
    want = {r["feature"]: r["shap"] for r in SH.forest_shap(spark, rows, NAMES, "y", numTrees=20, maxDepth=4).collect()}
    _no_spark_fits(monkeypatch)
    monkeypatch.setattr(SH, "classifier", TR.classifier)
    got = {r["feature"]: r["shap"] for r in SH.forest_shap(spark, rows, NAMES, "y", numTrees=20, maxDepth=4).collect()}
    assert sorted(got, key=got.get)[2:] == sorted(want, key=want.get)[2:] and all(abs(got[c] - want[c]) < 0.05 for c in NAMES)
