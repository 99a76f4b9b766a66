"""Builds as persisted pipelines: stages alone, selection and its fallback, oversampling in the fit only, reload."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskframe.operators import pipelines as PL
from riskframe.operators import shap as SH
from riskframe.operators import train as TR

COLUMNS = ["OnlineStress", "AcademicStress", "FinancialStress", "SleepHours", "ExerciseFreq", "DietQuality", "SleepQuality", "FamilySupport",
           "PeerRelationship", "SocialActivity", "ScreenTime", "SelfEfficacy"]


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(6)
    data = []
    for i in range(160):
        stress = r.uniform(0, 10)
        data.append((i, min(27.0, max(0.0, stress * 2 + r.gauss(0, 2))), min(21.0, max(0.0, stress + r.gauss(0, 1))), i % 5 == 0,
                     *[stress if c.endswith("Stress") else (None if r.random() < 0.05 else r.uniform(0, 10)) for c in COLUMNS]))
    schema = "rec_id long, PHQ9 double, GAD7 double, is_test boolean, " + ", ".join(f"{c} double" for c in COLUMNS)
    return spark.createDataFrame(data, schema)


def test_rules_and_purge(spark, rows, tmp_path):
    stage = PL.RowRules(rules=["hybrid_label", "hybrid_features"], purge=["PHQ9", "absent"])
    stage.save(f"{tmp_path}/rules")
    for s in (stage, PL.RowRules.load(f"{tmp_path}/rules")):
        out = s.transform(rows)
        assert "PHQ9" not in out.columns and {"RiskCategory", "StressLoad", "RiskIndex"} <= set(out.columns)
    assert out.count() == rows.count()


@pytest.mark.parametrize("min_size,expected", [(1, "agreed"), (50, "fallback")])
def test_selection_takes_the_agreed_or_the_fallback(spark, rows, min_size, expected, tmp_path):
    ready = PL.RowRules(rules=["hybrid_label"], purge=[]).transform(rows)
    stage = PL.Selection(candidates=COLUMNS, label="RiskCategory", test="is_test", k=5, n_select=4, min_size=min_size, step=4,
                         forest={"numTrees": 5, "maxDepth": 3})
    model = stage.fit(ready)
    assert len(model.features) == 5 if expected == "fallback" else 1 <= len(model.features) <= 4
    assert set(model.features) & {"OnlineStress", "AcademicStress", "FinancialStress"}
    model.save(f"{tmp_path}/selection")
    assert PL.SelectionModel.load(f"{tmp_path}/selection").features == model.features
    with pytest.raises(ValueError, match="missing"):
        model.transform(ready.drop(*model.features[:1]))


def test_a_build_scores_the_same_after_a_reload_and_adds_no_rows(spark, rows, tmp_path):
    model = PL.build(rows, "t", ["hybrid_label", "hybrid_features"], COLUMNS[:5], ["PHQ9", "GAD7"], select=False, folds=2)
    model.save(f"{tmp_path}/build")
    again = PipelineModel.load(f"{tmp_path}/build")
    a = model.transform(rows).select("rec_id", "p", "needs_attention").orderBy("rec_id").collect()
    b = again.transform(rows).select("rec_id", "p", "needs_attention").orderBy("rec_id").collect()
    assert a == b and len(a) == rows.count()
    t = model.stages[-1].settings
    assert t["rule"] in ("recall_and_fpr", "recall_only", "none") and all((r["p"] >= t["threshold"]) == bool(r["needs_attention"]) for r in a)
    test = model.transform(rows.where("is_test")).agg(F.avg(F.expr("CAST(needs_attention = RiskCategory AS INT)"))).first()[0]
    assert test > 0.7


def test_unreachable_recall_gives_the_default(spark):
    df = spark.createDataFrame([(0.1, 1, True), (0.2, 0, True)], "p double, y int, is_test boolean")
    model = PL.Threshold(label="y", test="is_test", sweep=[0.5], min_recall=0.7, max_fpr=0.25, default=0.5).fit(df)
    assert model.settings == {"threshold": 0.5, "rule": "none"}


def test_selection_agrees_over_three_lists(spark, rows, monkeypatch):
    """the Shapley list takes part, so a feature of two of the three lists is kept."""
    seen = {}

    def consensus(lists, fallback, *rest):
        for r in lists.collect():
            seen.setdefault(r["list_id"], set()).add(r["feature"])
        return kept(lists, fallback, *rest)

    kept = PL.consensus_with_fallback
    monkeypatch.setattr(PL, "consensus_with_fallback", consensus)
    ready = PL.RowRules(rules=["hybrid_label"], purge=[]).transform(rows)
    model = PL.Selection(candidates=COLUMNS, label="RiskCategory", test="is_test", k=4, n_select=3, min_size=1, step=9,
                         forest={"numTrees": 3, "maxDepth": 3}).fit(ready)
    assert {k: len(v) for k, v in seen.items()} == {"mi": 4, "rfe": 3, "shap": 4}
    assert model.features == sorted(c for c in COLUMNS if sum(c in v for v in seen.values()) >= 2)


def test_hybrid_label_rule_draws_the_screening_noise(spark, rows):
    """PHQ2 and GAD2 are the rounded totals and a step of -1, 0 or 1, the same in every run; the label has no noise."""
    out = PL.RowRules(rules=["hybrid_label"], purge=[]).transform(rows).orderBy("rec_id").collect()
    steps = {r["PHQ2"] - min(6, round(r["PHQ9"] * 2 / 9)) for r in out if 1 <= round(r["PHQ9"] * 2 / 9) <= 5}
    assert steps == {-1, 0, 1}
    assert out == PL.RowRules(rules=["hybrid_label"], purge=[]).transform(rows).orderBy("rec_id").collect()
    assert all(r["RiskCategory"] == int((r["PHQ9"] + r["GAD7"]) / 48 * 100 > 30) for r in out)


def _brute(nodes, at, x, known):
    """What a tree answers when only ``known`` features are: shares of the training rows for the others."""
    n = nodes[at]
    if n["leftChild"] < 0:
        return n["impurityStats"][1] / sum(n["impurityStats"])
    f, left, right = n["split"]["featureIndex"], n["leftChild"], n["rightChild"]
    if f in known:
        return _brute(nodes, left if x[f] <= n["split"]["leftCategoriesOrThreshold"][0] else right, x, known)
    return sum(sum(nodes[c]["impurityStats"]) * _brute(nodes, c, x, known) for c in (left, right)) / sum(n["impurityStats"])


@pytest.mark.parametrize("table", [10, 0])
def test_shapley_values_of_a_forest_equal_all_subsets(spark, tmp_path, monkeypatch, table):
    monkeypatch.setattr(SH, "TABLE_FEATURES", table)
    r = random.Random(3)
    data = [tuple(r.uniform(0, 1) for _ in range(4)) for _ in range(300)]
    data = [(float(a + b * c > 0.7), a, b, c, d) for a, b, c, d in data]
    df = VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(
        spark.createDataFrame(data, "label double, a double, b double, c double, d double"))
    model = TR.classifier("forest", numTrees=4, maxDepth=4).fit(df)
    x = np.array([row[1:] for row in data[:12]] + [[math.nan, 0.5, 0.2, 0.1]])
    got = SH.shap_values(SH.forest_leaves(spark, model), 4)(x)
    model.write().save(f"{tmp_path}/forest")
    trees = {}
    for t in spark.read.parquet(f"{tmp_path}/forest/data").collect():
        trees.setdefault(t["treeID"], {})[t["nodeData"]["id"]] = t["nodeData"]
    for row, values in zip(x.tolist(), got):
        for i in range(4):
            others = [f for f in range(4) if f != i]
            want = sum(math.factorial(len(s)) * math.factorial(3 - len(s)) / 24
                       * (_brute(t, 0, row, {*s, i}) - _brute(t, 0, row, set(s)))
                       for k in range(4) for s in itertools.combinations(others, k) for t in trees.values()) / len(trees)
            assert values[i] == pytest.approx(want, abs=1e-12)
    p = [q[0] for q in model.transform(df.limit(12)).select(vector_to_array("probability")[1]).collect()]
    base = sum(_brute(t, 0, row, set()) for t in trees.values()) / len(trees)
    assert got[:12].sum(axis=1) + base == pytest.approx(p, abs=1e-12)
    means = {m["feature"]: m["shap"] for m in SH.mean_abs_shap(df, list("abcd"), SH.forest_leaves(spark, model)).collect()}
    full = SH.shap_values(SH.forest_leaves(spark, model), 4)(np.array([row[1:] for row in data]))
    assert [means[c] for c in "abcd"] == pytest.approx(np.abs(full).mean(axis=0).tolist(), abs=1e-12)
