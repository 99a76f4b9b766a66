"""Rows with NULL keys, strata, scores or labels in splits and ranking metrics."""

import math

import pytest

from riskframe.functions.noise import poisson
from riskframe.operators.metrics import roc_auc
from riskframe.operators.prep import OneHot, OneHotLong
from riskframe.operators.splits import cap_sample, hash_rank, holdout_split, stratified_split, user_split
from riskframe.operators.train import permuted_copies


@pytest.fixture(scope="module")
def rows(spark):
    data = [(None if i % 10 == 0 else i, None if i % 4 == 0 else "ab"[i % 2], float(i)) for i in range(100)]
    return spark.createDataFrame(data, "k long, s string, x double")


def test_hash_rank_keeps_null_keys_and_strata(rows):
    got = hash_rank(rows, "k", ["s"]).collect()
    assert len(got) == 100
    by = {}
    for r in got:
        by.setdefault(r["s"], []).append(r["_rank"])
    assert {s: sorted(v) == list(range(1, len(v) + 1)) for s, v in by.items()} == {None: True, "a": True, "b": True}


def test_holdout_and_cap_are_exact_with_null_keys(rows):
    got = holdout_split(rows, "k", 0.2).collect()
    assert len(got) == 100 and sum(r["is_test"] for r in got) == 20
    assert cap_sample(rows, "k", 1000).count() == 100
    assert cap_sample(rows, "k", 37).count() == 37
    assert cap_sample(rows.limit(0), "k", 5).count() == 0


def test_stratified_split_counts_null_as_a_stratum(rows):
    got = stratified_split(rows, "k", ["s"], 0.2).collect()
    share = {}
    for r in got:
        share.setdefault(r["s"], []).append(r["is_test"])
    assert len(got) == 100
    assert {s: (len(v), sum(v)) for s, v in share.items()} == {None: (25, 5), "a": (25, 5), "b": (50, 10)}


def test_marked_rows_are_the_first_ranks(rows):
    clean = rows.where("k is not null")
    first = {r["k"] for r in hash_rank(clean, "k").where("_rank <= 18").collect()}
    assert first == {r["k"] for r in holdout_split(clean, "k", 0.2).where("is_test").collect()}


def test_user_split_keeps_rows_without_a_user(spark):
    df = spark.createDataFrame([(None, "A", 1), (1, "A", 2), (2, None, 3), (3, "Depression_14D", 4)],
                               "user_id long, Source string, t int")
    assert user_split(df).count() == 4


def test_auc_ignores_null_scores_and_labels(spark):
    data = [(0.9, 1), (0.4, 1), (0.5, 0), (0.1, 0), (None, 1), (None, 0), (0.7, None)]
    got = roc_auc(spark.createDataFrame(data, "p double, y int")).first()["roc_auc"]
    assert got == 0.75


def test_poisson_reaches_beyond_forty(spark):
    got = [r[0] for r in spark.range(2000).select(poisson("id", 60.0)).collect()]
    assert max(got) > 70 and abs(sum(got) / 2000 - 60) < 4 * math.sqrt(60 / 2000)


def test_one_hot_of_many_levels(spark):
    df = spark.range(1500).selectExpr("concat('v', id) as c")
    assert len(OneHot("c").fit(df).categories) == 1500
    with pytest.raises(ValueError):
        OneHot("c", max_levels=10).fit(df)
    with pytest.raises(ValueError):
        OneHot("c").fit(spark.range(6000).selectExpr("concat('v', id) as c"))


@pytest.mark.parametrize("drop_first", [False, True])
def test_one_hot_in_long_form_equals_the_wide_one(spark, drop_first):
    train = spark.range(3000).selectExpr("concat('v', id % 700) as c").union(spark.sql("select cast(null as string)"))
    rows = spark.range(800).selectExpr("id", "if(id % 9 = 0, null, concat('v', id)) as c")
    wide = OneHot("c", drop_first=drop_first).fit(train)
    levels = wide.categories[1:] if drop_first else wide.categories
    long = {r["id"]: r["c_index"] for r in OneHotLong("c", drop_first=drop_first).fit(train).transform(rows).collect()}
    assert len(long) == 800
    for r in rows.collect():
        assert long[r["id"]] == (levels.index(r["c"]) if r["c"] in levels else None)
    assert OneHotLong("c").fit(train.where("false")).transform(rows).where("c_index is not null").count() == 0


def test_permuted_copies_keep_each_features_values(spark):
    df = spark.range(50).selectExpr("id", "cast(id as double) as a", "cast(id * 2 as double) as b")
    got = permuted_copies(df, "id", ["a", "b"])
    assert sorted(r["a"] for r in got.where("_feature = 'a'").collect()) == [float(i) for i in range(50)]
    assert got.count() == 150
