"""Hand-computed edge tables for the pandas missing-value rules and invariants."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.functions import (capitalize, clip, coerce_numeric, half_even, isin_false_on_null, pct_change,
                                 row_mean, row_sum, word_or_number)
from riskframe.functions.maps import SLEEP_HOURS_WORDS
from riskframe.operators import metrics as M
from riskframe.operators import timeline as tl
from riskframe.operators.splits import cap_sample, hash_rank, stratified_split, user_split
from riskframe.operators.text import json_valid


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-3.0,), (12.0,), (5.0,)], "x double")
    got = [r[0] for r in df.select(clip("x", 0, 10)).collect()]
    assert got == [None, 0.0, 10.0, 5.0]


def test_row_sum_and_mean(spark):
    df = spark.createDataFrame([(None, None), (1.0, None), (1.0, 3.0)], "a double, b double")
    out = df.select(row_sum(["a", "b"]).alias("s"), row_mean(["a", "b"]).alias("m"))
    assert rows(out, "s", "m") == [(0.0, None), (1.0, 1.0), (4.0, 2.0)]


def test_pct_change_zero_divisor(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (-1.0, 0.0), (3.0, 2.0), (1.0, None)], "c double, p double")
    got = [r[0] for r in df.select(pct_change("c", "p")).collect()]
    assert got[0] == math.inf and got[1] is None and got[2] == -math.inf and got[3] == 0.5 and got[4] is None


def test_capitalize_is_not_initcap(spark):
    df = spark.createDataFrame([("hIGH risk",), ("low",), (None,)], "s string")
    assert [r[0] for r in df.select(capitalize("s")).collect()] == ["High risk", "Low", None]


def test_half_even(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (-2.5,), (2.4,)], "x double")
    assert [r[0] for r in df.select(half_even("x")).collect()] == [2.0, 4.0, -2.0, 2.0]


def test_isin_null_is_false(spark):
    df = spark.createDataFrame([(None,), ("High",)], "s string")
    assert [r[0] for r in df.select(isin_false_on_null("s", ["High"])).collect()] == [False, True]


def test_coerce_numeric_rejects_java_literals(spark):
    df = spark.createDataFrame([(" 7.5 ",), ("1d",), ("nan",), ("Infinity",), ("1e3",), ("-.5",), ("n/a",)], "s string")
    assert [r[0] for r in df.select(coerce_numeric("s")).collect()] == [7.5, None, None, None, 1000.0, -0.5, None]


def test_word_or_number(spark):
    df = spark.createDataFrame([(" 7-8 Hours",), ("6.5",), ("unknown",), (None,)], "s string")
    got = [r[0] for r in df.select(word_or_number("s", SLEEP_HOURS_WORDS)).collect()]
    assert got == [7.5, 6.5, None, None]


def test_json_validity(spark):
    df = spark.createDataFrame([('{"k": 1}',), ('{"k": 1}}',), ("[1]",), ("nope",), (None,)], "t string")
    assert [r[0] for r in df.select(json_valid(F.col("t"))).collect()] == [True, False, False, False, False]


def test_run_length_matches_pandas_islands(spark):
    flags = [0, 1, 1, 0, 1, 1, 1, 0, 0, 1]
    pdf = pd.Series(flags)
    expected = pdf.groupby((pdf != pdf.shift()).cumsum()).cumsum().tolist()
    df = spark.createDataFrame([("u", i, f) for i, f in enumerate(flags)], "user_id string, timepoint int, f int")
    w = tl.user_window()
    got = [r[0] for r in df.select(tl.run_length(F.col("f"), w).alias("r"), "timepoint").orderBy("timepoint").collect()]
    assert got == expected


def test_lead7_drops_last_seven_rows_per_user(spark):
    data = [("a", i, float(i % 4) + 5.0, None, None) for i in range(10)] + \
           [("b", i, 9.0, None, None) for i in range(5)]
    df = spark.createDataFrame(data, "user_id string, timepoint int, Stress double, Workload double, Depression double")
    out = tl.deterioration_targets(df)
    counts = {r[0]: r[1] for r in out.groupBy("user_id").count().collect()}
    assert counts == {"a": 3}  # 10 - 7 rows kept, the 5-row user disappears


def test_deterioration_targets_match_pandas(spark):
    vals = [5.0, 5.0, 9.0, 9.5, 9.0, 2.0, 0.0, 0.0, 4.0, 8.0, 8.0, 8.0, 3.0, 6.0, 7.0]
    pdf = pd.DataFrame({"CompositeRisk": vals})
    pdf["IsSevere"] = (pdf.CompositeRisk >= 8.0).astype(int)
    pdf["R"] = pdf.CompositeRisk.rolling(7, min_periods=1).mean()
    pdf["V"] = pdf.R.pct_change().fillna(0) * 100
    pdf["C"] = pdf.IsSevere.groupby((pdf.IsSevere != pdf.IsSevere.shift()).cumsum()).cumsum()

    def lab(r):
        if r.V > 30 or r.C >= 3:
            return 3
        return 2 if r.V > 15 else (1 if r.V > 5 else 0)
    pdf["T"] = pdf.apply(lab, axis=1)
    df = spark.createDataFrame([("u", i, v) for i, v in enumerate(vals)], "user_id string, timepoint int, Stress double")
    out = tl.deterioration_targets(df, keep_unlabelled=True).orderBy("timepoint")
    got = rows(out, "RollingMean_7D", "ConsecutiveSevere", "Target_Current")
    assert [g[2] for g in got] == pdf["T"].tolist()
    assert [g[1] for g in got] == pdf["C"].tolist()
    assert all(abs(a - b) < 1e-12 for (a, _, _), b in zip(got, pdf["R"]))


def test_serving_payload_seven_day_decline(spark):
    """Reference sample payload: day d = 1..7, mood 9-d, sleep 9-d, workload d+1."""
    hist = [("u", d, 9.0 - d, 9.0 - d, d + 1.0) for d in range(1, 8)]
    df = spark.createDataFrame(hist, "user_id string, day int, mood double, sleep double, workload double")
    out = tl.serve_deterioration(df).collect()[0]
    mood = pd.Series([9.0 - d for d in range(1, 8)])
    sleep = mood.copy()
    assert out["status"] == "ok"
    assert out["SleepDecline_7D"] == pytest.approx(sleep.iloc[0] - sleep.iloc[-1])
    assert out["MoodVolatility"] == pytest.approx(mood.rolling(7).std().iloc[-1])
    # mood < 4 on the last two days (3, 2) -> run of 2
    assert out["ConsecutiveRiskDays"] == 2


def test_serving_insufficient_history(spark):
    df = spark.createDataFrame([("u", d, 5.0, 7.0, 5.0) for d in range(3)],
                               "user_id string, day int, mood double, sleep double, workload double")
    r = tl.serve_deterioration(df).collect()[0]
    assert r["status"] == "insufficient_data" and r["MoodMini"] is None


def test_hash_rank_exact_and_dense(spark):
    df = spark.range(0, 5000).withColumn("g", (F.col("id") % 3).cast("int"))
    r = hash_rank(df, "id", ["g"], prefix_hex=2)
    per = r.groupBy("g").agg(F.min("_rank").alias("lo"), F.max("_rank").alias("hi"), F.count("*").alias("n"),
                             F.countDistinct("_rank").alias("d")).collect()
    for row in per:
        assert row["lo"] == 1 and row["hi"] == row["n"] == row["d"]


def test_stratified_split_sizes(spark):
    df = spark.range(0, 1003).withColumn("s", F.when(F.col("id") % 10 == 0, "a").otherwise("b"))
    out = stratified_split(df, "id", ["s"], 0.2)
    n_test = out.filter("is_test").count()
    assert n_test == math.ceil(0.2 * 1003)
    assert out.count() == 1003


def test_cap_sample_exact(spark):
    df = spark.range(0, 700)
    assert cap_sample(df, "id", 250).count() == 250
    assert cap_sample(df, "id", 10_000).count() == 700


def test_user_split_disjoint(spark):
    df = spark.createDataFrame([(f"u{i}", t, "Depression_14D" if i % 3 == 0 else "WFH") for i in range(60) for t in range(3)],
                               "user_id string, timepoint int, Source string")
    s = user_split(df, source="Source").select("user_id", "Split").distinct()
    assert s.count() == 60
    by = {r[0]: r[1] for r in s.groupBy("Split").count().collect()}
    assert by == {"train": 8 + 32, "test": 12, "val": 8}


def test_auc_symmetric_under_label_flip(spark):
    df = spark.createDataFrame([(i / 10.0, int(i % 3 == 0)) for i in range(10)] * 3, "p double, y int")
    a = M.roc_auc(df).collect()[0][0]
    flipped = df.select((1 - F.col("p")).alias("p"), "y")
    b = M.roc_auc(flipped).collect()[0][0]
    assert a + b == pytest.approx(1.0)


def test_auc_matches_bruteforce(spark):
    import itertools
    data = [(round((i * 37 % 17) / 17, 3), int(i % 4 == 0)) for i in range(80)]
    pos = [p for p, y in data if y == 1]
    neg = [p for p, y in data if y == 0]
    brute = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in itertools.product(pos, neg)) / (len(pos) * len(neg))
    df = spark.createDataFrame(data, "p double, y int")
    assert M.roc_auc(df).collect()[0][0] == pytest.approx(brute)


def test_poisson_draws_have_the_right_mean(spark):
    from riskframe.functions.noise import poisson
    df = spark.range(0, 20000).select(poisson("id", 3.0, 42, "t").alias("k"))
    mean = df.agg(F.avg("k")).collect()[0][0]
    assert abs(mean - 3.0) < 0.1


def test_typed_replies_take_defaults_nulls_and_fallbacks(spark):
    from riskframe.operators import text as T
    rows = [("all", '{"title":"T","recommendations":["a","b","c","d"],"safe":false,"emotionalScore":2}'), ("null", '{"title":null}'),
            ("types", '{"title":{"x":1},"recommendations":"abc","safe":"no","emotionalScore":"1"}'), ("none", None), ("text", "hello"),
            ("list", "[1]"), ("tail", '{"title":"T"} x'), ("mixed", '{"recommendations":["a",1,{"b":2}]}')]
    df = spark.createDataFrame(rows, "k string, payload string")
    weekly = {r["k"]: r for r in T.typed_reply(df, "payload", "weekly").collect()}
    assert weekly["all"]["reply_title"] == "T" and weekly["all"]["reply_recommendations"] == ["a", "b", "c"]
    assert weekly["null"]["reply_title"] is None and weekly["null"]["reply_summary"] == ""
    assert weekly["types"]["reply_title"] == "Your Weekly Insight" and weekly["types"]["reply_recommendations"] == []
    assert [weekly[k]["reply_valid"] for k in ("none", "text", "list", "tail")] == [False] * 4
    assert weekly["tail"]["reply_title"] == T.WEEKLY_FALLBACK["title"] and weekly["list"]["reply_recommendations"] == T.WEEKLY_FALLBACK["recommendations"]
    assert weekly["mixed"]["reply_recommendations"][0] == "a" and len(weekly["mixed"]["reply_recommendations"]) == 3
    tone = {r["k"]: r for r in T.typed_reply(df, "payload", "tone").collect()}
    assert tone["all"]["reply_safe"] is False and tone["types"]["reply_safe"] is None and tone["text"]["reply_reason"] == "Fallback"
    journal = {r["k"]: r for r in T.typed_reply(df, "payload", "journal").collect()}
    assert journal["all"]["reply_emotionalScore"] == 2.0 and journal["types"]["reply_emotionalScore"] is None
    assert journal["none"]["reply_emotionalScore"] == 5.0 and journal["none"]["reply_detectedTriggers"] == []


def test_poisson_of_large_rates_has_the_right_mean_and_spread(spark):
    from riskframe.functions.noise import poisson
    df = spark.range(4000).select("id", *[poisson("id", rate, 3, "t").alias(f"r{i}") for i, rate in enumerate((3.0, 499.0, 2000.0))],
                                  poisson("id", F.lit(None).cast("double")).alias("none"))
    row = df.agg(*[f(f"r{i}") for i in range(3) for f in (F.avg, F.var_pop)], F.count("none")).first()
    for i, rate in enumerate((3.0, 499.0, 2000.0)):
        assert abs(row[2 * i] - rate) < 5 * (rate / 4000) ** 0.5 and 0.85 < row[2 * i + 1] / rate < 1.15
    assert row[6] == 0


def test_minmax_maps_words_first(spark):
    from riskframe.operators.aggregates import minmax10
    rows = [(" high ", "1"), ("LOW", "3"), ("odd", None), (None, "x")]
    got = minmax10(spark.createDataFrame(rows, "s string, n string"), ["s", "n"], {"s": {"High": 8.0, "Low": 2.0}}).collect()
    assert [round(r["s"], 6) for r in got] == [10.0, 0.0, 5.0, 5.0] and [r["n"] for r in got] == [0.0, 10.0, 5.0, 5.0]
