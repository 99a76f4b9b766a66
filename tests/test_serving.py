"""Batch scoring over model tables: against a plain computation, with its gates, ties and odd requests."""

import math
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from riskframe.operators import serving as SV
from riskframe.operators.timeline import DETERIORATION_FEATURES, history_inputs, serve_deterioration

HISTORY = "array<struct<day:int,mood:double,sleep:double,workload:double>>"


def days(n, mood=5.0, sleep=7.0, workload=5.0, seed=None):
    r = random.Random(seed)
    out = [(i, *(v if seed is None else r.choice([None, round(r.uniform(0, 10), 2), round(r.uniform(0, 10), 2)])
                 for v in (mood, sleep, workload))) for i in range(n)]
    r.shuffle(out)
    return out


def test_history_inputs_equal_the_window_version(spark):
    users = [(f"u{i}", days(i % 12, seed=i)) for i in range(60)] + [("none", None)]
    table = spark.createDataFrame(users, f"user_id string, history {HISTORY}")
    got = {r["user_id"]: r for r in table.select("user_id", *[c.alias(k) for k, c in history_inputs(F.col("history")).items()]).collect()}
    flat = table.select("user_id", F.explode("history").alias("d")).select("user_id", "d.*")
    for r in serve_deterioration(flat).collect():
        for c in DETERIORATION_FEATURES:
            assert got[r["user_id"]][c] == (None if r[c] is None else pytest.approx(float(r[c]), abs=1e-9)), (r["user_id"], c)
    assert all(got["none"][c] is None for c in DETERIORATION_FEATURES)


def training():
    r = random.Random(5)
    rows = []
    for i in range(400):
        y = r.choice([0, 0, 1])
        rows.append(("stress", y, [r.gauss(2 * y, 1), 0.1, r.gauss(0, 3)]))
        rows.append(("deterioration", r.choice([0, 1, 3]), [r.gauss(0, 1), r.gauss(5, 2)]))
    return rows + [("stress", None, [9.0, 9.0, 9.0]), ("stress", 1, [None, 1.0, 1.0]), ("other", 1, [1.0])]


def test_models_equal_a_plain_discriminant(spark):
    rows = training()
    names = {"stress": ["a", "constant", "b"], "deterioration": ["c", "d"]}
    df = spark.createDataFrame(rows, "kind string, y int, x array<double>").repartition(4)
    got = {r["kind"]: r for r in SV.fit_models(df, names).collect()}
    assert set(got) == {"stress", "deterioration", "other"}
    for kind in names:
        known = [(y, x) for k, y, x in rows if k == kind and y is not None and None not in x]
        n, dim = len(known), len(names[kind])
        mean = [sum(x[i] for _, x in known) / n for i in range(dim)]
        scale = [math.sqrt(sum((x[i] - mean[i]) ** 2 for _, x in known) / n) for i in range(dim)]
        scale = [1.0 if s < 1e-9 else s for s in scale]
        assert got[kind]["mean"] == pytest.approx(mean) and got[kind]["scale"] == pytest.approx(scale)
        assert got[kind]["classes"] == sorted({y for y, _ in known}) and got[kind]["features"] == names[kind]
        for c, w, b in zip(got[kind]["classes"], got[kind]["weights"], got[kind]["bias"]):
            own = [x for y, x in known if y == c]
            want = [(sum(x[i] for x in own) / len(own) - mean[i]) / scale[i] for i in range(dim)]
            assert w == pytest.approx(want, abs=1e-9)
            assert b == pytest.approx(math.log(len(own) / n) - sum(v * v for v in want) / 2)
    assert SV.register_models(SV.fit_models(df, names)).count() == 2  # "other" is not in the registry
    assert SV.model_rows(SV.fit_models(df, names)).count() == 2 * 3 + 3 * 2  # "other" names no features


@pytest.fixture(scope="module")
def models(spark):
    r = random.Random(7)
    base = spark.createDataFrame([(1,)], "a int")
    empty = spark.createDataFrame([], f"history {HISTORY}")
    inputs = SV.request_inputs(empty)
    rows = [(k, i % 2, [r.gauss(i % 2, 1) for _ in c]) for k, c in inputs.items() for i in range(60) if k != "burnout"]
    assert base.count() == 1
    fitted = SV.fit_models(spark.createDataFrame(rows, "kind string, y int, x array<double>"), {k: list(c) for k, c in inputs.items()})
    return SV.register_models(fitted).cache()


REQUESTS = f"request_id string, predictionType string, sleep_hours double, reply string, version_note string, history {HISTORY}"


def test_gates_and_messages(spark, models):
    rows = [("ok", "stress", 5.0, None, "v", None), ("unknown", "mood", 5.0, None, "v", None), ("null", None, 5.0, None, "v", None),
            ("unloaded", "burnout", 5.0, None, "v", None), ("short", "deterioration", None, None, "v", days(6)),
            ("none", "deterioration", None, None, "v", None), ("blind", "deterioration", None, None, "v", days(8, mood=None)),
            ("long", "deterioration", None, None, "v", days(9, seed=3)), ("healthy", "deterioration", None, None, "v", days(7, 9.0, 8.0, 2.0))]
    df = spark.createDataFrame(rows, REQUESTS).unionByName(spark.createDataFrame(rows[:1], REQUESTS))
    out = SV.score_requests(df, models, datetime(2025, 3, 1, 9, 0, tzinfo=timezone(timedelta(hours=2))))
    assert out.columns[:len(df.columns)] == df.columns and out.count() == len(rows) + 1
    got = {r["request_id"]: r for r in out.collect()}
    assert {k: r["message"] for k, r in got.items()} == {
        "ok": None, "unknown": "Unknown prediction type mood", "null": "Unknown prediction type None",
        "unloaded": "Model not loaded", "short": "Min 7 days required.", "none": "Min 7 days required.",
        "blind": "Missing 'mood' data in history.", "long": None, "healthy": None}
    for k, r in got.items():
        assert r["success"] == (r["message"] is None) == (r["score"] is not None) == (r["generatedAt"] is not None)
        if r["success"]:
            assert r["generatedAt"] == "2025-03-01T07:00:00Z" and len(r["contributors"]) == 3 and r["aiAvailable"] is True
            assert r["why"].startswith("This result is primarily influenced by: " + r["contributors"][0])
    assert got["long"]["lead_time"] == "7 Days" and got["ok"]["lead_time"] is None


def test_healthy_days_dampen_and_replies_are_used(spark, models):
    rows = [("r1", "stress", 6.0, '{"title": "T", "actions": ["A"]}', "v", None), ("r2", "stress", 6.0, '{"title": "T"', "v", None),
            ("r3", "stress", 6.0, '{"summary": "SYSTEM_FALLBACK"}', "v", None), ("d1", "deterioration", None, None, "v", days(7, 9.0, 8.0, 2.0))]
    got = {r["request_id"]: r for r in SV.score_requests(spark.createDataFrame(rows, REQUESTS), models).collect()}
    assert (got["r1"]["title"], got["r1"]["actions"], got["r1"]["why"]) == ("T", ["A"], "")
    assert got["r2"]["title"].endswith(("Check-in", "Signals Detected")) and got["r2"]["actions"]
    assert got["r3"]["title"] == "Your stress Check-in" and got["r3"]["aiAvailable"] is False
    assert got["d1"]["probability"] <= 0.3
    assert got["r1"]["generatedAt"].endswith("Z") and len(got["r1"]["generatedAt"]) == len("2025-01-01T00:00:00.000000Z")


def test_wrong_feature_order_fails_the_row_and_empty_tables_score(spark, models):
    turned = models.withColumn("features", F.reverse("features"))
    rows = [("r1", "stress", 6.0, None, "v", None)]
    df = spark.createDataFrame(rows, REQUESTS)
    assert [r["message"] for r in SV.score_requests(df, turned).collect()] == ["Feature order mismatch"]
    assert SV.score_requests(df.where("false"), models).count() == 0
    assert [r["message"] for r in SV.score_requests(df, models.where("false")).collect()] == ["Model not loaded"]
    plain = df.select("request_id", "predictionType")  # no history, no reply, no fields: defaults
    assert [r["success"] for r in SV.score_requests(plain, models).collect()] == [True]
