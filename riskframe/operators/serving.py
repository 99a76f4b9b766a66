"""Batch scoring of mixed requests (K1-K4, K6-K8, L2, L6, H12): one plan for all models.

A model is a row of a table: its features in order, their means and scales, a vector of weights and a bias for each
class, threshold and version.  A request picks its model by a join on the prediction type, and array expressions apply
it, so a batch of any mix of types is one scan and one join with a table of a row per model, not a ``transform`` per
model.  Models are fitted in one aggregation for all types together.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import risk_level, score_100
from ..functions.maps import INPUT_COMPLETENESS, MODEL_REGISTRY, PIPELINE_VERSION
from .features import burnout_inputs, hybrid_inputs, stress_inputs
from .score import adjust_prob, contributor_label, dampen
from .text import fallback_flag, insight_text, json_valid
from .timeline import history_inputs

#: A spread below this is rounding noise of a constant feature, which then scales by 1.
LEAST_SCALE = 1e-9
#: Impacts are compared at this many decimals, so features with the same standardised value tie.
IMPACT_DIGITS = 6
REPLY_FIELDS = ("title STRING, summary STRING, why STRING, actions ARRAY<STRING>, encouragement STRING, "
                "safetyNote STRING")


# ------------------------------------------------------------------ models as tables
def fit_models(training: DataFrame, names: Mapping[str, list[str]]) -> DataFrame:
    """A linear discriminant with one shared spread per feature, for every ``kind`` of ``training`` (kind, y, x array).

    One aggregation over all kinds: counts, means and variances per (kind, class) by element, combined exactly to those
    of the kind.  Returns kind, features, mean, scale, classes, weights (an array per class) and bias: with
    z = (x - mean) / scale, the score of a class is bias + weights . z.  Rows with a NULL label or a NULL input take no
    part; kinds without rows have no model, and kinds that ``names`` leaves out have NULL features."""
    known = training.where(F.col("y").isNotNull() & F.forall("x", lambda v: v.isNotNull()))
    stats = known.withColumn("v", array_to_vector("x")).groupBy("kind", "y").agg(
        Summarizer.metrics("count", "mean", "variance").summary(F.col("v")).alias("s"))
    count = F.col("s.count").cast("double")
    parts = stats.select("kind", F.struct(
        F.col("y").cast("int").alias("y"), count.alias("n"), vector_to_array("s.mean").alias("mean"),
        F.transform(vector_to_array("s.variance"), lambda v: v * (count - 1) / count).alias("var")).alias("c"))
    kinds = parts.groupBy("kind").agg(F.sort_array(F.collect_list("c")).alias("c"))  # a row per class
    total = F.aggregate("c", F.lit(0.0), lambda a, c: a + c["n"])
    at = F.sequence(F.lit(0), F.size(F.col("c")[0]["mean"]) - 1)
    mean = F.transform(at, lambda i: F.aggregate("c", F.lit(0.0), lambda a, c: a + c["n"] * F.get(c["mean"], i)) / F.col("n"))
    kinds = kinds.withColumn("n", total).withColumn("mean", mean)
    spread = F.transform(at, lambda i: F.sqrt(F.aggregate("c", F.lit(0.0), lambda a, c: a + c["n"] * (
        F.get(c["var"], i) + F.pow(F.get(c["mean"], i) - F.get("mean", i), F.lit(2.0)))) / F.col("n")))
    kinds = kinds.withColumn("scale", F.transform(spread, lambda s: F.when(s < LEAST_SCALE, 1.0).otherwise(s)))
    weights = F.transform("c", lambda c: F.transform(c["mean"], lambda m, i: (m - F.get("mean", i)) / F.get("scale", i)))
    kinds = kinds.withColumn("weights", weights)
    bias = F.zip_with("c", "weights", lambda c, w: F.log(c["n"] / F.col("n"))
                      - F.aggregate(w, F.lit(0.0), lambda a, v: a + v * v) / 2.0)
    features = F.lit(None).cast("array<string>")
    for kind, columns in names.items():
        features = F.when(F.col("kind") == kind, F.array(*[F.lit(c) for c in columns])).otherwise(features)
    return kinds.select("kind", features.alias("features"), "mean", "scale",
                        F.transform("c", lambda c: c["y"]).alias("classes"), "weights", bias.alias("bias"))


def register_models(models: DataFrame, registry: Mapping[str, Mapping] = MODEL_REGISTRY) -> DataFrame:
    """``models`` with the threshold and version of each kind.  Kinds that the registry does not know go."""
    spark = models.sparkSession
    rows = [(k, float(v["threshold"]), v["version"]) for k, v in registry.items()]
    return models.join(spark.createDataFrame(rows, "kind string, threshold double, version string"), "kind")


def model_rows(models: DataFrame) -> DataFrame:
    """The models in long form: kind, position, feature, mean, scale, class, weight."""
    each = models.select("kind", "mean", "scale", "features", F.explode(F.arrays_zip("classes", "weights")).alias("c"))
    flat = each.select("kind", F.col("c.classes").alias("class"), F.posexplode(
        F.arrays_zip("features", "mean", "scale", F.col("c.weights").alias("weight"))).alias("position", "f"))
    return flat.select("kind", "position", F.col("f.features").alias("feature"), F.col("f.mean").alias("mean"),
                       F.col("f.scale").alias("scale"), "class", F.col("f.weight").alias("weight"))


# ------------------------------------------------------------------ requests
def request_inputs(requests: DataFrame, history: str = "history") -> dict[str, dict[str, Column]]:
    """Per prediction type the model's inputs out of the request's fields, in model order."""
    hybrid = hybrid_inputs(requests)
    out = {"stress": stress_inputs(requests), "anxiety": hybrid, "depression": hybrid, "burnout": burnout_inputs(requests)}
    if history in requests.columns:
        out["deterioration"] = history_inputs(F.col(history))
    return out


def iso_utc(moment: datetime | None = None) -> Column:
    """A moment in UTC as ISO text ending in Z; the time of the query without an argument."""
    if moment is None:
        return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    aware = moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)
    return F.lit(aware.astimezone(timezone.utc).isoformat().replace("+00:00", "Z"))


def applied(df: DataFrame, inputs: str = "_x") -> DataFrame:
    """Adds ``_z`` (standardised inputs) and ``_p0`` (the probability of class 0) by the row's own model columns."""
    z = F.transform(inputs, lambda v, i: (v - F.get("mean", i)) / F.get("scale", i))
    scores = F.transform("weights", lambda w, c: F.get("bias", c) + F.aggregate(
        F.zip_with(w, "_z", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v))
    df = df.withColumn("_z", z).withColumn("_s", scores)
    df = df.withColumn("_e", F.transform("_s", lambda s: F.exp(s - F.array_max("_s"))))
    total = F.aggregate("_e", F.lit(0.0), lambda a, v: a + v)
    stable = F.aggregate(F.zip_with("_e", "classes", lambda e, c: F.when(c == 0, e).otherwise(0.0)), F.lit(0.0),
                         lambda a, v: a + v)
    return df.withColumn("_p0", stable / total).drop("_s", "_e")


def main_drivers(k: int = 3) -> Column:
    """Labels of the ``k`` inputs with the largest standardised size; ties keep the model's order."""
    items = F.transform(F.arrays_zip("features", "_z", "_x"), lambda f, i: F.struct(
        (-F.round(F.abs(f["_z"]), IMPACT_DIGITS)).alias("impact"), i.alias("position"), f["features"].alias("name"),
        f["_x"].alias("value")))
    return F.transform(F.slice(F.array_sort(items), 1, k), lambda f: contributor_label(f["name"], f["value"]))


def score_requests(requests: DataFrame, models: DataFrame, generated_at: datetime | None = None,
                   kind: str = "predictionType", history: str = "history", reply: str = "reply",
                   min_days: int = 7) -> DataFrame:
    """K8: every request with its whole reply, whatever its type; the other columns of ``requests`` stay.

    A type without a model, a history shorter than ``min_days`` and a history without moods give a failed row with
    its message and NULL results.  Anxiety and depression are weighed by their screening items (K1), deterioration
    is the probability of leaving class 0, dampened on a healthy last day (K4); score and level put the model's
    threshold at 70 (K6).  Texts come from the rules (L2), or from the column ``reply``, the JSON answer of a language
    model, where it is a valid object; its missing fields take the defaults.  ``models`` is small (a row per
    type): read it from a written table, so that Spark knows its size and broadcasts it."""
    inputs = request_inputs(requests, history)
    has_history = history in requests.columns
    base = requests.columns
    x, names = F.lit(None).cast("array<double>"), {}
    for name, columns in inputs.items():
        x = F.when(F.col(kind) == name, F.array(*[c.cast("double") for c in columns.values()])).otherwise(x)
        names[name] = list(columns)
    size = F.coalesce(F.size(history), F.lit(0)) if has_history else F.lit(0)
    moods = F.exists(history, lambda d: d["mood"].isNotNull()) if has_history else F.lit(False)
    expected = F.lit(None).cast("array<string>")
    for name, columns in names.items():
        expected = F.when(F.col(kind) == name, F.array(*[F.lit(c) for c in columns])).otherwise(expected)
    df = requests.withColumns({"_x": x, "_names": expected}).join(
        models.withColumnsRenamed({"kind": "_kind"}), F.col(kind) == F.col("_kind"), "left")
    late = F.col(kind) == "deterioration"
    message = (F.when(~F.coalesce(F.col(kind).isin(list(MODEL_REGISTRY)), F.lit(False)),
                      F.concat(F.lit("Unknown prediction type "), F.coalesce(F.col(kind), F.lit("None"))))
               .when(F.col("_kind").isNull(), F.lit("Model not loaded"))
               .when(late & (size < min_days), F.lit(f"Min {min_days} days required."))
               .when(late & ~F.coalesce(moods, F.lit(False)), F.lit("Missing 'mood' data in history."))
               .when(F.col("features") != F.col("_names"), F.lit("Feature order mismatch")))  # B17
    df = df.withColumn("message", message).withColumn("success", F.col("message").isNull())
    df = df.withColumn("_x", F.when(F.col("success"), F.transform("_x", lambda v: F.coalesce(v, F.lit(0.0)))))
    df = applied(df)

    item = lambda name: F.coalesce(F.get("_x", F.array_position("features", name) - 1), F.lit(0.0))
    last = F.try_element_at(F.array_sort(history), F.lit(-1)) if has_history else None
    day = {f: last[f].cast("double") if has_history else F.lit(None).cast("double") for f in ("mood", "sleep", "workload")}
    df = df.withColumns({"_p": 1.0 - F.col("_p0"), "_phq2": item("PHQ2"), "_gad2": item("GAD2"),
                         **{f"_{f}": c for f, c in day.items()}})
    df = adjust_prob(df, "_p", "anxiety", "_gad2", "_phq2", "_pa")
    df = adjust_prob(df, "_p", "depression", "_gad2", "_phq2", "_pd")
    df = dampen(df, "_p0", "_mood", "_sleep", "_workload", "_pt")
    probability = (F.when(F.col(kind) == "anxiety", F.col("_pa")).when(F.col(kind) == "depression", F.col("_pd"))
                   .when(late, F.col("_pt")).otherwise(F.col("_p")))
    df = df.withColumn("probability", F.when(F.col("success"), probability))
    points = score_100("probability", "threshold")
    done = lambda c: F.when(F.col("success"), c)
    df = df.withColumns({"score": done(points).cast("int"), "riskLevel": done(risk_level(points)),
                         "contributors": done(main_drivers())})

    df = insight_text(df, kind)
    parsed = F.from_json(reply, REPLY_FIELDS) if reply in base else F.lit(None).cast("struct<title:string>")
    given = F.coalesce(json_valid(F.col(reply)), F.lit(False)) if reply in base else F.lit(False)
    defaults = {"title": F.concat(F.lit("Your "), F.col(kind), F.lit(" Check-in")), "summary": F.lit(""), "why": F.lit(""),
                "actions": F.array().cast("array<string>"), "encouragement": F.lit(""), "safetyNote": F.lit(None)}
    texts = {f: done(F.when(given, F.coalesce(parsed[f], d)).otherwise(F.col(f)) if reply in base else F.col(f))
             for f, d in defaults.items()}
    df = df.withColumns({
        **texts, "confidence": done(F.lit("High" if INPUT_COMPLETENESS > 80 else "Medium")),
        "inputCompleteness": done(F.lit(INPUT_COMPLETENESS)),
        "aiAvailable": done(fallback_flag(F.col(reply)) if reply in base else F.lit(True)),
        "generatedAt": done(iso_utc(generated_at)), "modelVersion": done(F.col("version")),
        "pipelineVersion": done(F.lit(PIPELINE_VERSION)), "lead_time": F.when(late & F.col("success"), F.lit("7 Days"))})
    return df.select(*base, "success", "message", "probability", "score", "riskLevel", "confidence", "inputCompleteness",
                     "contributors", "title", "summary", "why", "actions", "encouragement", "safetyNote", "aiAvailable",
                     "generatedAt", "modelVersion", "pipelineVersion", "lead_time")
