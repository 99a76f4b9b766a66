"""Scoring operators (K1-K8): tables of users in, banded results out.

Scoring is a narrow projection after a model transform (the model is
broadcast by ``Model.transform``); no exchange is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import any_not_null, clip, risk_level, score_100
from ..functions.maps import INPUT_COMPLETENESS, INTEGRATION_COLUMNS, MODEL_REGISTRY, PIPELINE_VERSION


def adjust_prob(df: DataFrame, base: str, kind: str = "anxiety", gad2: str = "GAD2", phq2: str = "PHQ2",
                out: str = "prob") -> DataFrame:
    """K1: anxiety weights by GAD2, depression by PHQ2; both zero -> at most 0.20; clip 0-0.99."""
    weight_col = F.col(gad2) if kind == "anxiety" else F.col(phq2)
    p = F.col(base) * (0.8 + 0.4 * (weight_col / 6.0))
    p = F.when((F.col(gad2) == 0) & (F.col(phq2) == 0), F.least(p, F.lit(0.20))).otherwise(p)
    return df.withColumn(out, clip(p, 0.0, 0.99))


def dampen(df: DataFrame, p_stable: str, mood: str = "last_mood", sleep: str = "last_sleep",
           workload: str = "last_workload", out: str = "prob") -> DataFrame:
    """K4: risk = 1 - P(stable); x0.3 when the last day is objectively healthy.

    (The reference multiplies a variable before it is assigned; the evident
    intent -- dampen the computed risk -- is applied.)
    """
    risk = 1.0 - F.col(p_stable)
    healthy = F.coalesce((F.col(mood) >= 8.0) & (F.col(sleep) >= 7.0) & (F.col(workload) <= 3.0), F.lit(False))
    return df.withColumns({out: F.when(healthy, risk * 0.3).otherwise(risk), "dampened": healthy})


def route_and_band(df: DataFrame, prob_integrated: str, prob_clinical: str,
                   integration_cols: Sequence[str] = INTEGRATION_COLUMNS,
                   thresholds: tuple[float, float] = (0.5, 0.4)) -> DataFrame:
    """K5: route each row to the integrated model when any integration column
    is present (else clinical), then band: > .8 high, >= t moderate, else safe;
    confidence = clip(1 - 2|p - t|, .65, .98)."""
    present = [c for c in integration_cols if c in df.columns]
    integrated = any_not_null(present) if present else F.lit(False)
    t_int, t_cli = thresholds
    p = F.when(integrated, F.col(prob_integrated)).otherwise(F.col(prob_clinical))
    t = F.when(integrated, F.lit(t_int)).otherwise(F.lit(t_cli))
    return df.withColumns({
        "selected_model": F.when(integrated, "integrated").otherwise("clinical"),
        "burnout_probability": F.bround(p, 4),
        "risk_level": F.when(p > 0.8, "high").when(p >= t, "moderate").otherwise("safe"),
        "confidence_score": F.bround(F.least(F.greatest(1 - F.abs(p - t) * 2, F.lit(0.65)), F.lit(0.98)), 2),
        "needs_attention": (p >= t).cast("int"),
    })


def format_result(df: DataFrame, prob: str, kind: str | Column) -> DataFrame:
    """K6: 0-100 score with the model threshold at 70; level from the un-truncated score."""
    if isinstance(kind, str) and kind in MODEL_REGISTRY:
        threshold = F.lit(MODEL_REGISTRY[kind]["threshold"])
        version = F.lit(MODEL_REGISTRY[kind]["version"])
    else:
        kcol = F.col(kind) if isinstance(kind, str) else kind
        threshold, version = F.lit(0.5), F.lit("unknown")
        for name, cfg in MODEL_REGISTRY.items():
            threshold = F.when(kcol == name, F.lit(cfg["threshold"])).otherwise(threshold)
            version = F.when(kcol == name, F.lit(cfg["version"])).otherwise(version)
    s = score_100(F.col(prob), threshold)
    return df.withColumns({
        "score": s.cast("int"),
        "riskLevel": risk_level(s),
        "confidence": F.lit("High" if INPUT_COMPLETENESS > 80 else "Medium"),
        "inputCompleteness": F.lit(INPUT_COMPLETENESS),
        "modelVersion": version,
        "pipelineVersion": F.lit(PIPELINE_VERSION),
    })


def humanize(name: Column) -> Column:
    """H3: camel case to lower-case words ('SleepHours' -> 'sleep hours')."""
    return F.lower(F.trim(F.regexp_replace(name, "([A-Z])", " $1")))


def contributor_label(name: Column, value: Column) -> Column:
    """K7 label rules, tested in the reference's order."""
    val = F.format_string("%.1f", F.bround(F.coalesce(value, F.lit(0.0)), 1))
    return (F.when(name.contains("Sleep"), F.concat(F.lit("Sleep pattern variance ("), val, F.lit("h)")))
            .when(name.contains("WorkHours"), F.concat(F.lit("Workload intensity ("), val, F.lit("h)")))
            .when(name.contains("Stress"), F.concat(F.lit("Elevated "), F.lower(name), F.lit(" signals")))
            .when(name.contains("Mood"), F.lit("Emotional fluctuations"))
            .when(name.contains("Workload"), F.lit("High task density"))
            .when(name.contains("GAD2") | name.contains("PHQ2"), F.lit("Clinical screening markers"))
            .otherwise(F.concat(F.lit("Impact from "), humanize(name))))


def top_contributors(df: DataFrame, features: Sequence[str], impact_suffix: str = "", k: int = 3,
                     out: str = "contributors") -> DataFrame:
    """F4 + K7: per row, the k features with the largest |impact| (impact column =
    feature + ``impact_suffix``, e.g. the scaled value) labelled with the raw value.

    Ties keep the feature order of the model (numpy ``argsort`` descending on a
    stable sort reverses it; the reference's order is unspecified for ties).
    """
    items = [F.struct(F.abs(F.col(f + impact_suffix)).alias("impact"), F.lit(i).alias("pos"), F.lit(f).alias("name"),
                      F.col(f).cast("double").alias("value")) for i, f in enumerate(features)]
    arr = F.array(*items)
    ranked = F.array_sort(arr, lambda a, b: F.when(a["impact"] > b["impact"], -1).when(a["impact"] < b["impact"], 1)
                          .when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0))
    top = F.slice(ranked, 1, k)
    return df.withColumns({
        f"{out}_features": F.transform(top, lambda s: s["name"]),
        out: F.transform(top, lambda s: contributor_label(s["name"], s["value"])),
    })
