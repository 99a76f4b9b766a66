"""Feature-set operators (I12-I16 training, I24-I26 serving).

Each is one ``withColumns`` projection, so a whole feature set fuses into a
single whole-stage-codegen stage with the scan.  Training and serving rules
differ in the reference (train/serve skew); both are kept, named apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clip, coerce_numeric, step_bucket
from ..functions.buckets import map_granular
from ..functions.maps import STRESS_STEPS
from ..functions.noise import gaussian, poisson, uniform
from .schema import missing_flags


def _get(df: DataFrame, c: str, default: float | None) -> Column:
    """``df.get(c, default).fillna(default)``: absent -> default, NULL -> default."""
    if c not in df.columns:
        return F.lit(default).cast("double")
    return F.col(c) if default is None else F.coalesce(F.col(c), F.lit(float(default)))


def feat_depression(df: DataFrame) -> DataFrame:
    """I12 composites; expects numeric columns already median-filled (see ``prep.MedianImputer``)."""
    c = F.col
    stress_load = c("AcademicStress") + c("FinancialStress")
    return df.withColumns({
        "StressLoad": stress_load,
        "BurnoutRisk": c("AcademicStress") - c("SleepHours"),
        "RiskIndex": stress_load - c("SleepHours"),
        "AcademicImpact": c("AcademicStress") / (c("GPA") + 1),
        "AgeStressRatio": stress_load / (c("Age") + 1),
        "SymptomStressRatio": c("PHQ2") / (stress_load + 1),
    })


def feat_anxiety(df: DataFrame) -> DataFrame:
    """Five sums; PeerRelationship falls back to SocialActivity; ScreenTime absent -> 0."""
    c = F.col
    peer = c("PeerRelationship") if "PeerRelationship" in df.columns else c("SocialActivity")
    screen = c("ScreenTime") if "ScreenTime" in df.columns else F.lit(0.0)
    return df.withColumns({
        "StressLoad": c("OnlineStress") + c("AcademicStress") + c("FinancialStress"),
        "LifestyleScore": c("SleepHours") + c("ExerciseFreq") + c("DietQuality") + c("SleepQuality"),
        "SupportScore": c("FamilySupport") + peer + c("SocialActivity"),
        "RiskScore": screen + c("OnlineStress") + c("FinancialStress"),
        "WellnessScore": c("SelfEfficacy") + c("DietQuality") + c("ExerciseFreq"),
    })


def feat_hybrid(df: DataFrame) -> DataFrame:
    """Seven composites (NULL operands give NULL, as pandas NaN arithmetic)."""
    c = F.col
    stress_load = c("OnlineStress") + c("AcademicStress") + c("FinancialStress")
    lifestyle = c("SleepHours") + c("ExerciseFreq") + c("DietQuality") + c("SleepQuality")
    return df.withColumns({
        "StressLoad": stress_load,
        "LifestyleScore": lifestyle,
        "SupportScore": c("FamilySupport") + c("PeerRelationship") + c("SocialActivity"),
        "DigitalOverload": c("ScreenTime") + c("OnlineStress"),
        "MentalResilience": c("SelfEfficacy") + c("FamilySupport") + c("PeerRelationship"),
        "BurnoutRisk": c("AcademicStress") + c("ScreenTime") - c("SleepHours"),
        "RiskIndex": stress_load + c("ScreenTime") - lifestyle,
    })


BURNOUT_MISSING = ["OvertimeHours", "SlackActivity", "MeetingParticipation", "EmailSentiment", "WorkloadScore"]
BURNOUT_MISSING_EXTRA = ["ExperienceYears", "WorkHours", "GPA"]


def feat_burnout(df: DataFrame, ensemble: bool = False) -> DataFrame:
    """Burnout indices (one function shared by training and the batch ensemble).

    Training form: indices computed only when their source column exists;
    missing flags for absent columns are 1 for the first five, skipped for the
    extra three.  ``ensemble=True``: every absent column uses its default and
    all eight flags are emitted (absent -> 1).
    """
    has = lambda c: c in df.columns
    if ensemble or has("SlackActivity"):
        overload = (_get(df, "SlackActivity", 0) + _get(df, "MeetingParticipation", 0)
                    + (1 - _get(df, "EmailSentiment", 0.7))) / 3
    else:
        overload = F.lit(0.0)
    if ensemble or has("WorkloadScore"):
        intensity = (_get(df, "WorkloadScore", 0.5) + _get(df, "OvertimeHours", 0) / 40) / 2
    else:
        intensity = F.lit(0.0)
    stress = _get(df, "StressLevel", 5.0)
    load = (stress + _get(df, "AcademicStress", 0) + _get(df, "FinancialStress", 0)) / 30
    sleep_h = _get(df, "SleepHours", 7.0)
    debt = F.greatest(F.lit(0.0), (8 - sleep_h) / 8)
    recovery = ((_get(df, "PhysicalActivity", 1.0) / 10) + (_get(df, "SleepQuality", 5.0) / 10)) / 2
    out = df.withColumns({"DigitalOverloadIndex": overload, "WorkloadIntensity": intensity, "StressLoad": load,
                          "SleepDebt": debt, "RecoveryScore": recovery})
    if ensemble:
        return missing_flags(out, BURNOUT_MISSING + BURNOUT_MISSING_EXTRA, absent_value=1)
    out = missing_flags(out, BURNOUT_MISSING, absent_value=1)
    return missing_flags(out, BURNOUT_MISSING_EXTRA)


STRESS_LEAKS = ["DASS_Stress", "burnout_level", "burnout_risk", "StressLevel", "BurnoutRisk",
                "WorkStress", "EmotionalExhaustion", "priority"]
STRESS_NUMERIC = ["WorkHours", "SleepHours", "ScreenTime", "WorkStress", "Age", "ExperienceYears", "DASS_Stress",
                  "AcademicStress", "EmotionalExhaustion"]


def feat_stress(df: DataFrame, key: str = "rec_id", noise: bool = False, seed: int = 42,
                purge: bool = True) -> DataFrame:
    """I16: stress recovery features.

    ``noise=False`` (tested default) leaves out the Gaussian jitter on
    WorkStressMini and the U(0.8, 1.2) trend factor.  The two Poisson proxies
    are always drawn, from a hash of (key, seed, tag), so they are
    reproducible after a task retry.
    """
    from .schema import coerce_columns
    d = coerce_columns(df, STRESS_NUMERIC)
    ws = F.col("WorkStress")
    d = d.withColumn("WorkStress", F.when(ws > 10, ws / 10.0).otherwise(ws))
    mini = step_bucket(F.coalesce(F.col("WorkStress"), F.lit(5.0)), STRESS_STEPS)
    if noise:
        mini = mini + gaussian(key, seed, "ws_mini", 1.0)
    d = d.withColumn("WorkStressMini", clip(mini, 0, 10))
    d = d.withColumn("ExhaustionMini", (F.coalesce(F.col("EmotionalExhaustion"), F.lit(5.0)) > 6).cast("int"))
    d = d.withColumn("AcademicStress", _get(d, "AcademicStress", 0.0))
    work_h = _get(d, "WorkHours", 8.0)
    slp_h = _get(d, "SleepHours", 7.0)
    wsm = F.col("WorkStressMini")
    recovery = (_get(d, "JobSatisfaction", 5.0) + slp_h) / 2.0
    trend = wsm * (uniform(key, 0.8, 1.2, seed, "trend") if noise else F.lit(1.0))
    poor_rate = clip(wsm / 10.0, 0, 1) * 3
    work_rate = clip(work_h / 12.0, 0, 1) * 4
    d = d.withColumns({
        "StressLoad": (wsm + F.col("AcademicStress")) / 2.0,
        "BurnoutRiskCalc": clip(work_h + F.col("ExhaustionMini") * 5 - slp_h, 0, 20),
        "RecoveryScore": recovery,
        "RecoveryFailureScore": clip(wsm - recovery, 0, 10),
        "WeeklyStressTrend": trend,
        "RecentStressSpike": wsm + clip(8 - slp_h, 0, 8),
        "ConsecutivePoorSleepDays": poisson(key, poor_rate, seed, "poor_sleep"),
        "HighWorkloadFrequency": poisson(key, work_rate, seed, "workload"),
    })
    d = missing_flags(d, ["WorkHours", "SleepHours", "ScreenTime", "WorkStress", "EmotionalExhaustion"])
    return d.drop(*[c for c in STRESS_LEAKS if c in d.columns]) if purge else d


# ------------------------------------------------------------------ serving
# --- fixed values: request fields and their defaults ---
ANXIETY_DEFAULTS = {
    "phq2_score": 2.0, "gad2_score": 2.0, "online_stress": 3.0, "academic_performance": 3.0, "sleep_hours": 7.0,
    "family_support": 7.0, "diet_quality": 5.0, "sleep_quality": 5.0, "exercise_freq": 3.0,
    "peer_relationship": 5.0, "social_activity": 5.0, "self_efficacy": 5.0, "academic_stress": 5.0,
    "screen_time": 4.0,
}
BURNOUT_DEFAULTS = {
    "work_hours": 8.0, "sleep_hours": 7.0, "screen_time": 5.0, "break_frequency": 3.0, "stress_level": 5.0,
    "experience_years": 2.0, "job_satisfaction": 5.0, "gpa": 3.0, "age": 25.0, "social_support": 5.0,
}
STRESS_DEFAULTS = {
    "mood_current": 5.0, "sleep_hours": 7.0, "workload_level": 5.0, "job_satisfaction": 5.0, "work_hours": 8.0,
    "screen_time": 5.0, "age": 25.0, "experience_years": 2.0, "academic_stress": 5.0,
}


def _req(df: DataFrame, c: str, defaults: dict) -> Column:
    return _get(df, c, defaults[c]).cast("double")


def hybrid_inputs(df: DataFrame) -> dict[str, Column]:
    """The model inputs of an anxiety / depression request, in model order (defaults per field)."""
    g = lambda c: _req(df, c, ANXIETY_DEFAULTS)
    return {
        "PHQ2": g("phq2_score"), "GAD2": g("gad2_score"), "OnlineStress": g("online_stress"),
        "GPA": g("academic_performance"), "SleepHours": g("sleep_hours"),
        "FamilySupport": g("family_support"), "DietQuality": g("diet_quality"),
        "LifestyleScore": g("sleep_hours") + g("exercise_freq") + g("diet_quality") + g("sleep_quality"),
        "SupportScore": g("family_support") + g("peer_relationship") + g("social_activity"),
        "MentalResilience": g("self_efficacy") + g("family_support") + g("peer_relationship"),
        "BurnoutRisk": g("academic_stress") + g("screen_time") - g("sleep_hours"),
    }


def serve_hybrid(df: DataFrame) -> DataFrame:
    """anxiety/depression request -> model inputs (defaults per field)."""
    keep = [F.col(k) for k in df.columns if k not in ANXIETY_DEFAULTS]
    return df.select(*keep, *[v.alias(k) for k, v in hybrid_inputs(df).items()])


BURNOUT_SOURCE_ONE_HOT = {"DatasetSource_Healthcare_Workforce": 0.0, "DatasetSource_Remote_Work": 0.0,
                          "DatasetSource_Student_Burnout": 0.0, "DatasetSource_Synthetic_Employee": 1.0,
                          "DatasetSource_WFH_Corporate": 0.0}


def burnout_inputs(df: DataFrame) -> dict[str, Column]:
    """The model inputs of a burnout request, in model order (serving scale, differs from I15)."""
    g = lambda c: _req(df, c, BURNOUT_DEFAULTS)
    work, sleep, screen, brk, stress = g("work_hours"), g("sleep_hours"), g("screen_time"), g("break_frequency"), g("stress_level")
    job = g("job_satisfaction")
    fin = F.coalesce(F.col("financial_stress").cast("double"), stress) if "financial_stress" in df.columns else stress
    workload_score = F.least(F.lit(10.0), work / 10.0 * 10.0)
    return {
        "WorkHours": work, "SleepHours": sleep, "ScreenTime": screen, "BreakFrequency": brk, "StressLevel": stress,
        "ExperienceYears": g("experience_years"), "JobSatisfaction": job, "AcademicStress": stress,
        "FinancialStress": fin, "GPA": g("gpa"),
        "SleepQuality": clip(sleep * 1.25 - stress * 0.2, 1.0, 10.0), "PhysicalActivity": brk, "Age": g("age"),
        "Gender": F.lit(1.0), "OvertimeHours": F.greatest(F.lit(0.0), work - 8.0), "SlackActivity": F.lit(50.0),
        "MeetingParticipation": F.lit(3.0), "EmailSentiment": (job * 0.7 - stress * 0.3) / 10.0,
        "WorkloadScore": workload_score, "PerformanceScore": F.lit(3.0),
        "DigitalOverloadIndex": screen * 1.5 + work * 0.5, "WorkloadIntensity": workload_score * 1.1,
        "StressLoad": stress * 2.5, "SleepDebt": F.greatest(F.lit(0.0), 8.0 - sleep),
        "RecoveryScore": sleep * 1.1 + brk * 0.6 + g("social_support") * 0.3,
        "BurnoutRiskIndex": work / F.greatest(F.lit(1.0), sleep) * (stress / 2.0),
        "ExperienceYears_missing": F.lit(0.0), "WorkHours_missing": F.lit(0.0),
        "GPA_missing": (F.col("gpa").isNull().cast("double") if "gpa" in df.columns else F.lit(1.0)),
        "AcademicStress_missing": F.lit(0.0), "FinancialStress_missing": F.lit(0.0), "SlackActivity_missing": F.lit(1.0),
        **{k: F.lit(v) for k, v in BURNOUT_SOURCE_ONE_HOT.items()},
    }


def serve_burnout(df: DataFrame) -> DataFrame:
    """Burnout request -> model inputs (serving scale, differs from I15)."""
    keep = [F.col(k) for k in df.columns if k not in BURNOUT_DEFAULTS and k not in ("financial_stress",)]
    return df.select(*keep, *[v.alias(k) for k, v in burnout_inputs(df).items()])


def stress_inputs(df: DataFrame) -> dict[str, Column]:
    """The model inputs of a stress request, in model order (granular maps instead of step buckets)."""
    g = lambda c: _req(df, c, STRESS_DEFAULTS)
    mood, sleep, workload = g("mood_current"), g("sleep_hours"), g("workload_level")
    recovery = map_granular(sleep, scale_max=12.0, target_max=10.0) * 1.2
    return {
        "JobSatisfaction": g("job_satisfaction"), "WorkHours": g("work_hours"), "SleepHours": sleep,
        "ScreenTime": g("screen_time"), "Age": g("age"), "ExperienceYears": g("experience_years"),
        "AcademicStress": g("academic_stress"),
        "WorkStressMini": map_granular(11 - mood, target_min=2.5, target_max=8.5),
        "ExhaustionMini": map_granular(workload, target_min=2.0, target_max=9.0),
        "StressLoad": g("academic_stress") + workload + (10 - mood),
        "BurnoutRiskCalc": g("work_hours") / F.greatest(F.lit(1.0), sleep),
        "RecoveryScore": recovery,
        "RecoveryFailureScore": F.greatest(F.lit(0.0), 10 - recovery),
        "WeeklyStressTrend": F.lit(0.0), "RecentStressSpike": F.lit(0.0),
        "ConsecutivePoorSleepDays": F.when(sleep >= 6.0, F.lit(0.0)).otherwise(F.lit(1.0)),
        "HighWorkloadFrequency": F.lit(0.0),
    }


def serve_stress(df: DataFrame) -> DataFrame:
    """Stress request -> model inputs (granular maps instead of step buckets)."""
    keep = [F.col(k) for k in df.columns if k not in STRESS_DEFAULTS]
    return df.select(*keep, *[v.alias(k) for k, v in stress_inputs(df).items()])


def feature_list(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in set(exclude)]
