"""Registered label (I1-I11, I20-I23), feature-set (I12-I16, I24-I26) and
ML-preparation (J1-J11, J23 share) queries with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import map_lookup
from ..functions.maps import DASS_STRESS_ITEMS, POOL_SYNTHETIC_ROWS, STRESS_SOURCE_WEIGHTS
from ..operators import features as FE
from ..operators import labels as L
from ..operators import selection as SEL
from ..operators.aggregates import global_median_fill, importance_share
from ..operators.prep import MedianImputer, OneHot, PopulationScaler
from ..operators.splits import cap_sample, holdout_split, source_weight, stratified_split
from ..sources import fixtures as fx
from .q_survey import BURNOUT_SOURCE_NAMES, POOL, STRESS_SOURCE_NAMES, _lit, pool, sql_cap, sql_map
from .registry import register

ITEMS_PHQ = [f"item_phq{i}" for i in range(1, 10)]


def rsum(cols):
    return " + ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0)" for c in cols)


def clip_sql(x, lo=None, hi=None):
    v = x
    if lo is not None:
        v = f"greatest({v}, {float(lo)})"
    if hi is not None:
        v = f"least({v}, {float(hi)})"
    return f"(CASE WHEN {x} IS NULL THEN NULL ELSE {v} END)"


# ------------------------------------------------------------------ I: labels
_DEP = L.DASS_DEPRESSION_ITEMS


@register("label_dass", f"""WITH {POOL}
SELECT rec_id, {rsum([f'{c} - 1' for c in _DEP])} AS target_raw,
  CAST({rsum([f'{c} - 1' for c in _DEP])} > 13 AS INTEGER) AS RiskCategory,
  {clip_sql(rsum(['Q3A - 1', 'Q5A - 1']), 0, 6)} AS PHQ2,
  {rsum([f'{c} - 1' for c in DASS_STRESS_ITEMS])} AS DASS_Stress FROM pool""")
def q_label_dass(spark, sf_dir):
    """I1 + I7: DASS-42 depression label, PHQ2 proxy and DASS stress score."""
    p = pool(spark, sf_dir).select("rec_id", *[f"Q{i}A" for i in range(1, 43)])
    out = L.dass_stress(L.label_dass(p))
    return out.select("rec_id", "target_raw", "RiskCategory", "PHQ2", "DASS_Stress")


@register("label_phq9", f"""WITH {POOL}
SELECT rec_id, {rsum(ITEMS_PHQ)} AS target_raw, CAST({rsum(ITEMS_PHQ)} >= 10 AS INTEGER) AS RiskCategory,
  {clip_sql(rsum(ITEMS_PHQ[:2]), 0, 6)} AS PHQ2 FROM pool""")
def q_label_phq9(spark, sf_dir):
    """PHQ-9 sum >= 10 (missing items skipped)."""
    p = pool(spark, sf_dir).select("rec_id", *ITEMS_PHQ)
    return L.label_phq9(p, ITEMS_PHQ).select("rec_id", "target_raw", "RiskCategory", "PHQ2")


@register("label_binary", f"""WITH {POOL}
SELECT rec_id, CAST(coalesce({sql_map('trim(BinaryText)', L.BINARY_LABEL_WORDS)}, 0) AS INTEGER) AS RiskCategory FROM pool""")
def q_label_binary(spark, sf_dir):
    """Direct binary label from text."""
    return L.label_binary(pool(spark, sf_dir).select("rec_id", "BinaryText"), "BinaryText").select("rec_id", "RiskCategory")


@register("gender_code", f"""WITH {POOL}
SELECT rec_id, coalesce({sql_map('lower(trim(GenderText))', {k: float(v) for k, v in L.DEPRESSION_GENDER_WORDS.items()})}, 0.0)
         AS Gender_depression,
       coalesce({sql_map(sql_cap('trim(GenderText)'), {k: float(v) for k, v in L.BURNOUT_GENDER_WORDS.items()})}, 0.5)
         AS Gender_burnout FROM pool""")
def q_gender_code(spark, sf_dir):
    """I4: gender codes, depression (unknown 0) and burnout (unknown 0.5) variants."""
    p = pool(spark, sf_dir).select("rec_id", "GenderText")
    p = L.gender_code(p, "GenderText", "depression", "Gender_depression")
    p = L.gender_code(p, "GenderText", "burnout", "Gender_burnout")
    return p.select("rec_id", "Gender_depression", "Gender_burnout")


@register("stress_target", f"""WITH {POOL}
SELECT rec_id, CAST(coalesce(DASS_Stress >= 15, false) OR coalesce(WorkStress >= 7.5, false)
  OR coalesce(WorkStress > 7 AND EmotionalExhaustion > 7, false)
  OR coalesce(WorkHours > 8 AND SleepHours < 5 AND EmotionalExhaustion > 7, false) AS INTEGER) AS Target FROM pool""")
def q_stress_target(spark, sf_dir):
    """Composite stress target (PSS column absent in this pool -> its rule is false)."""
    p = pool(spark, sf_dir).select("rec_id", "DASS_Stress", "WorkStress", "EmotionalExhaustion", "WorkHours", "SleepHours")
    return L.stress_target(p).select("rec_id", "Target")


@register("burnout_target", f"""WITH {POOL}
SELECT rec_id, CAST(RiskCategory AS INTEGER) AS t_direct,
  CAST(coalesce({sql_cap('trim(LevelText)')} IN ('High', 'Severe'), false) AS INTEGER) AS t_level,
  CAST(coalesce(PHQ9 * 3 >= 60, false) AS INTEGER) AS t_score,
  CAST(coalesce({sql_cap('trim(FrequencyText)')} IN ('Often', 'Always', 'Frequently'), false) AS INTEGER) AS t_frequency,
  CAST(coalesce(EmailSentiment >= 0.6, false) AS INTEGER) AS t_threshold FROM pool""")
def q_burnout_target(spark, sf_dir):
    """The five burnout target rules."""
    p = pool(spark, sf_dir).select("rec_id", "RiskCategory", "LevelText", (F.col("PHQ9") * 3).alias("score"),
                                   "FrequencyText", "EmailSentiment")
    p = L.burnout_target(p, "direct_binary", "RiskCategory", "t_direct")
    p = L.burnout_target(p, "burnout_level_map", "LevelText", "t_level")
    p = L.burnout_target(p, "burnout_score_threshold", "score", "t_score")
    p = L.burnout_target(p, "burnout_frequency_map", "FrequencyText", "t_frequency")
    p = L.burnout_target(p, "burnout_threshold_0.6", "EmailSentiment", "t_threshold")
    return p.select("rec_id", "t_direct", "t_level", "t_score", "t_frequency", "t_threshold")


@register("hybrid_label", f"""WITH {POOL}
SELECT rec_id, {clip_sql('round_even(PHQ9 * (2.0 / 9.0), 0)', 0, 6)} AS PHQ2, {clip_sql('round_even(GAD7 * (2.0 / 7.0), 0)', 0, 6)} AS GAD2,
  PHQ9 + GAD7 AS ClinicalTotal, (PHQ9 + GAD7) / 48 * 100 AS RiskScore,
  CAST((PHQ9 + GAD7) / 48 * 100 > 30 AS INTEGER) AS RiskCategory,
  CASE WHEN (PHQ9 + GAD7) / 48 * 100 > 30 THEN {_lit(L.RISK_NAMES[1])} ELSE {_lit(L.RISK_NAMES[0])} END AS RiskCategoryName
FROM pool""")
def q_hybrid_label(spark, sf_dir):
    """Screening proxies and clinical risk label (noise 0)."""
    p = pool(spark, sf_dir).select("rec_id", "PHQ9", "GAD7")
    return L.hybrid_label(p).select("rec_id", "PHQ2", "GAD2", "ClinicalTotal", "RiskScore", "RiskCategory",
                                    "RiskCategoryName")


# ------------------------------------------------------------------ I: feature sets
DEP_COLS = ["AcademicStress", "FinancialStress", "SleepHours", "GPA", "Age", "PHQ2"]


@register("feat_depression", f"""WITH {POOL}, m AS (SELECT {', '.join(f'median({c}) AS m_{c}' for c in DEP_COLS)} FROM pool),
f AS (SELECT rec_id, {', '.join(f'coalesce({c}, m_{c}) AS {c}' for c in DEP_COLS)} FROM pool, m)
SELECT rec_id, AcademicStress + FinancialStress AS StressLoad, AcademicStress - SleepHours AS BurnoutRisk,
  AcademicStress + FinancialStress - SleepHours AS RiskIndex, AcademicStress / (GPA + 1) AS AcademicImpact,
  (AcademicStress + FinancialStress) / (Age + 1) AS AgeStressRatio,
  PHQ2 / (AcademicStress + FinancialStress + 1) AS SymptomStressRatio FROM f""")
def q_feat_depression(spark, sf_dir):
    """Median fill then six depression composites."""
    p = global_median_fill(pool(spark, sf_dir).select("rec_id", *DEP_COLS), DEP_COLS)
    return FE.feat_depression(p).select("rec_id", "StressLoad", "BurnoutRisk", "RiskIndex", "AcademicImpact",
                                        "AgeStressRatio", "SymptomStressRatio")


ANX_COLS = ["OnlineStress", "AcademicStress", "FinancialStress", "SleepHours", "ExerciseFreq", "DietQuality",
            "SleepQuality", "FamilySupport", "PeerRelationship", "SocialActivity", "ScreenTime", "SelfEfficacy"]


@register("feat_anxiety", f"""WITH {POOL}
SELECT rec_id, OnlineStress + AcademicStress + FinancialStress AS StressLoad,
  SleepHours + ExerciseFreq + DietQuality + SleepQuality AS LifestyleScore,
  FamilySupport + PeerRelationship + SocialActivity AS SupportScore,
  ScreenTime + OnlineStress + FinancialStress AS RiskScore,
  SelfEfficacy + DietQuality + ExerciseFreq AS WellnessScore,
  FamilySupport + SocialActivity + SocialActivity AS SupportScore_noPeer,
  0.0 + OnlineStress + FinancialStress AS RiskScore_noScreen FROM pool""")
def q_feat_anxiety(spark, sf_dir):
    """Anxiety sums, with the absent-column fallbacks exercised on a narrower view."""
    p = pool(spark, sf_dir).select("rec_id", *ANX_COLS)
    sums = ["StressLoad", "LifestyleScore", "SupportScore", "RiskScore", "WellnessScore"]
    full = FE.feat_anxiety(p).withColumnsRenamed({c: f"full_{c}" for c in sums})
    both = FE.feat_anxiety(full.drop("PeerRelationship", "ScreenTime"))
    return both.select("rec_id", *[F.col(f"full_{c}").alias(c) for c in sums],
                       F.col("SupportScore").alias("SupportScore_noPeer"), F.col("RiskScore").alias("RiskScore_noScreen"))


@register("feat_hybrid", f"""WITH {POOL}
SELECT rec_id, OnlineStress + AcademicStress + FinancialStress AS StressLoad,
  SleepHours + ExerciseFreq + DietQuality + SleepQuality AS LifestyleScore,
  FamilySupport + PeerRelationship + SocialActivity AS SupportScore, ScreenTime + OnlineStress AS DigitalOverload,
  SelfEfficacy + FamilySupport + PeerRelationship AS MentalResilience, AcademicStress + ScreenTime - SleepHours AS BurnoutRisk,
  OnlineStress + AcademicStress + FinancialStress + ScreenTime - (SleepHours + ExerciseFreq + DietQuality + SleepQuality)
    AS RiskIndex FROM pool""")
def q_feat_hybrid(spark, sf_dir):
    """Seven hybrid composites."""
    p = pool(spark, sf_dir).select("rec_id", *ANX_COLS)
    return FE.feat_hybrid(p).select("rec_id", "StressLoad", "LifestyleScore", "SupportScore", "DigitalOverload",
                                    "MentalResilience", "BurnoutRisk", "RiskIndex")


BURN_COLS = ["SlackActivity", "MeetingParticipation", "EmailSentiment", "WorkloadScore", "OvertimeHours", "StressLevel",
             "AcademicStress", "FinancialStress", "SleepHours", "PhysicalActivity", "SleepQuality", "ExperienceYears",
             "WorkHours", "GPA"]
BURN_FLAGS = FE.BURNOUT_MISSING + FE.BURNOUT_MISSING_EXTRA


@register("feat_burnout", f"""WITH {POOL}
SELECT rec_id,
  (coalesce(SlackActivity, 0.0) + coalesce(MeetingParticipation, 0.0) + (1 - coalesce(EmailSentiment, 0.7))) / 3
    AS DigitalOverloadIndex,
  (coalesce(WorkloadScore, 0.5) + coalesce(OvertimeHours, 0.0) / 40) / 2 AS WorkloadIntensity,
  (coalesce(StressLevel, 5.0) + coalesce(AcademicStress, 0.0) + coalesce(FinancialStress, 0.0)) / 30 AS StressLoad,
  greatest(0.0, (8 - coalesce(SleepHours, 7.0)) / 8) AS SleepDebt,
  ((coalesce(PhysicalActivity, 1.0) / 10) + (coalesce(SleepQuality, 5.0) / 10)) / 2 AS RecoveryScore,
  {', '.join(f'CAST({c} IS NULL AS INTEGER) AS {c}_missing' for c in BURN_FLAGS)} FROM pool""")
def q_feat_burnout(spark, sf_dir):
    """Burnout indices and routing flags (training form)."""
    p = pool(spark, sf_dir).select("rec_id", *BURN_COLS)
    return FE.feat_burnout(p).select("rec_id", "DigitalOverloadIndex", "WorkloadIntensity", "StressLoad", "SleepDebt",
                                     "RecoveryScore", *[f"{c}_missing" for c in BURN_FLAGS])


STRESS_IN = ["WorkHours", "SleepHours", "ScreenTime", "Age", "ExperienceYears", "DASS_Stress", "AcademicStress",
             "EmotionalExhaustion", "JobSatisfaction", "StressLevel"]
STRESS_OUT = ["WorkHours", "SleepHours", "ScreenTime", "Age", "ExperienceYears", "AcademicStress", "JobSatisfaction",
              "WorkStressMini", "ExhaustionMini", "StressLoad", "BurnoutRiskCalc", "RecoveryScore", "RecoveryFailureScore",
              "WeeklyStressTrend", "RecentStressSpike", "WorkHours_missing", "SleepHours_missing", "ScreenTime_missing",
              "WorkStress_missing", "EmotionalExhaustion_missing"]


@register("feat_stress", f"""WITH {POOL},
a AS (SELECT rec_id, WorkHours, SleepHours, ScreenTime, Age, ExperienceYears, JobSatisfaction, EmotionalExhaustion,
        CASE WHEN WorkStress * 1.2 > 10 THEN WorkStress * 1.2 / 10.0 ELSE WorkStress * 1.2 END AS ws,
        coalesce(AcademicStress, 0.0) AS AcademicStress FROM pool),
b AS (SELECT *, CASE WHEN coalesce(ws, 5.0) < 5.0 THEN 2.5 WHEN coalesce(ws, 5.0) < 8.0 THEN 6.0 ELSE 9.0 END AS mini,
        CAST(coalesce(EmotionalExhaustion, 5.0) > 6 AS INTEGER) AS ExhaustionMini,
        coalesce(WorkHours, 8.0) AS wh, coalesce(SleepHours, 7.0) AS sh FROM a)
SELECT rec_id, WorkHours, SleepHours, ScreenTime, Age, ExperienceYears, AcademicStress, JobSatisfaction,
  mini AS WorkStressMini, ExhaustionMini, (mini + AcademicStress) / 2.0 AS StressLoad,
  least(greatest(wh + ExhaustionMini * 5 - sh, 0.0), 20.0) AS BurnoutRiskCalc,
  (coalesce(JobSatisfaction, 5.0) + sh) / 2.0 AS RecoveryScore,
  least(greatest(mini - (coalesce(JobSatisfaction, 5.0) + sh) / 2.0, 0.0), 10.0) AS RecoveryFailureScore,
  mini * 1.0 AS WeeklyStressTrend, mini + least(greatest(8 - sh, 0.0), 8.0) AS RecentStressSpike,
  CAST(WorkHours IS NULL AS INTEGER) AS WorkHours_missing, CAST(SleepHours IS NULL AS INTEGER) AS SleepHours_missing,
  CAST(ScreenTime IS NULL AS INTEGER) AS ScreenTime_missing, CAST(ws IS NULL AS INTEGER) AS WorkStress_missing,
  CAST(EmotionalExhaustion IS NULL AS INTEGER) AS EmotionalExhaustion_missing FROM b""")
def q_feat_stress(spark, sf_dir):
    """I16: stress recovery features with the leakage purge (noise off; Poisson proxies checked in tests)."""
    p = pool(spark, sf_dir).select("rec_id", *STRESS_IN, (F.col("WorkStress") * 1.2).alias("WorkStress"))
    out = FE.feat_stress(p)
    assert "WorkStress" not in out.columns and "DASS_Stress" not in out.columns
    return out.select("rec_id", *STRESS_OUT)


@register("timeline_unify", f"""WITH {POOL},
dep AS (SELECT CAST(cust_id AS VARCHAR) || '_dep' AS user_id,
          CAST(row_number() OVER (PARTITION BY cust_id ORDER BY rec_id) - 1 AS INTEGER) AS timepoint,
          ({rsum(ITEMS_PHQ)}) / 27 * 10 AS Depression, CAST(NULL AS DOUBLE) AS Workload, CAST(NULL AS DOUBLE) AS ScreenTime,
          'Depression_14D' AS Source FROM pool WHERE DatasetSource IN ('S1', 'S2')),
wfh AS (SELECT CAST(cust_id AS VARCHAR) || '_wfh', CAST(row_number() OVER (PARTITION BY cust_id ORDER BY rec_id) - 1 AS INTEGER),
          NULL, WorkHours / 1.5, ScreenTime / 1.5, 'WFH_Burnout' FROM pool WHERE DatasetSource NOT IN ('S1', 'S2'))
SELECT * FROM dep UNION ALL SELECT * FROM wfh""")
def q_timeline_unify(spark, sf_dir):
    """Two sources into one timeline (suffixes, ordinal within user, rescaling)."""
    p = pool(spark, sf_dir)
    dep = p.filter(F.col("DatasetSource").isin("S1", "S2")).select(
        F.col("cust_id").alias("user_id"), F.col("rec_id").alias("row_order"), *ITEMS_PHQ)
    wfh = p.filter(~F.col("DatasetSource").isin("S1", "S2")).select(
        F.col("cust_id").alias("user_id"), F.col("rec_id").alias("row_order"),
        F.col("WorkHours").alias("work_hours"), F.col("ScreenTime").alias("screen_time_hours"))
    out = L.timeline_unify(dep, wfh)
    return out.select("user_id", "timepoint", "Depression", "Workload", "ScreenTime", "Source")


@register("normalise_source", f"""WITH {POOL},
b AS (SELECT rec_id, {sql_map('DatasetSource', BURNOUT_SOURCE_NAMES)} AS DatasetSource, StressLevel,
        EmailSentiment AS ScreenTime FROM pool),
m AS (SELECT DatasetSource, max(ScreenTime) AS mx FROM b GROUP BY 1)
SELECT rec_id, DatasetSource,
  CASE WHEN contains(DatasetSource, 'Synthetic') THEN 1 + 5 * StressLevel ELSE StressLevel END AS StressLevel,
  CASE WHEN contains(DatasetSource, 'Synthetic') AND coalesce(mx <= 1, false) THEN ScreenTime * 12 ELSE ScreenTime END
    AS ScreenTime
FROM b JOIN m USING (DatasetSource)""")
def q_normalise_source(spark, sf_dir):
    """Synthetic-source distribution alignment."""
    b = pool(spark, sf_dir).select("rec_id", map_lookup(BURNOUT_SOURCE_NAMES, "DatasetSource").alias("DatasetSource"),
                                   "StressLevel", F.col("EmailSentiment").alias("ScreenTime"))
    return L.normalise_source(b).select("rec_id", "DatasetSource", "StressLevel", "ScreenTime")


@register("pool_balanced", f"""WITH {POOL},
b AS (SELECT rec_id, {sql_map('DatasetSource', BURNOUT_SOURCE_NAMES)} AS DatasetSource, StressLevel,
        EmailSentiment AS ScreenTime FROM pool),
m AS (SELECT DatasetSource, max(ScreenTime) AS mx FROM b GROUP BY 1),
n AS (SELECT rec_id, DatasetSource,
        CASE WHEN contains(DatasetSource, 'Synthetic') THEN 1 + 5 * StressLevel ELSE StressLevel END AS StressLevel,
        CASE WHEN contains(DatasetSource, 'Synthetic') AND coalesce(mx <= 1, false) THEN ScreenTime * 12
             ELSE ScreenTime END AS ScreenTime
      FROM b LEFT JOIN m USING (DatasetSource))
SELECT * FROM n WHERE NOT coalesce(contains(DatasetSource, 'Synthetic'), false)
UNION ALL
SELECT * FROM (SELECT * FROM n WHERE contains(DatasetSource, 'Synthetic')
               ORDER BY md5(CAST(rec_id AS VARCHAR) || '#42'), rec_id LIMIT {POOL_SYNTHETIC_ROWS})""")
def q_pool_balanced(spark, sf_dir):
    """I22 variant C: the normalised pool's non-synthetic rows plus an exact sample of its synthetic rows."""
    b = pool(spark, sf_dir).select("rec_id", map_lookup(BURNOUT_SOURCE_NAMES, "DatasetSource").alias("DatasetSource"),
                                   "StressLevel", F.col("EmailSentiment").alias("ScreenTime"))
    return L.balanced_pool(L.normalise_source(b), "rec_id", synthetic_rows=POOL_SYNTHETIC_ROWS).select(
        "rec_id", "DatasetSource", "StressLevel", "ScreenTime")


@register("holdout_map", f"""WITH {POOL}
SELECT rec_id, WorkHours, SleepHours, ScreenTime, {clip_sql('PerformanceScore * 20 / 10.0', 0, 10)} AS StressLevel,
  CAST(coalesce({sql_cap('trim(LevelText)')} IN ('High', 'Medium'), false) AS INTEGER) AS RiskCategory FROM pool""")
def q_holdout_map(spark, sf_dir):
    """Hold-out source mapped to the training scale (rename, stress/10, label)."""
    p = pool(spark, sf_dir).select("rec_id", F.col("WorkHours").alias("work_hours"), F.col("SleepHours").alias("sleep_hours"),
                                   F.col("ScreenTime").alias("screen_time_hours"),
                                   (F.col("PerformanceScore") * 20).alias("burnout_score"),
                                   F.col("LevelText").alias("burnout_risk"))
    m = {"work_hours": "WorkHours", "sleep_hours": "SleepHours", "screen_time_hours": "ScreenTime",
         "burnout_score": "StressLevel"}
    return L.holdout_map(p, m).select("rec_id", "WorkHours", "SleepHours", "ScreenTime", "StressLevel", "RiskCategory")


# ------------------------------------------------------------------ I: serving features
HYB_REQ = {"phq2_score": "PHQ2", "gad2_score": "GAD2", "online_stress": "OnlineStress", "academic_performance": "GPA",
           "sleep_hours": "SleepHours", "family_support": "FamilySupport", "diet_quality": "DietQuality",
           "sleep_quality": "SleepQuality", "exercise_freq": "ExerciseFreq", "peer_relationship": "PeerRelationship",
           "social_activity": "SocialActivity", "self_efficacy": "SelfEfficacy", "academic_stress": "AcademicStress",
           "screen_time": "ScreenTime"}


def _req_sql(mapping, defaults):
    return ", ".join(f"coalesce({src}, {float(defaults[f])}) AS {f}" for f, src in mapping.items())


@register("serve_hybrid", f"""WITH {POOL}, r AS (SELECT rec_id, {_req_sql(HYB_REQ, FE.ANXIETY_DEFAULTS)} FROM pool)
SELECT rec_id, phq2_score AS PHQ2, gad2_score AS GAD2, online_stress AS OnlineStress, academic_performance AS GPA,
  sleep_hours AS SleepHours, family_support AS FamilySupport, diet_quality AS DietQuality,
  sleep_hours + exercise_freq + diet_quality + sleep_quality AS LifestyleScore,
  family_support + peer_relationship + social_activity AS SupportScore,
  self_efficacy + family_support + peer_relationship AS MentalResilience,
  academic_stress + screen_time - sleep_hours AS BurnoutRisk FROM r""")
def q_serve_hybrid(spark, sf_dir):
    """Anxiety / depression request rows -> model inputs."""
    p = pool(spark, sf_dir).select("rec_id", *[F.col(s).alias(f) for f, s in HYB_REQ.items()])
    return FE.serve_hybrid(p)


BURN_REQ = {"work_hours": "WorkHours", "sleep_hours": "SleepHours", "screen_time": "ScreenTime",
            "break_frequency": "BreakFrequency", "stress_level": "StressLevel", "experience_years": "ExperienceYears",
            "job_satisfaction": "JobSatisfaction", "gpa": "GPA", "age": "Age", "social_support": "SocialActivity"}


@register("serve_burnout", f"""WITH {POOL},
r AS (SELECT rec_id, {_req_sql(BURN_REQ, FE.BURNOUT_DEFAULTS)}, FinancialStress AS financial_stress, GPA AS gpa_raw FROM pool)
SELECT rec_id, work_hours AS WorkHours, sleep_hours AS SleepHours, screen_time AS ScreenTime,
  break_frequency AS BreakFrequency, stress_level AS StressLevel, experience_years AS ExperienceYears,
  job_satisfaction AS JobSatisfaction, stress_level AS AcademicStress, coalesce(financial_stress, stress_level) AS FinancialStress,
  gpa AS GPA, {clip_sql('sleep_hours * 1.25 - stress_level * 0.2', 1, 10)} AS SleepQuality, break_frequency AS PhysicalActivity,
  age AS Age, 1.0 AS Gender, greatest(0.0, work_hours - 8.0) AS OvertimeHours, 50.0 AS SlackActivity,
  3.0 AS MeetingParticipation, (job_satisfaction * 0.7 - stress_level * 0.3) / 10.0 AS EmailSentiment,
  least(10.0, work_hours / 10.0 * 10.0) AS WorkloadScore, 3.0 AS PerformanceScore,
  screen_time * 1.5 + work_hours * 0.5 AS DigitalOverloadIndex, least(10.0, work_hours / 10.0 * 10.0) * 1.1 AS WorkloadIntensity,
  stress_level * 2.5 AS StressLoad, greatest(0.0, 8.0 - sleep_hours) AS SleepDebt,
  sleep_hours * 1.1 + break_frequency * 0.6 + social_support * 0.3 AS RecoveryScore,
  work_hours / greatest(1.0, sleep_hours) * (stress_level / 2.0) AS BurnoutRiskIndex,
  0.0 AS ExperienceYears_missing, 0.0 AS WorkHours_missing, CAST(gpa_raw IS NULL AS DOUBLE) AS GPA_missing,
  0.0 AS AcademicStress_missing, 0.0 AS FinancialStress_missing, 1.0 AS SlackActivity_missing,
  {', '.join(f'{v} AS {k}' for k, v in FE.BURNOUT_SOURCE_ONE_HOT.items())} FROM r""")
def q_serve_burnout(spark, sf_dir):
    """Burnout request rows -> the 37 serving features (serving scale)."""
    p = pool(spark, sf_dir).select("rec_id", *[F.col(s).alias(f) for f, s in BURN_REQ.items()],
                                   F.col("FinancialStress").alias("financial_stress"))
    return FE.serve_burnout(p)


STRESS_REQ = {"mood_current": "(10.0 - WorkStress)", "sleep_hours": "SleepHours", "workload_level": "EmotionalExhaustion",
              "job_satisfaction": "JobSatisfaction", "work_hours": "WorkHours", "screen_time": "ScreenTime", "age": "Age",
              "experience_years": "ExperienceYears", "academic_stress": "AcademicStress"}


def _gran(x, smin=1.0, smax=10.0, tmin=1.0, tmax=10.0):
    return f"least(greatest({tmin} + ({x} - {smin}) / ({smax} - {smin}) * ({tmax} - {tmin}), {tmin}), {tmax})"


@register("serve_stress", f"""WITH {POOL}, r AS (SELECT rec_id, {_req_sql(STRESS_REQ, FE.STRESS_DEFAULTS)} FROM pool)
SELECT rec_id, job_satisfaction AS JobSatisfaction, work_hours AS WorkHours, sleep_hours AS SleepHours,
  screen_time AS ScreenTime, age AS Age, experience_years AS ExperienceYears, academic_stress AS AcademicStress,
  {_gran('(11 - mood_current)', tmin=2.5, tmax=8.5)} AS WorkStressMini, {_gran('workload_level', tmin=2.0, tmax=9.0)} AS ExhaustionMini,
  academic_stress + workload_level + (10 - mood_current) AS StressLoad,
  work_hours / greatest(1.0, sleep_hours) AS BurnoutRiskCalc,
  {_gran('sleep_hours', smax=12.0, tmax=10.0)} * 1.2 AS RecoveryScore,
  greatest(0.0, 10 - {_gran('sleep_hours', smax=12.0, tmax=10.0)} * 1.2) AS RecoveryFailureScore,
  0.0 AS WeeklyStressTrend, 0.0 AS RecentStressSpike, CASE WHEN sleep_hours >= 6.0 THEN 0.0 ELSE 1.0 END AS ConsecutivePoorSleepDays,
  0.0 AS HighWorkloadFrequency FROM r""")
def q_serve_stress(spark, sf_dir):
    """Stress request rows -> serving features (granular maps)."""
    p = pool(spark, sf_dir).select("rec_id", *[F.expr(s).alias(f) for f, s in STRESS_REQ.items()])
    return FE.serve_stress(p)


# ------------------------------------------------------------------ J: preparation, splits, weights
SPLIT_SQL = """SELECT *, row_number() OVER (ORDER BY md5(CAST(rec_id AS VARCHAR) || '#42'), rec_id)
      <= ceil(CAST(count(*) OVER () AS DOUBLE) * 0.2) AS is_test FROM pool"""
IMP_COLS = ["GPA", "SleepHours", "ScreenTime"]


@register("holdout_split", f"WITH {POOL} SELECT rec_id, is_test FROM ({SPLIT_SQL})")
def q_holdout_split(spark, sf_dir):
    """Exact 80/20 hold-out, n_test = ceil(0.2 n), by hash order."""
    return holdout_split(pool(spark, sf_dir).select("rec_id"), "rec_id", 0.2)


@register("impute_median", f"""WITH {POOL}, sp AS ({SPLIT_SQL}),
m AS (SELECT {', '.join(f'median({c}) AS m_{c}' for c in IMP_COLS)} FROM sp WHERE NOT is_test)
SELECT rec_id, is_test, {', '.join(f'coalesce({c}, m_{c}) AS {c}' for c in IMP_COLS)} FROM sp, m""")
def q_impute_median(spark, sf_dir):
    """Exact median imputer fitted on the training split only."""
    sp = holdout_split(pool(spark, sf_dir).select("rec_id", *IMP_COLS), "rec_id", 0.2)
    model = MedianImputer(IMP_COLS).fit(sp.filter(~F.col("is_test")))
    return model.transform(sp).select("rec_id", "is_test", *IMP_COLS)


Z_COLS = ["WorkHours", "SleepHours", "GPA", "Age"]


@register("zscore", f"""WITH {POOL}, st AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in Z_COLS)} FROM pool)
SELECT rec_id, {', '.join(f'({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1.0 ELSE s_{c} END AS {c}' for c in Z_COLS)} FROM pool, st""")
def q_zscore(spark, sf_dir):
    """Population-std standard scaler."""
    p = pool(spark, sf_dir).select("rec_id", *Z_COLS)
    return PopulationScaler(Z_COLS).fit(p).transform(p)


SOURCES = ["S1", "S2", "S3", "S4", "S5"]


@register("one_hot", f"""WITH {POOL}
SELECT rec_id, {', '.join(f"CAST(DatasetSource = '{s}' AS DOUBLE) AS DatasetSource_{s}" for s in SOURCES)} FROM pool""")
def q_one_hot(spark, sf_dir):
    """One-hot source, categories fitted on the training split (unknown -> all zero)."""
    sp = holdout_split(pool(spark, sf_dir).select("rec_id", "DatasetSource"), "rec_id", 0.2)
    enc = OneHot("DatasetSource").fit(sp.filter(~F.col("is_test")))
    return enc.transform(sp).select("rec_id", *[f"DatasetSource_{s}" for s in enc.categories])


@register("one_hot_drop", f"""WITH {POOL}
SELECT rec_id, {', '.join(f"CAST(DatasetSource = '{s}' AS DOUBLE) AS DatasetSource_{s}" for s in SOURCES[1:])} FROM pool""")
def q_one_hot_drop(spark, sf_dir):
    """Dummies with the first sorted level dropped."""
    p = pool(spark, sf_dir).select("rec_id", "DatasetSource")
    enc = OneHot("DatasetSource", drop_first=True).fit(p)
    return enc.transform(p).select("rec_id", *[f"DatasetSource_{s}" for s in enc.categories[1:]])


@register("stratified_split", f"""WITH {POOL},
c AS (SELECT RiskCategory, DatasetSource, count(*) AS n_s FROM pool GROUP BY ALL),
a AS (SELECT *, sum(n_s) OVER () AS n, ceil(CAST(sum(n_s) OVER () AS DOUBLE) * 0.2) AS ntt FROM c),
b AS (SELECT *, ntt * n_s / n AS exact, floor(ntt * n_s / n) AS base FROM a),
d AS (SELECT *, ntt - sum(base) OVER () AS lft,
        row_number() OVER (ORDER BY exact - base DESC, RiskCategory, DatasetSource) AS r FROM b),
al AS (SELECT RiskCategory, DatasetSource, base + CAST(r <= lft AS INTEGER) AS n_test FROM d),
rk AS (SELECT rec_id, RiskCategory, DatasetSource, row_number() OVER (PARTITION BY RiskCategory, DatasetSource
         ORDER BY md5(CAST(rec_id AS VARCHAR) || '#42'), rec_id) AS rk FROM pool)
SELECT rec_id, rk <= n_test AS is_test FROM rk JOIN al USING (RiskCategory, DatasetSource)""")
def q_stratified_split(spark, sf_dir):
    """Exact stratified 80/20 split by label and source."""
    p = pool(spark, sf_dir).select("rec_id", "RiskCategory", "DatasetSource")
    return stratified_split(p, "rec_id", ["RiskCategory", "DatasetSource"], 0.2).select("rec_id", "is_test")


@register("source_weight", f"""WITH {POOL}
SELECT rec_id, coalesce({sql_map(sql_map('DatasetSource', STRESS_SOURCE_NAMES), STRESS_SOURCE_WEIGHTS)}, 1.0) AS sample_weight
FROM pool""")
def q_source_weight(spark, sf_dir):
    """Per-source sample weights."""
    p = pool(spark, sf_dir).select("rec_id", map_lookup(STRESS_SOURCE_NAMES, "DatasetSource").alias("DatasetSource"))
    return source_weight(p, STRESS_SOURCE_WEIGHTS).select("rec_id", "sample_weight")


MI_DISCRETE = ["ExerciseFreq", "GAD2", "BreakFrequency", "PHQ2"]


@register("mutual_info", f"""WITH {POOL},
r AS (SELECT min(WorkStress) AS lo, max(WorkStress) AS hi FROM pool),
x AS (SELECT y, ExerciseFreq, GAD2, BreakFrequency, PHQ2,
        CAST(least(floor((WorkStress - lo) * (10 / (hi - lo))), 9) AS DOUBLE) AS WorkStress FROM pool, r),
l AS (""" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS xv, y FROM x WHERE {f} IS NOT NULL"
    for f in MI_DISCRETE + ["WorkStress"]) + """),
j AS (SELECT feature, xv, y, count(*) AS n_xy FROM l GROUP BY ALL),
k AS (SELECT *, sum(n_xy) OVER (PARTITION BY feature) AS n, sum(n_xy) OVER (PARTITION BY feature, xv) AS n_x,
        sum(n_xy) OVER (PARTITION BY feature, y) AS n_y FROM j)
SELECT feature, sum(CAST(n_xy AS DOUBLE) / n * ln(CAST(n_xy AS DOUBLE) * n / (CAST(n_x AS DOUBLE) * n_y))) AS mi
FROM k GROUP BY feature""")
def q_mutual_info(spark, sf_dir):
    """Exact discrete mutual information with the label (WorkStress in 10 equal-width bins)."""
    p = pool(spark, sf_dir).select("y", *MI_DISCRETE, "WorkStress")
    p = SEL.equal_width_bins(p, ["WorkStress"], 10)
    return SEL.mutual_info(p, MI_DISCRETE + ["WorkStress"], "y")


@register("importance_share", f"""WITH {POOL},
st AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in Z_COLS)} FROM pool),
l AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, abs((1.0 / s_{c}) * ({c} - m_{c})) AS imp FROM pool, st" for c in Z_COLS) + """),
m AS (SELECT feature, avg(imp) AS mean_abs FROM l GROUP BY 1)
SELECT feature, mean_abs, mean_abs / sum(mean_abs) OVER () * 100 AS share_pct FROM m""")
def q_importance_share(spark, sf_dir):
    """Mean |linear contribution| per feature and its percent share."""
    p = pool(spark, sf_dir).select("rec_id", *Z_COLS)
    sc = PopulationScaler(Z_COLS).fit(p)
    coef = {c: 1.0 / sc.stats[c][1] for c in Z_COLS}
    mean = {c: sc.stats[c][0] for c in Z_COLS}
    return importance_share(SEL.linear_contributions(p, Z_COLS, coef, mean, "rec_id"))

