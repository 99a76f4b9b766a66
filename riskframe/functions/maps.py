"""Fixed values that must equal the reference's for identical results.

Fixed values: word maps, thresholds, registry entries, keyword lists.  They
are stated once here, in their natural order, and used by the operators.
"""

# --- fixed values: word -> number maps (keys matched lower-case and trimmed
# unless stated otherwise) ---

# sleep-hours words, depression pool
SLEEP_HOURS_WORDS = {
    "5-6 hours": 5.5,
    "less than 5 hours": 4.0,
    "7-8 hours": 7.5,
    "more than 8 hours": 9.5,
    "8-9 hours": 8.5,
    "others": 6.0,
}
# financial-stress words, depression pool
FINANCIAL_STRESS_WORDS = {"high": 8, "moderate": 5, "low": 2, "no": 0}

# external audit: matched after strip + capitalize, anything else 5
EXTERNAL_STRESS_WORDS = {"High": 8.5, "Moderate": 5.0, "Low": 2.5}

# burnout pool: matched after strip + capitalize
STRESS_LEVEL_WORDS = {"Low": 2.5, "Medium": 5.0, "Moderate": 5.0, "High": 7.5, "Severe": 10.0, "Extreme": 10.0}
SLEEP_QUALITY_WORDS = {"Poor": 2.5, "Average": 5.0, "Good": 7.5, "Excellent": 10.0}

# stress pool, per source (exact-case keys)
BURNOUT_FREQUENCY_WORDS = {"Never": 1, "Rarely": 3, "Sometimes": 5, "Frequently": 8, "Always": 10}
REMOTE_STRESS_WORDS = {"High": 8.5, "Medium": 5.0, "Low": 2.5}
REMOTE_BURNOUT_WORDS = {"Low": 2.5, "Medium": 5.0, "High": 8.5}
STUDENT_STRESS_CODES = {0: 2.5, 1: 5.0, 2: 8.5}

# direct binary label text map (after strip); anything else -> 0
BINARY_LABEL_WORDS = {"1": 1, "0": 0, "1.0": 1, "0.0": 0, "Yes": 1, "No": 0, "True": 1, "False": 0}

# gender codes
DEPRESSION_GENDER_WORDS = {"male": 0, "m": 0, "1": 1, "0": 0, "female": 1, "f": 1}
BURNOUT_GENDER_WORDS = {"Male": 0, "Female": 1}

# burnout target rule values (after strip + capitalize)
BURNOUT_LEVEL_POSITIVE = ["High", "Severe"]
BURNOUT_FREQUENCY_POSITIVE = ["Often", "Always", "Frequently"]

# --- fixed values: source lists ---
HOLDOUT_SOURCES = ["Student_Burnout", "DASS42_Psychiatric", "WFH_Corporate"]
MASKED_INTEGRATION_COLUMNS = ["SlackActivity", "MeetingParticipation", "EmailSentiment", "OvertimeHours"]
INTEGRATION_COLUMNS = ["SlackActivity", "MeetingParticipation", "EmailSentiment"]
BURNOUT_COMMON_COLUMNS = [
    "WorkHours", "OvertimeHours", "SleepHours", "ScreenTime", "BreakFrequency",
    "StressLevel", "SleepQuality", "JobSatisfaction", "PhysicalActivity", "ExperienceYears",
    "SlackActivity", "MeetingParticipation", "EmailSentiment", "WorkloadScore", "PerformanceScore",
    "RiskCategory", "DatasetSource", "Age", "Gender",
]
DEPRESSION_NUMERIC_COLUMNS = [
    "SleepHours", "ExerciseFreq", "SocialActivity", "OnlineStress", "GPA",
    "FamilySupport", "ScreenTime", "AcademicStress", "DietQuality", "SelfEfficacy",
    "PeerRelationship", "FinancialStress", "SleepQuality", "MoodToday",
    "EnergyLevel", "MotivationLevel", "FocusLevel", "LonelinessScore",
    "InterestLossScore", "NegativeMoodDays", "SocialIsolationScore",
    "ProductivityDrop", "EmotionalStabilityScore", "SleepTrend",
    "JournalingFrequency", "MeditationFrequency", "AppUsageFrequency",
    "PHQ2", "Age", "RiskCategory", "target_raw",
]
SPARSE_PROTECTED = ["RiskCategory", "DatasetSource", "SleepHours", "GPA", "PHQ2"]
MISSING_FLAG_COLUMNS = ["SleepHours", "GPA", "AcademicStress", "FinancialStress", "PHQ2"]

# DASS-42 item lists (questions numbered 1..42, column "Q{n}A")
DASS_STRESS_ITEMS = ["Q1A", "Q6A", "Q8A", "Q11A", "Q12A", "Q14A", "Q18A", "Q22A", "Q27A", "Q29A", "Q32A", "Q33A", "Q35A", "Q39A"]
DASS_PHQ2_ITEMS = ["Q3A", "Q5A"]
PHQ9_ITEMS = ["phq1", "phq2", "phq3", "phq4", "phq5", "phq6", "phq7", "phq8", "phq9"]

# --- fixed values: model registry (name, threshold, version) ---
MODEL_REGISTRY = {
    "stress": {"file": "stress_model_recovered", "threshold": 0.62, "version": "v3"},
    "deterioration": {"file": "deterioration_model_recovered", "threshold": 0.35, "version": "v2"},
    "anxiety": {"file": "binary_optimized_model", "threshold": 0.54, "version": "hybrid_v5"},
    "depression": {"file": "binary_optimized_model", "threshold": 0.54, "version": "hybrid_v5"},
    "burnout": {"file": "burnout_xgboost", "threshold": 0.71, "version": "lgbm_best"},
}
PIPELINE_VERSION = "phase6.2"
INPUT_COMPLETENESS = 92

# --- fixed values: score bands (score 0-100 -> level) ---
RISK_LEVEL_BANDS = [(85, "SEVERE"), (70, "HIGH"), (50, "MODERATE"), (25, "MILD")]
RISK_LEVEL_FLOOR = "MINIMAL"

# --- fixed values: step buckets (upper bounds are exclusive) ---
MOOD_STEPS = [(4.0, 2.5), (7.5, 5.0)], 8.5
SLEEP_STEPS = [(6.0, 4.0), (8.0, 7.0)], 9.0
WORK_STEPS = [(4.0, 2.0), (8.0, 6.0)], 9.0
STRESS_STEPS = [(5.0, 2.5), (8.0, 6.0)], 9.0

# --- fixed values: crisis keywords and replies ---
CRISIS_KEYWORDS = ["die", "kill", "suicide", "end it", "hurt myself"]
CRISIS_HIT = {"riskLevel": "SEVERE", "category": "SUICIDE",
              "analysis": "Keyword detection triggered during AI outage.",
              "suggestions": ["Please call the 102 Lifeline immediately.",
                              "Reach out to your primary support contact."]}
CRISIS_MISS = {"riskLevel": "MED", "category": "OTHER",
               "analysis": "LLM Analysis failed. System defaulting to MED risk as a safety precaution.",
               "suggestions": ["Take five slow, deep breaths.",
                               "Look around and name five things you can see."]}

# --- fixed values: insight tone by risk level ---
TONE_BY_LEVEL = {
    "MINIMAL": "encouraging and positive",
    "MILD": "supportive and calm",
    "MODERATE": "focused and supportive",
    "HIGH": "serious and grounded",
    "SEVERE": "serious, crisis-focused, and urgent",
}
TONE_DEFAULT = "supportive"

# --- fixed values: rule-based insight text ---
INSIGHT_ACTIONS = [
    "Take a short break to reset your nervous system.",
    "Review your daily routines to identify stressors.",
    "Prioritize consistent, high-quality sleep.",
]
INSIGHT_ACTIONS_ELEVATED = [
    "Consider stepping away from current stressors immediately.",
    "Reach out to a trusted friend or support system.",
    "Prioritize absolute rest and recovery tonight.",
]
INSIGHT_ENCOURAGEMENT = "We are here to support your journey. Take it one step at a time."
INSIGHT_SAFETY_NOTE = "Consider professional support if these feelings persist."
ELEVATED_LEVELS = ["HIGH", "SEVERE"]
# (the original fallback summary also names the app's assistant; the name is left out)
JOURNAL_FALLBACK = {
    "tone": "Reflective",
    "emotionalScore": 5.0,
    "summary": "You've shared your thoughts.",
    "suggestedAction": "Take a deep breath and acknowledge your feelings.",
    "detectedTriggers": [],
}

# --- fixed values: per-source sample weights ---
STRESS_SOURCE_WEIGHTS = {"Healthcare_Workforce": 2.0, "Remote_Work": 1.5, "Corporate_Stress": 1.5,
                         "Student_Stress_Mon": 1.0, "DASS_Clinical": 1.0}
DEPRESSION_SOURCE_WEIGHTS = {"University_Student": 10.0, "Global_2025": 6.0, "Student_Depression": 4.0}
# fixed class weights of the recovered deterioration model
DETERIORATION_CLASS_WEIGHTS = {0: 1.0, 1: 2.0, 2: 4.0, 3: 10.0}
# size of the synthetic sample of the balanced experiment pool (the sampling is the operator's purpose)
POOL_SYNTHETIC_ROWS = 16000

# --- fixed values: sources and per-source weights of the two burnout models ---
INTEGRATED_SOURCES = ["Synthetic_Employee", "Remote_Work"]
INTEGRATED_WEIGHTS = {"Remote_Work": 10.0}
CLINICAL_SOURCES = ["Synthetic_Clinical_Backbone", "Healthcare_Workforce", "WFH_Corporate", "Remote_Work"]
CLINICAL_WEIGHTS = {"Healthcare_Workforce": 15.0, "WFH_Corporate": 5.0, "Remote_Work": 5.0}
