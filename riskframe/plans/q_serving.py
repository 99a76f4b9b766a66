"""Scoring of mixed requests end to end (K8 with K1-K4, K6, K7, L2, L6, H12) and the models it uses."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions.maps import INPUT_COMPLETENESS, MODEL_REGISTRY, PIPELINE_VERSION
from ..operators import features as FE
from ..operators import serving as SV
from ..operators import text as T
from ..operators.timeline import DETERIORATION_FEATURES
from ..session import scratch_path
from . import q_timeline as qt
from .deterioration import build_features
from .q_labels import BURN_REQ, HYB_REQ, STRESS_REQ
from .q_scoring import _label_sql, _level_sql, _score_sql
from .q_survey import POOL, _lit, pool, sql_map
from .registry import REGISTRY, register
from ..sources import fixtures as fx

#: Request type by record number; the last is one that no model serves.
POOL_TYPES = ["stress", "anxiety", "depression", "burnout", "wellbeing"]
#: Training labels of the request models on FB1: cut-offs of the screening items and of the stress scales.
LABELS = {"stress": "WorkStress >= 7.0", "anxiety": "GAD2 >= 3.0", "depression": "PHQ2 >= 3.0",
          "burnout": "StressLevel >= 7.5"}
GENERATED_AT = datetime(2025, 1, 1, 8, 30)
REQUEST_FIELDS = {**HYB_REQ, **BURN_REQ, **STRESS_REQ, "financial_stress": "FinancialStress"}


# ------------------------------------------------------------------ inputs
def survey_requests(spark, sf_dir):
    """FB1 records as requests; every tenth brings a language model's answer, another tenth a broken one."""
    p = pool(spark, sf_dir)
    kind = F.element_at(F.array(*[F.lit(k) for k in POOL_TYPES]), (F.col("rec_id") % len(POOL_TYPES) + 1).cast("int"))
    answer = F.concat(F.lit('{"title": "Plan '), F.col("rec_id").cast("string"), F.lit('", "summary": "SYSTEM_FALLBACK", '
                      '"actions": ["Rest", "Walk"]}'))
    reply = F.when(F.col("rec_id") % 10 == 3, answer).when(F.col("rec_id") % 10 == 6, F.lit('{"title": "cut'))
    return p.select(F.col("rec_id").cast("string").alias("request_id"), kind.alias("predictionType"), reply.alias("reply"),
                    *[F.expr(s).alias(f) for f, s in REQUEST_FIELDS.items()], "rec_id",
                    *[F.expr(f"CAST(coalesce({s}, false) AS INT)").alias(f"_y_{k}") for k, s in LABELS.items()])


def history_requests(spark, sf_dir):
    """A deterioration request per FB2 user with the user's days (one entry a day)."""
    h = qt.serve_history(spark, sf_dir)
    return h.groupBy("user_id").agg(F.collect_list(F.struct("day", "mood", "sleep", "workload")).alias("history")).select(
        F.col("user_id").alias("request_id"), F.lit("deterioration").alias("predictionType"), "history")


def models(spark, sf_dir):
    """The five models, fitted in one aggregation and written once (a row per type)."""
    p = survey_requests(spark, sf_dir)
    inputs = SV.request_inputs(p)
    names = {k: list(c) for k, c in inputs.items()}
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"_y_{k}").alias("y"),
                              F.array(*[c.cast("double") for c in columns.values()]).alias("x")) for k, columns in inputs.items()])
    survey = p.select(F.explode(rows).alias("r")).select("r.*")
    days = build_features(fx.timeline(spark, sf_dir)).where("Split = 'train'").select(
        F.lit("deterioration").alias("kind"), F.col("Target").alias("y"),
        F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in DETERIORATION_FEATURES]).alias("x"))
    names["deterioration"] = DETERIORATION_FEATURES
    fitted = SV.register_models(SV.fit_models(survey.unionByName(days), names))
    path = scratch_path(spark, "models")
    fitted.write.parquet(path)
    return spark.read.schema(fitted.schema).parquet(path)


# ------------------------------------------------------------------ oracle SQL
BURN_NAMES = ["WorkHours", "SleepHours", "ScreenTime", "BreakFrequency", "StressLevel", "ExperienceYears", "JobSatisfaction",
              "AcademicStress", "FinancialStress", "GPA", "SleepQuality", "PhysicalActivity", "Age", "Gender", "OvertimeHours",
              "SlackActivity", "MeetingParticipation", "EmailSentiment", "WorkloadScore", "PerformanceScore",
              "DigitalOverloadIndex", "WorkloadIntensity", "StressLoad", "SleepDebt", "RecoveryScore", "BurnoutRiskIndex",
              "ExperienceYears_missing", "WorkHours_missing", "GPA_missing", "AcademicStress_missing",
              "FinancialStress_missing", "SlackActivity_missing", *FE.BURNOUT_SOURCE_ONE_HOT]
HYB_NAMES = ["PHQ2", "GAD2", "OnlineStress", "GPA", "SleepHours", "FamilySupport", "DietQuality", "LifestyleScore",
             "SupportScore", "MentalResilience", "BurnoutRisk"]
STRESS_NAMES = ["JobSatisfaction", "WorkHours", "SleepHours", "ScreenTime", "Age", "ExperienceYears", "AcademicStress",
                "WorkStressMini", "ExhaustionMini", "StressLoad", "BurnoutRiskCalc", "RecoveryScore", "RecoveryFailureScore",
                "WeeklyStressTrend", "RecentStressSpike", "ConsecutivePoorSleepDays", "HighWorkloadFrequency"]
TABLES_OF = {"stress": ("f_stress", STRESS_NAMES), "anxiety": ("f_hybrid", HYB_NAMES), "depression": ("f_hybrid", HYB_NAMES),
             "burnout": ("f_burnout", BURN_NAMES)}


def _long(kind, key, names, table, more=""):
    return (f"SELECT '{kind}' AS kind, CAST({key} AS VARCHAR) AS rid, {more}unnest([{', '.join(_lit(n) for n in names)}]) AS feature, "
            f"unnest(range(0, {len(names)})) AS pos, unnest([{', '.join(f'coalesce(CAST({n} AS DOUBLE), 0.0)' for n in names)}]) AS v "
            f"FROM {table}")


MODEL_SQL = f"""{POOL}, f_stress AS ({REGISTRY['serve_stress'].sql}), f_hybrid AS ({REGISTRY['serve_hybrid'].sql}),
f_burnout AS ({REGISTRY['serve_burnout'].sql}), f_days AS (SELECT * FROM ({qt.DETERIORATION_SQL}) WHERE Split = 'train'),
served AS ({' UNION ALL '.join(_long(k, 'rec_id', n, t) for k, (t, n) in TABLES_OF.items())}),
lab AS ({' UNION ALL '.join(f"SELECT '{k}' AS kind, CAST(rec_id AS VARCHAR) AS rid, CAST(coalesce({s}, false) AS INTEGER) AS y FROM pool"
                            for k, s in LABELS.items())}),
tr AS (SELECT kind, feature, pos, v, y FROM served JOIN lab USING (kind, rid)
       UNION ALL SELECT kind, feature, pos, v, y FROM ({_long('deterioration', "user_id", DETERIORATION_FEATURES, 'f_days',
                                                              'Target AS y, ')})),
fs AS (SELECT kind, feature, pos, avg(v) AS mean, CASE WHEN stddev_pop(v) < 1e-9 THEN 1.0 ELSE stddev_pop(v) END AS scale, count(*) AS n
       FROM tr GROUP BY kind, feature, pos),
cl AS (SELECT tr.kind, y, tr.feature, (avg(v) - any_value(mean)) / any_value(scale) AS w, count(*) AS nc, any_value(n) AS n
       FROM tr JOIN fs USING (kind, feature) GROUP BY tr.kind, y, tr.feature),
pr AS (SELECT kind, y, ln(CAST(any_value(nc) AS DOUBLE) / any_value(n)) - sum(w * w) / 2.0 AS b FROM cl GROUP BY kind, y)"""

TYPE_SQL = "CASE rec_id % 5 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(POOL_TYPES)) + " END"
THRESHOLD_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v['threshold']}" for k, v in MODEL_REGISTRY.items()) + " END"
VERSION_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v['version']}'" for k, v in MODEL_REGISTRY.items()) + " END"


def _adjusted(item):
    w = f"least(greatest(CASE WHEN gad2 = 0 AND phq2 = 0 THEN least(p * (0.8 + 0.4 * ({item} / 6.0)), 0.20) " \
        f"ELSE p * (0.8 + 0.4 * ({item} / 6.0)) END, 0.0), 0.99)"
    return w


SCORED_SQL = f"""{MODEL_SQL},
f_last AS ({REGISTRY['serve_deterioration'].sql}),
rq AS (SELECT CAST(rec_id AS VARCHAR) AS rid, {TYPE_SQL} AS kind, rec_id, true AS full_history FROM pool
       UNION ALL SELECT user_id, 'deterioration', NULL, n_days >= 7 FROM f_last),
lng AS (SELECT served.* FROM served JOIN rq USING (kind, rid)
        UNION ALL {_long('deterioration', 'user_id', DETERIORATION_FEATURES, 'f_last WHERE n_days >= 7')}),
z AS (SELECT kind, rid, feature, lng.pos, v, (v - mean) / scale AS z FROM lng JOIN fs USING (kind, feature)),
lg AS (SELECT z.kind, rid, cl.y, any_value(b) + sum(z * w) AS l FROM z JOIN cl USING (kind, feature)
       JOIN pr ON pr.kind = z.kind AND pr.y = cl.y GROUP BY z.kind, rid, cl.y),
ex AS (SELECT *, exp(l - max(l) OVER (PARTITION BY kind, rid)) AS e FROM lg),
p0 AS (SELECT kind, rid, sum(CASE WHEN y = 0 THEN e ELSE 0.0 END) / sum(e) AS p0 FROM ex GROUP BY kind, rid),
it AS (SELECT kind, rid, max(CASE WHEN feature = 'GAD2' THEN v END) AS gad2, max(CASE WHEN feature = 'PHQ2' THEN v END) AS phq2
       FROM z GROUP BY kind, rid),
dr AS (SELECT kind, rid, string_agg({_label_sql('feature', 'v')}, '|' ORDER BY rk) AS contributors,
         string_agg({_label_sql('feature', 'v')}, ', ' ORDER BY rk) AS named
       FROM (SELECT *, row_number() OVER (PARTITION BY kind, rid ORDER BY round(abs(z), 6) DESC, pos) AS rk FROM z) WHERE rk <= 3
       GROUP BY kind, rid),
raw AS (SELECT rq.*, 1.0 - p0 AS p, gad2, phq2, contributors, named,
          coalesce(last_mood >= 8.0 AND last_sleep >= 7.0 AND last_workload <= 3.0, false) AS healthy
        FROM rq LEFT JOIN p0 USING (kind, rid) LEFT JOIN it USING (kind, rid) LEFT JOIN dr USING (kind, rid)
        LEFT JOIN f_last ON f_last.user_id = rid),
pb AS (SELECT *, CASE WHEN kind = 'wellbeing' THEN 'Unknown prediction type wellbeing'
                      WHEN NOT full_history THEN 'Min 7 days required.' END AS message,
         CASE kind WHEN 'anxiety' THEN {_adjusted('gad2')} WHEN 'depression' THEN {_adjusted('phq2')}
           WHEN 'deterioration' THEN CASE WHEN healthy THEN p * 0.3 ELSE p END ELSE p END AS probability FROM raw),
sc AS (SELECT *, message IS NULL AS success, {_score_sql('probability', 'kind')} AS s FROM pb),
lv AS (SELECT *, {_level_sql('s')} AS riskLevel, CAST(trunc(s) AS INTEGER) AS score FROM sc)"""

CAP = "upper(substr(kind, 1, 1)) || lower(substr(kind, 2))"
ELEVATED = "riskLevel IN ('HIGH', 'SEVERE')"
GIVEN = "coalesce(rec_id % 10 = 3, false)"


@register("model_table", f"""WITH {MODEL_SQL}
SELECT cl.kind, CAST(pos AS INTEGER) AS position, feature, mean, scale, y AS class, w AS weight FROM cl JOIN fs USING (kind, feature)""")
def q_model_table(spark, sf_dir):
    """The fitted models of all request types as one table."""
    return SV.model_rows(models(spark, sf_dir))


@register("score_requests", f"""WITH {SCORED_SQL}
SELECT rid AS request_id, kind AS predictionType, success, message, CASE WHEN success THEN probability END AS probability,
  CASE WHEN success THEN score END AS score, CASE WHEN success THEN riskLevel END AS riskLevel,
  CASE WHEN success THEN 'High' END AS confidence, CASE WHEN success THEN {INPUT_COMPLETENESS} END AS inputCompleteness,
  CASE WHEN success THEN contributors END AS contributors,
  CASE WHEN NOT success THEN NULL WHEN {GIVEN} THEN 'Plan ' || rid WHEN {ELEVATED} THEN 'Elevated ' || {CAP} || ' Signals Detected'
       ELSE {CAP} || ' Check-in' END AS title,
  CASE WHEN NOT success THEN NULL WHEN {GIVEN} THEN 'SYSTEM_FALLBACK' ELSE 'Your current score of ' || CAST(score AS VARCHAR)
       || ' indicates a ' || lower(riskLevel) || ' level of ' || kind || '.' END AS summary,
  CASE WHEN NOT success THEN NULL WHEN {GIVEN} THEN '' ELSE 'This result is primarily influenced by: ' || named || '.' END AS why,
  CASE WHEN NOT success THEN NULL WHEN {GIVEN} THEN 'Rest|Walk' WHEN {ELEVATED} THEN {_lit('|'.join(T.INSIGHT_ACTIONS_ELEVATED))}
       ELSE {_lit('|'.join(T.INSIGHT_ACTIONS))} END AS actions,
  CASE WHEN NOT success THEN NULL WHEN {GIVEN} THEN '' ELSE {_lit(T.INSIGHT_ENCOURAGEMENT)} END AS encouragement,
  CASE WHEN success AND {ELEVATED} AND NOT {GIVEN} THEN {_lit(T.INSIGHT_SAFETY_NOTE)} END AS safetyNote,
  CASE WHEN success THEN NOT {GIVEN} END AS aiAvailable, CASE WHEN success THEN '2025-01-01T08:30:00Z' END AS generatedAt,
  CASE WHEN success THEN {VERSION_SQL} END AS modelVersion, CASE WHEN success THEN {_lit(PIPELINE_VERSION)} END AS pipelineVersion,
  CASE WHEN success AND kind = 'deterioration' THEN '7 Days' END AS lead_time FROM lv""")
def q_score_requests(spark, sf_dir):
    """K8: requests of every type in one batch, through serving features, models, gate, bands, drivers and texts."""
    p = survey_requests(spark, sf_dir).drop("rec_id", *[f"_y_{k}" for k in LABELS])
    requests = p.unionByName(history_requests(spark, sf_dir), allowMissingColumns=True)
    out = SV.score_requests(requests, models(spark, sf_dir), GENERATED_AT)
    return out.drop(*REQUEST_FIELDS, "reply", "history").withColumns(
        {c: F.array_join(c, "|") for c in ("contributors", "actions")})


@register("score_deterioration", f"""WITH {SCORED_SQL}
SELECT rid AS user_id, success, message, CASE WHEN success THEN probability END AS probability, CASE WHEN success THEN healthy END AS dampened,
  CASE WHEN success THEN score END AS score, CASE WHEN success THEN riskLevel END AS riskLevel,
  CASE WHEN success THEN {sql_map('riskLevel', T.TONE_BY_LEVEL, T.TONE_DEFAULT)} END AS tone,
  CASE WHEN success THEN contributors END AS contributors,
  CASE WHEN success THEN 'This result is primarily influenced by: ' || named || '.' END AS why
FROM lv WHERE kind = 'deterioration'""")
def q_score_deterioration(spark, sf_dir):
    """K3 / K4: every user's history through gate, features, the multi-class model, dampening and the insight text."""
    requests = history_requests(spark, sf_dir)
    out = SV.score_requests(requests, models(spark, sf_dir), GENERATED_AT)
    last = F.try_element_at(F.array_sort("history"), F.lit(-1))
    healthy = F.coalesce((last["mood"] >= 8.0) & (last["sleep"] >= 7.0) & (last["workload"] <= 3.0), F.lit(False))
    return out.select(F.col("request_id").alias("user_id"), "success", "message", "probability",
                      F.when(F.col("success"), healthy).alias("dampened"), "score", "riskLevel",
                      F.when(F.col("success"), T.tone(F.col("riskLevel"))).alias("tone"),
                      F.array_join("contributors", "|").alias("contributors"), "why")


# ------------------------------------------------------------------ H11, L4, L5: typed replies
#: Replies by event number: every field, a long list, wrong types, nulls, absent fields, an array, cut text, trailing text.
PAYLOADS = [
    '{"title": "T#", "summary": "S", "whatHelped": "H", "challenges": "C", "recommendations": ["a", "b", "c", "d #"], "encouragement": "E", '
    '"tone": "calm", "emotionalScore": 7.25, "suggestedAction": "walk", "detectedTriggers": ["work", "x"], "safe": false, "label": "TOXIC", '
    '"action": "FLAG", "reason": "R#"}',
    '{"title": 5, "summary": ["S"], "recommendations": "one", "emotionalScore": "high", "detectedTriggers": {"a": 1}, "safe": "yes", "label": 3}',
    '{"title": null, "recommendations": null, "summary": null, "tone": null, "emotionalScore": null, "safe": null, "reason": null}',
    '{"summary": "only #", "emotionalScore": 4, "safe": true}',
    '["title", "T"]',
    '{"title": "cut',
    '{"title": "T"} trailing',
    '{}',
]
PAYLOAD_SQL = "CASE event_id % 9 " + " ".join(
    f"WHEN {i} THEN replace({_lit(text)}, '#', CAST(event_id AS VARCHAR(20)))" for i, text in enumerate(PAYLOADS)) + " END"
_JSON_KINDS = {"string": "'VARCHAR'", "double": "'DOUBLE', 'UBIGINT', 'BIGINT'", "boolean": "'BOOLEAN'", "array<string>": "'ARRAY'"}


def _reply_sql(form, name, kind, default):
    """A field of a form, lists joined with a bar."""
    def plain(value):
        if value is None:
            return "NULL"
        return _lit("|".join(value) if isinstance(value, list) else value)
    read = {"string": f"payload ->> '$.{name}'", "double": f"CAST(payload ->> '$.{name}' AS DOUBLE)",
            "boolean": f"CAST(payload ->> '$.{name}' AS BOOLEAN)"}
    if kind == "array<string>":
        n = T.REPLY_LIST_HEADS.get(form, {}).get(name, 100)
        read[kind] = f"array_to_string(list_slice(from_json(payload -> '$.{name}', '[\"VARCHAR\"]'), 1, {n}), '|')"
    return (f"CASE WHEN NOT ok THEN {plain(T.REPLY_FALLBACKS[form][name])} WHEN json_type(payload, '$.{name}') = 'NULL' THEN NULL "
            f"WHEN json_type(payload, '$.{name}') IN ({_JSON_KINDS[kind]}) THEN {read[kind]} ELSE {plain(default)} END AS {form}_{name}")


@register("typed_replies", f"""WITH r AS (SELECT event_id, {PAYLOAD_SQL} AS raw FROM events),
v AS (SELECT event_id, coalesce(json_valid(raw), false) AS good, CASE WHEN json_valid(raw) THEN raw ELSE 'null' END AS payload FROM r),
p AS (SELECT *, good AND json_type(payload) = 'OBJECT' AS ok FROM v)
SELECT event_id, ok AS weekly_valid, ok AS journal_valid, ok AS tone_valid,
  {', '.join(_reply_sql(form, *f) for form, fields in T.REPLY_FORMS.items() for f in fields)} FROM p""")
def q_typed_replies(spark, sf_dir):
    """Weekly, journal and tone replies of every kind through VARIANT."""
    df = fx.table(spark, sf_dir, "events").select("event_id", F.expr(PAYLOAD_SQL).alias("raw"))
    for form in T.REPLY_FORMS:
        df = T.typed_reply(df, "raw", form, form)
    lists = [f"{form}_{name}" for form, fields in T.REPLY_FORMS.items() for name, kind, _ in fields if kind == "array<string>"]
    return df.drop("raw").withColumns({c: F.array_join(c, "|") for c in lists})
