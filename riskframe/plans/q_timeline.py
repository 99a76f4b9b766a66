"""Registered timeline queries (FB2) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timeline as tl
from ..sources import fixtures as fx
from .deterioration import build_features, timeline_audit
from .registry import register

# Oracle building blocks (DuckDB SQL over the pre-registered tables).
TL = f"tl AS ({fx.TIMELINE_SQL})"
SPLIT = """
users AS (SELECT user_id, bool_or(Source = 'Depression_14D') AS primed FROM tl GROUP BY user_id),
ranked AS (SELECT user_id, primed,
             row_number() OVER (PARTITION BY primed ORDER BY md5(user_id || '#42'), user_id) AS rk,
             count(*) OVER (PARTITION BY primed) AS n
           FROM users),
split AS (SELECT user_id, CASE WHEN rk <= floor(CAST(n AS DOUBLE) * CASE WHEN primed THEN 0.4::DOUBLE ELSE 0.8::DOUBLE END)
                               THEN 'train' WHEN primed THEN 'test' ELSE 'val' END AS Split
          FROM ranked)"""
CR = """
cr AS (SELECT tl.*, coalesce(
          (coalesce(Depression, 0) + coalesce(Stress, 0) + coalesce(Workload, 0))
          / nullif(CAST((Depression IS NOT NULL)::INT + (Stress IS NOT NULL)::INT + (Workload IS NOT NULL)::INT AS DOUBLE), 0),
          5.0::DOUBLE) AS CompositeRisk,
          CAST(coalesce(
          (coalesce(Depression, 0) + coalesce(Stress, 0) + coalesce(Workload, 0))
          / nullif(CAST((Depression IS NOT NULL)::INT + (Stress IS NOT NULL)::INT + (Workload IS NOT NULL)::INT AS DOUBLE), 0),
          5.0::DOUBLE) >= 8.0 AS INT) AS IsSevere
       FROM tl)"""
TARGETS = """
r AS (SELECT *,
        avg(CompositeRisk) OVER (PARTITION BY user_id ORDER BY timepoint ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS RollingMean_7D,
        avg(CompositeRisk) OVER (PARTITION BY user_id ORDER BY timepoint ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS prev_roll,
        row_number() OVER (PARTITION BY user_id ORDER BY timepoint) AS rn
      FROM cr),
isl AS (SELECT *, rn - row_number() OVER (PARTITION BY user_id, IsSevere ORDER BY timepoint) AS g FROM r),
sev AS (SELECT *, CASE WHEN IsSevere = 1
                 THEN row_number() OVER (PARTITION BY user_id, IsSevere, g ORDER BY timepoint) ELSE 0 END AS ConsecutiveSevere,
          CASE WHEN rn = 1 THEN 0.0
               WHEN prev_roll = 0 THEN CASE WHEN RollingMean_7D > 0 THEN 'inf'::DOUBLE
                                            WHEN RollingMean_7D < 0 THEN '-inf'::DOUBLE ELSE 0.0 END
               ELSE (RollingMean_7D - prev_roll) / prev_roll * 100.0 END AS RiskVelocity
        FROM isl),
cls AS (SELECT *, CASE WHEN RiskVelocity > 30 OR ConsecutiveSevere >= 3 THEN 3 WHEN RiskVelocity > 15 THEN 2
                       WHEN RiskVelocity > 5 THEN 1 ELSE 0 END AS Target_Current FROM sev),
tgt AS (SELECT *, lead(Target_Current, 7) OVER (PARTITION BY user_id ORDER BY timepoint) AS Target FROM cls)"""
FEATS = """
m AS (SELECT *,
        CASE WHEN CompositeRisk < 4.0 THEN 2.5 WHEN CompositeRisk < 7.5 THEN 5.0 ELSE 8.5 END AS mm,
        CASE WHEN coalesce(Sleep, 7.0) < 6.0 THEN 4.0 WHEN coalesce(Sleep, 7.0) < 8.0 THEN 7.0 ELSE 9.0 END AS sm,
        CASE WHEN coalesce(Workload, 5.0) < 4.0 THEN 2.0 WHEN coalesce(Workload, 5.0) < 8.0 THEN 6.0 ELSE 9.0 END AS wm,
        CAST(CompositeRisk > 7.0 AS INT) AS risky,
        least(greatest(CompositeRisk - coalesce(Sleep, 5.0), 0.0), 10.0) AS deficit
      FROM tgt),
m2 AS (SELECT *, rn - row_number() OVER (PARTITION BY user_id, risky ORDER BY timepoint) AS g2,
         coalesce(CompositeRisk - lag(CompositeRisk) OVER w, 0.0) AS vel
       FROM m WINDOW w AS (PARTITION BY user_id ORDER BY timepoint)),
f AS (SELECT m2.user_id, timepoint, Source, Target, CompositeRisk,
        mm AS MoodMini, sm AS SleepMini, wm AS WorkloadMini,
        least(greatest(coalesce(mm - lag(mm, 3) OVER w, 0.0) - coalesce(sm - lag(sm, 3) OVER w, 0.0)
                       + coalesce(wm - lag(wm, 3) OVER w, 0.0), -10.0), 10.0) AS EscalationVelocity_Mini,
        CASE WHEN rn >= 7 THEN lag(coalesce(Sleep, 7.0), 6) OVER w - coalesce(Sleep, 7.0) ELSE 0.0 END AS SleepDecline_7D,
        CASE WHEN risky = 1 THEN row_number() OVER (PARTITION BY m2.user_id, risky, g2 ORDER BY timepoint) ELSE 0 END
          AS ConsecutiveRiskDays,
        coalesce(deficit - lag(deficit) OVER w, 0.0) AS RecoveryDeficitSlope,
        CASE WHEN rn >= 7 THEN stddev_samp(CompositeRisk) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) ELSE 0.0 END
          AS MoodVolatility,
        CASE WHEN rn = 1 THEN 0.0 ELSE coalesce(vel - lag(vel) OVER w, 0.0) END AS BurnoutAcceleration
      FROM m2 WINDOW w AS (PARTITION BY m2.user_id ORDER BY timepoint))"""
FEATURE_COLS = ("MoodMini, SleepMini, WorkloadMini, EscalationVelocity_Mini, SleepDecline_7D, ConsecutiveRiskDays, "
                "RecoveryDeficitSlope, MoodVolatility, BurnoutAcceleration")

DETERIORATION_SQL = f"""
WITH {TL}, {SPLIT}, {CR}, {TARGETS}, {FEATS}
SELECT f.user_id, timepoint, Source, Split, Target, {FEATURE_COLS}
FROM f JOIN split USING (user_id)
WHERE Target IS NOT NULL
"""


def _targets(spark, sf_dir, keep_unlabelled=True):
    return tl.deterioration_targets(fx.timeline(spark, sf_dir), keep_unlabelled=keep_unlabelled)


def _all_features(spark, sf_dir):
    return tl.deterioration_features(_targets(spark, sf_dir))


@register("deterioration_features", DETERIORATION_SQL)
def q_deterioration_features(spark, sf_dir):
    """I19 flagship: user split, lead-7 target, nine features."""
    return build_features(fx.timeline(spark, sf_dir))


@register("timepoint", f"WITH {TL} SELECT * FROM tl")
def q_timepoint(spark, sf_dir):
    """The FB2 timeline with its explicit ordinal."""
    return fx.timeline(spark, sf_dir)


@register("composite_risk", f"WITH {TL}, {CR} SELECT user_id, timepoint, CompositeRisk, IsSevere FROM cr")
def q_composite_risk(spark, sf_dir):
    return tl.composite_risk(fx.timeline(spark, sf_dir)).select("user_id", "timepoint", "CompositeRisk", "IsSevere")


@register("roll_mean7", f"WITH {TL}, {CR}, {TARGETS} SELECT user_id, timepoint, RollingMean_7D FROM tgt")
def q_roll_mean7(spark, sf_dir):
    return _targets(spark, sf_dir).select("user_id", "timepoint", "RollingMean_7D")


@register("risk_velocity", f"WITH {TL}, {CR}, {TARGETS} SELECT user_id, timepoint, RiskVelocity FROM tgt")
def q_risk_velocity(spark, sf_dir):
    return _targets(spark, sf_dir).select("user_id", "timepoint", "RiskVelocity")


@register("run_length", f"WITH {TL}, {CR}, {TARGETS} SELECT user_id, timepoint, IsSevere, ConsecutiveSevere FROM tgt")
def q_run_length(spark, sf_dir):
    return _targets(spark, sf_dir).select("user_id", "timepoint", "IsSevere", "ConsecutiveSevere")


@register("lead7_target", f"""WITH {TL}, {CR}, {TARGETS}
SELECT user_id, timepoint, Target_Current, Target FROM tgt WHERE Target IS NOT NULL""")
def q_lead7_target(spark, sf_dir):
    return _targets(spark, sf_dir, keep_unlabelled=False).select("user_id", "timepoint", "Target_Current", "Target")


@register("deterioration_target", f"""WITH {TL}, {CR}, {TARGETS}
SELECT user_id, timepoint, Source, CompositeRisk, IsSevere, RollingMean_7D, RiskVelocity, ConsecutiveSevere,
       Target_Current, Target FROM tgt WHERE Target IS NOT NULL""")
def q_deterioration_target(spark, sf_dir):
    """Class rules + 7-step lead, rows without a future label dropped."""
    return _targets(spark, sf_dir, keep_unlabelled=False).select(
        "user_id", "timepoint", "Source", "CompositeRisk", "IsSevere", "RollingMean_7D", "RiskVelocity",
        "ConsecutiveSevere", "Target_Current", "Target")


def _feature_key(key, column):
    sql = f"WITH {TL}, {CR}, {TARGETS}, {FEATS} SELECT user_id, timepoint, {column} FROM f"

    @register(key, sql)
    def q(spark, sf_dir):
        return _all_features(spark, sf_dir).select("user_id", "timepoint", column)
    q.__name__ = f"q_{key}"
    return q


_feature_key("escalation_velocity", "EscalationVelocity_Mini")
_feature_key("sleep_decline7", "SleepDecline_7D")
_feature_key("volatility7", "MoodVolatility")
_feature_key("deficit_slope", "RecoveryDeficitSlope")
_feature_key("acceleration", "BurnoutAcceleration")


@register("latest_row", f"""WITH {TL}
SELECT * FROM tl QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY timepoint DESC) = 1""")
def q_latest_row(spark, sf_dir):
    """Last row per user via ``max_by`` (partial aggregation, no sort of all rows)."""
    return tl.latest_row(fx.timeline(spark, sf_dir))


@register("history_gate", f"""WITH {TL}
SELECT user_id, timepoint, count(*) OVER (PARTITION BY user_id) AS history_len,
       CASE WHEN count(*) OVER (PARTITION BY user_id) < 7 THEN 'insufficient_data' ELSE 'ok' END AS status
FROM tl""")
def q_history_gate(spark, sf_dir):
    return tl.history_gate(fx.timeline(spark, sf_dir)).select("user_id", "timepoint", "history_len", "status")


@register("timeline_audit", f"""WITH {TL}, {SPLIT}, {CR}, {TARGETS}, {FEATS},
ft AS (SELECT f.*, Split FROM f JOIN split USING (user_id) WHERE Target IS NOT NULL AND Split = 'test'),
pick AS (SELECT min(user_id) AS user_id FROM ft WHERE Target = 3 AND Source = 'Depression_14D')
SELECT user_id, timepoint, CompositeRisk, Target FROM ft WHERE user_id IN (SELECT user_id FROM pick)""")
def q_timeline_audit(spark, sf_dir):
    feats = build_features(fx.timeline(spark, sf_dir), keep=("CompositeRisk",))
    return timeline_audit(feats)


# Serving history binding: (user, day, mood, sleep, workload) from FB2.
def serve_history(spark, sf_dir):
    t = fx.timeline(spark, sf_dir)
    return t.select("user_id", F.col("timepoint").alias("day"), (10.0 - F.col("Stress")).alias("mood"),
                    F.col("Sleep").alias("sleep"), F.col("Workload").alias("workload"))


SERVE_SQL = f"""WITH {TL},
h AS (SELECT user_id, timepoint AS day, 10.0 - Stress AS mood, Sleep AS sleep, Workload AS workload FROM tl),
g AS (SELECT *,
        CASE WHEN mood IS NOT NULL THEN least(greatest(2.5 + ((11.0 - mood) - 1.0) / 9.0 * 6.0, 2.5), 8.5) END AS mm,
        CASE WHEN sleep IS NOT NULL THEN least(greatest(4.0 + (sleep - 1.0) / 11.0 * 5.0, 4.0), 9.0) END AS sm,
        CASE WHEN workload IS NOT NULL THEN least(greatest(2.0 + (workload - 1.0) / 9.0 * 7.0, 2.0), 9.0) END AS wm,
        CASE WHEN (11.0 - mood) - sleep IS NOT NULL THEN least(greatest((11.0 - mood) - sleep, 0.0), 10.0) END AS deficit,
        CAST(coalesce(mood < 4.0, false) AS INT) AS risky,
        row_number() OVER (PARTITION BY user_id ORDER BY day) AS rn
      FROM h),
g2 AS (SELECT *, rn - row_number() OVER (PARTITION BY user_id, risky ORDER BY day) AS grp,
         coalesce((11.0 - mood) - lag(11.0 - mood) OVER (PARTITION BY user_id ORDER BY day), 0.0) AS vel
       FROM g),
feat AS (SELECT user_id, day, mood, sleep, workload, mm, sm, wm,
        least(greatest(coalesce(mm - lag(mm, 3) OVER w, 0.0) - coalesce(sm - lag(sm, 3) OVER w, 0.0)
                       + coalesce(wm - lag(wm, 3) OVER w, 0.0), -10.0), 10.0) AS esc,
        CASE WHEN count(sleep) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) = 7
             THEN lag(sleep, 6) OVER w - sleep ELSE 0.0 END AS decline,
        CASE WHEN count(mood) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) = 7
             THEN stddev_samp(mood) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) ELSE 0.0 END AS vol,
        coalesce(deficit - lag(deficit) OVER w, 0.0) AS slope,
        CASE WHEN risky = 1 THEN row_number() OVER (PARTITION BY user_id, risky, grp ORDER BY day) ELSE 0 END AS crd,
        CASE WHEN rn = 1 THEN 0.0 ELSE coalesce(vel - lag(vel) OVER w, 0.0) END AS acc,
        count(*) OVER (PARTITION BY user_id) AS n_days,
        row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS from_end
      FROM g2 WINDOW w AS (PARTITION BY user_id ORDER BY day))
SELECT user_id, day AS last_day, n_days, CASE WHEN n_days >= 7 THEN 'ok' ELSE 'insufficient_data' END AS status,
  mood AS last_mood, sleep AS last_sleep, workload AS last_workload,
  mm AS MoodMini, sm AS SleepMini, wm AS WorkloadMini, esc AS EscalationVelocity_Mini, decline AS SleepDecline_7D,
  crd AS ConsecutiveRiskDays, slope AS RecoveryDeficitSlope, vol AS MoodVolatility, acc AS BurnoutAcceleration
FROM feat WHERE from_end = 1"""


@register("serve_deterioration", SERVE_SQL)
def q_serve_deterioration(spark, sf_dir):
    """Serving features over each user's whole history, latest day kept."""
    return tl.serve_deterioration(serve_history(spark, sf_dir))
