"""Per-user timeline operators.

All rules share one window specification, ``partitionBy(user).orderBy(time)``,
so the whole chain costs a single exchange on the user key: rolling means,
lags, leads, island counters and gates are evaluated by one ``Window`` operator
over the same sort.  Run-length counters ("islands") are computed without a
second partitioning: for a 0/1 flag the run length at row ``r`` is
``r - (last row <= r where flag = 0)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import clip, pct_change, row_mean, step_bucket
from ..functions.buckets import map_granular
from ..functions.maps import MOOD_STEPS, SLEEP_STEPS, WORK_STEPS
from ..functions.noise import gaussian

INF = float("inf")


def user_window(user: str = "user_id", order: str = "timepoint") -> Window:
    return Window.partitionBy(user).orderBy(order)


def trailing(w: Window, n: int) -> Window:
    return w.rowsBetween(-(n - 1), 0)


def ordinal(df: DataFrame, user: str = "user_id", order_col: str = "event_order", name: str = "timepoint") -> DataFrame:
    """0-based position within user, over an explicit order column."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(user).orderBy(order_col)) - 1).cast("int"))


def run_length(flag: Column, w: Window) -> Column:
    """Consecutive-ones counter for a 0/1 flag (pandas island cumsum)."""
    rn = F.row_number().over(w)
    last_zero = F.max(F.when(flag == 0, rn)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.when(flag == 1, rn - F.coalesce(last_zero, F.lit(0))).otherwise(F.lit(0)).cast("int")


def lag_diff(c: Column, w: Window, n: int = 1) -> Column:
    """``x.diff(n).fillna(0)``."""
    return F.coalesce(c - F.lag(c, n).over(w), F.lit(0.0))


def composite_risk(df: DataFrame, cols=("Depression", "Stress", "Workload"), default: float = 5.0,
                   severe_at: float = 8.0) -> DataFrame:
    """Mean of the non-null indicators (default when none), severe flag."""
    present = [c for c in cols if c in df.columns]
    cr = F.coalesce(row_mean(present), F.lit(float(default))) if present else F.lit(float(default))
    return df.withColumn("CompositeRisk", cr).withColumn("IsSevere", (F.col("CompositeRisk") >= severe_at).cast("int"))


def deterioration_targets(df: DataFrame, user: str = "user_id", order: str = "timepoint",
                          lead: int = 7, keep_unlabelled: bool = False) -> DataFrame:
    """I17 + E2/E3/E4 + I18 + E5: composite risk, velocity, severe runs, class, 7-step lead.

    Output keeps every input column plus CompositeRisk, IsSevere,
    RollingMean_7D, RiskVelocity, ConsecutiveSevere, Target_Current, Target.
    Rows with no row ``lead`` steps ahead are dropped (pandas ``dropna``).
    """
    w = user_window(user, order)
    base = composite_risk(df)
    roll = F.avg("CompositeRisk").over(trailing(w, 7))
    # lag of a rolling mean: the 7 rows ending one step earlier
    prev_roll = F.avg("CompositeRisk").over(w.rowsBetween(-7, -1))
    step = F.row_number().over(w)
    vel = F.when(step == 1, F.lit(0.0)).otherwise(F.coalesce(pct_change(roll, prev_roll), F.lit(0.0)) * 100.0)
    out = base.select(
        "*",
        roll.alias("RollingMean_7D"),
        vel.alias("RiskVelocity"),
        run_length(F.col("IsSevere"), w).alias("ConsecutiveSevere"),
    )
    cls = (
        F.when((F.col("RiskVelocity") > 30) | (F.col("ConsecutiveSevere") >= 3), 3)
        .when(F.col("RiskVelocity") > 15, 2)
        .when(F.col("RiskVelocity") > 5, 1)
        .otherwise(0)
    )
    out = out.withColumn("Target_Current", cls.cast("int"))
    out = out.withColumn("Target", F.lead("Target_Current", lead).over(w))
    return out if keep_unlabelled else out.filter(F.col("Target").isNotNull())


DETERIORATION_FEATURES = [
    "MoodMini", "SleepMini", "WorkloadMini", "EscalationVelocity_Mini",
    "SleepDecline_7D", "ConsecutiveRiskDays", "RecoveryDeficitSlope", "MoodVolatility", "BurnoutAcceleration",
]


def deterioration_features(df: DataFrame, user: str = "user_id", order: str = "timepoint",
                           noise_std: float = 0.0, seed: int = 42) -> DataFrame:
    """I19 (training rules): the nine timeline features, one window pass.

    Input needs CompositeRisk, Sleep, Workload (from :func:`deterioration_targets`).
    All windows are trailing, so computing them before or after the lead-7
    row drop gives the same values for the rows that remain.
    """
    w = user_window(user, order)
    key = F.concat_ws("#", F.col(user).cast("string"), F.col(order).cast("string"))

    def noisy(c: Column, tag: str) -> Column:
        return c + gaussian(key, seed, tag, noise_std) if noise_std else c

    cr = F.col("CompositeRisk")
    slp = F.coalesce(F.col("Sleep"), F.lit(7.0))
    minis = df.select(
        "*",
        noisy(step_bucket(cr, MOOD_STEPS, fill=5.0), "mood").alias("_mood"),
        noisy(step_bucket("Sleep", SLEEP_STEPS, fill=7.0), "sleep").alias("_sleep"),
        noisy(step_bucket("Workload", WORK_STEPS, fill=5.0), "work").alias("_work"),
    )
    rn = F.row_number().over(w)
    m, s, k = F.col("_mood"), F.col("_sleep"), F.col("_work")
    esc = lag_diff(m, w, 3) - lag_diff(s, w, 3) + lag_diff(k, w, 3)
    deficit = clip(cr - F.coalesce(F.col("Sleep"), F.lit(5.0)), 0, 10)
    prev_deficit = clip(F.lag(cr, 1).over(w) - F.coalesce(F.lag("Sleep", 1).over(w), F.lit(5.0)), 0, 10)
    vel = F.coalesce(cr - F.lag(cr, 1).over(w), F.lit(0.0))
    prev_vel = F.coalesce(F.lag(cr, 1).over(w) - F.lag(cr, 2).over(w), F.lit(0.0))
    feats = minis.select(
        "*",
        clip(m, -10, 10).alias("MoodMini"),
        clip(s, -10, 10).alias("SleepMini"),
        clip(k, -10, 10).alias("WorkloadMini"),
        clip(esc, -10, 10).alias("EscalationVelocity_Mini"),
        F.when(rn >= 7, F.lag(slp, 6).over(w) - slp).otherwise(F.lit(0.0)).alias("SleepDecline_7D"),
        run_length((cr > 7.0).cast("int"), w).alias("ConsecutiveRiskDays"),
        F.coalesce(deficit - prev_deficit, F.lit(0.0)).alias("RecoveryDeficitSlope"),
        F.when(rn >= 7, F.stddev_samp(cr).over(trailing(w, 7))).otherwise(F.lit(0.0)).alias("MoodVolatility"),
        F.when(rn == 1, F.lit(0.0)).otherwise(vel - prev_vel).alias("BurnoutAcceleration"),
    )
    return feats.drop("_mood", "_sleep", "_work")


def serve_deterioration(history: DataFrame, user: str = "user_id", day: str = "day",
                        min_days: int = 7) -> DataFrame:
    """I27 + E11 + E12 (K3): serving-time timeline features, latest row per user.

    ``history`` has (user, day, mood, sleep, workload).  Users with fewer than
    ``min_days`` rows get ``status = 'insufficient_data'`` and null features.
    History is ordered by ``day`` (not arrival order).
    """
    w = Window.partitionBy(user).orderBy(day)
    wdesc = Window.partitionBy(user).orderBy(F.col(day).desc())
    mood, sleep, work = F.col("mood").cast("double"), F.col("sleep").cast("double"), F.col("workload").cast("double")
    staged = history.select(
        "*",
        map_granular(11.0 - mood, target_min=2.5, target_max=8.5).alias("MoodMini"),
        map_granular(sleep, scale_max=12.0, target_min=4.0, target_max=9.0).alias("SleepMini"),
        map_granular(work, target_min=2.0, target_max=9.0).alias("WorkloadMini"),
    )
    rn = F.row_number().over(w)
    m, s, k = F.col("MoodMini"), F.col("SleepMini"), F.col("WorkloadMini")
    deficit = clip((11.0 - mood) - sleep, 0, 10)
    prev_mood, prev_sleep = F.lag(mood, 1).over(w), F.lag(sleep, 1).over(w)
    prev_deficit = clip((11.0 - prev_mood) - prev_sleep, 0, 10)
    vel = F.coalesce((11.0 - mood) - (11.0 - prev_mood), F.lit(0.0))
    prev_vel = F.coalesce((11.0 - prev_mood) - (11.0 - F.lag(mood, 2).over(w)), F.lit(0.0))
    feats = staged.select(
        "*",
        clip(lag_diff(m, w, 3) - lag_diff(s, w, 3) + lag_diff(k, w, 3), -10, 10).alias("EscalationVelocity_Mini"),
        F.when(F.count(sleep).over(trailing(w, 7)) == 7, F.lag(sleep, 6).over(w) - sleep)
        .otherwise(F.lit(0.0)).alias("SleepDecline_7D"),
        F.when(F.count(mood).over(trailing(w, 7)) == 7, F.stddev_samp(mood).over(trailing(w, 7)))
        .otherwise(F.lit(0.0)).alias("MoodVolatility"),
        F.coalesce(deficit - prev_deficit, F.lit(0.0)).alias("RecoveryDeficitSlope"),
        run_length(F.coalesce(mood < 4.0, F.lit(False)).cast("int"), w).alias("ConsecutiveRiskDays"),
        F.when(rn == 1, F.lit(0.0)).otherwise(vel - prev_vel).alias("BurnoutAcceleration"),
        F.count(F.lit(1)).over(Window.partitionBy(user)).alias("n_days"),
        F.row_number().over(wdesc).alias("_from_end"),
    )
    latest = feats.filter(F.col("_from_end") == 1).drop("_from_end")
    ok = F.col("n_days") >= min_days
    out = latest.select(
        F.col(user), F.col(day).alias("last_day"), "n_days",
        F.when(ok, F.lit("ok")).otherwise(F.lit("insufficient_data")).alias("status"),
        F.col("mood").alias("last_mood"), F.col("sleep").alias("last_sleep"), F.col("workload").alias("last_workload"),
        *[F.when(ok, F.col(c)).alias(c) for c in DETERIORATION_FEATURES],
    )
    return out


def history_inputs(history: Column, min_days: int = 7) -> dict[str, Column]:
    """I27 / K3 for a request that carries its own history: the last day's features of :func:`serve_deterioration`
    out of an array of (day, mood, sleep, workload), in any order, with array expressions alone (no shuffle).
    NULL below ``min_days`` days."""
    days = F.array_sort(history)
    short = F.coalesce(F.size(days), F.lit(0)) < min_days

    def back(field: str, i: int) -> Column:
        return F.try_element_at(days, F.lit(-1 - i))[field].cast("double")

    def change(now: Column, then: Column) -> Column:
        return F.coalesce(now - then, F.lit(0.0))

    scale = {"mood": lambda x: map_granular(11.0 - x, target_min=2.5, target_max=8.5),
             "sleep": lambda x: map_granular(x, scale_max=12.0, target_min=4.0, target_max=9.0),
             "workload": lambda x: map_granular(x, target_min=2.0, target_max=9.0)}
    rise = {f: change(mini(back(f, 0)), mini(back(f, 3))) for f, mini in scale.items()}
    week = F.slice(days, F.greatest(F.coalesce(F.size(days), F.lit(0)) - 6, F.lit(1)), 7)
    full = {"mood": F.size(F.filter(week, lambda d: d["mood"].isNotNull())) == 7,
            "sleep": F.size(F.filter(week, lambda d: d["sleep"].isNotNull())) == 7}
    total = F.aggregate(week, F.lit(0.0), lambda a, d: a + d["mood"])
    spread = F.aggregate(week, F.lit(0.0), lambda a, d: a + (d["mood"] - total / 7.0) * (d["mood"] - total / 7.0))
    deficit = [clip((11.0 - back("mood", i)) - back("sleep", i), 0, 10) for i in (0, 1)]
    speed = [change(back("mood", i + 1), back("mood", i)) for i in (0, 1)]
    risky = F.aggregate(days, F.lit(0), lambda a, d: F.when(F.coalesce(d["mood"] < 4.0, F.lit(False)), a + 1).otherwise(0))
    found = {
        **{f"{f.capitalize()}Mini": mini(back(f, 0)) for f, mini in scale.items()},
        "EscalationVelocity_Mini": clip(rise["mood"] - rise["sleep"] + rise["workload"], -10, 10),
        "SleepDecline_7D": F.when(full["sleep"], back("sleep", 6) - back("sleep", 0)).otherwise(F.lit(0.0)),
        "ConsecutiveRiskDays": risky.cast("double"),
        "RecoveryDeficitSlope": change(deficit[0], deficit[1]),
        "MoodVolatility": F.when(full["mood"], F.sqrt(spread / 6.0)).otherwise(F.lit(0.0)),
        "BurnoutAcceleration": speed[0] - speed[1],
    }
    return {c: F.when(~short, found[c]) for c in DETERIORATION_FEATURES}


def latest_row(df: DataFrame, user: str = "user_id", order: str = "timepoint") -> DataFrame:
    """The last row per user (``max_by`` over a struct, one partial aggregation)."""
    others = [c for c in df.columns if c != user]
    agg = df.groupBy(user).agg(F.max_by(F.struct(*others), F.col(order)).alias("_last"))
    return agg.select(user, "_last.*")


def history_gate(df: DataFrame, user: str = "user_id", min_rows: int = 7) -> DataFrame:
    """Per-row history length and status."""
    n = F.count(F.lit(1)).over(Window.partitionBy(user))
    return df.withColumn("history_len", n).withColumn(
        "status", F.when(F.col("history_len") < min_rows, "insufficient_data").otherwise("ok"))
