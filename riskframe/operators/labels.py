"""Label operators (I1-I11, I20-I23): pure column expressions per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import (capitalize, clip, coerce_numeric, numeric_col, half_even, is_true, isin_false_on_null,
                         map_lookup, norm_key, row_sum)
from ..functions.maps import (BINARY_LABEL_WORDS, BURNOUT_FREQUENCY_POSITIVE, BURNOUT_GENDER_WORDS,
                              BURNOUT_LEVEL_POSITIVE, DASS_PHQ2_ITEMS, DASS_STRESS_ITEMS,
                              DEPRESSION_GENDER_WORDS, PHQ9_ITEMS)
from ..functions.noise import integer_jitter
from .splits import cap_sample

# Standard DASS-42 depression item key (public scoring key): used when the
# caller does not pass the list that the source mapping names.
DASS_DEPRESSION_ITEMS = ["Q3A", "Q5A", "Q10A", "Q13A", "Q16A", "Q17A", "Q21A", "Q24A", "Q26A", "Q31A",
                         "Q34A", "Q37A", "Q38A", "Q42A"]


def label_dass(df: DataFrame, items: Sequence[str] = DASS_DEPRESSION_ITEMS, cut: float = 13) -> DataFrame:
    """Items 1-4 shifted to 0-3 and summed; RiskCategory = sum > 13; PHQ2 proxy."""
    shifted = [F.col(c) - 1 for c in items]
    return df.withColumns({
        "target_raw": row_sum(shifted),
        "RiskCategory": (row_sum(shifted) > cut).cast("int"),
        "PHQ2": clip(row_sum([F.col(c) - 1 for c in DASS_PHQ2_ITEMS]), 0, 6),
    })


def dass_stress(df: DataFrame, items: Sequence[str] = DASS_STRESS_ITEMS) -> DataFrame:
    """DASS stress score (14 items, each minus 1, summed)."""
    return df.withColumn("DASS_Stress", row_sum([F.col(c) - 1 for c in items]))


def label_phq9(df: DataFrame, items: Sequence[str] = PHQ9_ITEMS, cut: float = 10) -> DataFrame:
    """PHQ-9 sum >= 10; PHQ2 = clip(phq1 + phq2, 0, 6)."""
    total = row_sum(items)
    return df.withColumns({
        "target_raw": total,
        "RiskCategory": (total >= cut).cast("int"),
        "PHQ2": clip(row_sum(items[:2]), 0, 6),
    })


def label_binary(df: DataFrame, column: str, out: str = "RiskCategory") -> DataFrame:
    """Text 1/0/Yes/No/True/False -> 0/1 after strip; anything else 0."""
    key = F.trim(F.col(column).cast("string"))
    return df.withColumn(out, map_lookup(BINARY_LABEL_WORDS, key, 0).cast("int"))


def gender_code(df: DataFrame, column: str, variant: str = "depression", out: str = "Gender") -> DataFrame:
    """I4: depression codes (unknown -> 0) or burnout codes (unknown -> 0.5)."""
    if variant == "depression":
        v = map_lookup({k: float(v) for k, v in DEPRESSION_GENDER_WORDS.items()}, norm_key(column), 0.0)
    else:
        v = map_lookup({k: float(v) for k, v in BURNOUT_GENDER_WORDS.items()},
                       capitalize(F.trim(F.col(column).cast("string"))), 0.5)
    return df.withColumn(out, v)


def stress_target(df: DataFrame, out: str = "Target") -> DataFrame:
    """Composite stress target, OR of five rules; a NULL operand makes its rule false."""
    def num(c):
        return numeric_col(df, c) if c in df.columns else F.lit(None).cast("double")
    ws, fe, dass, pss = num("WorkStress"), num("EmotionalExhaustion"), num("DASS_Stress"), num("PSS_10")
    rules = [dass >= 15, pss >= 20, ws >= 7.5, (ws > 7) & (fe > 7)]
    if "WorkHours" in df.columns and "SleepHours" in df.columns:
        rules.append((F.col("WorkHours") > 8) & (F.col("SleepHours") < 5) & (fe > 7))
    cond = is_true(rules[0])
    for r in rules[1:]:
        cond = cond | is_true(r)
    return df.withColumn(out, cond.cast("int"))


BURNOUT_RULES = ("direct_binary", "burnout_level_map", "burnout_score_threshold",
                 "burnout_frequency_map", "burnout_threshold_0.6")


def burnout_target(df: DataFrame, rule: str, column: str = "target_raw", out: str = "RiskCategory") -> DataFrame:
    """Five burnout target rules chosen per source."""
    x = F.col(column)
    num = numeric_col(df, column)
    word = capitalize(F.trim(x.cast("string")))
    if rule == "direct_binary":
        v = num.cast("int")
    elif rule == "burnout_level_map":
        v = isin_false_on_null(word, BURNOUT_LEVEL_POSITIVE).cast("int")
    elif rule == "burnout_score_threshold":
        v = is_true(num >= 60).cast("int")
    elif rule == "burnout_frequency_map":
        v = isin_false_on_null(word, BURNOUT_FREQUENCY_POSITIVE).cast("int")
    elif rule == "burnout_threshold_0.6":
        v = is_true(num >= 0.6).cast("int")
    else:
        raise ValueError(f"unknown burnout rule {rule}")
    return df.withColumn(out, v)


RISK_NAMES = {0: "Safe (Low)", 1: "Needs Attention (Mod/High)"}


def hybrid_label(df: DataFrame, key: str = "rec_id", jitter: bool = False, seed: int = 42) -> DataFrame:
    """PHQ2/GAD2 from totals (half-even), optional +-1 jitter, clinical total and risk label."""
    phq2 = half_even(F.col("PHQ9") * (2 / 9))
    gad2 = half_even(F.col("GAD7") * (2 / 7))
    if jitter:
        phq2 = phq2 + integer_jitter(key, seed, "phq2")
        gad2 = gad2 + integer_jitter(key, seed, "gad2")
    total = F.col("PHQ9") + F.col("GAD7")
    score = total / 48 * 100
    cat = (score > 30).cast("int")
    return df.withColumns({
        "PHQ2": clip(phq2, 0, 6), "GAD2": clip(gad2, 0, 6), "ClinicalTotal": total, "RiskScore": score,
        "RiskCategory": cat,
    }).withColumn("RiskCategoryName", map_lookup(RISK_NAMES, "RiskCategory"))


def timeline_unify(dep: DataFrame | None = None, wfh: DataFrame | None = None,
                   dep_user: str = "user_id", wfh_user: str = "user_id", order_col: str = "row_order") -> DataFrame:
    """Depression and WFH sources into one timeline (user suffix, ordinal, rescale).

    depression: Depression = sum(phq*) / (3 n) * 10; WFH: Workload = work/1.5,
    ScreenTime = screen/1.5.  ``order_col`` is the explicit within-user order.
    """
    from pyspark.sql.window import Window
    parts = []
    if dep is not None:
        phq = [c for c in dep.columns if "phq" in c.lower()]
        w = Window.partitionBy(dep_user).orderBy(order_col)
        parts.append(dep.select(
            F.concat(F.col(dep_user).cast("string"), F.lit("_dep")).alias("user_id"),
            (F.row_number().over(w) - 1).cast("int").alias("timepoint"),
            (row_sum(phq) / (len(phq) * 3) * 10).alias("Depression"),
            F.lit("Depression_14D").alias("Source")))
    if wfh is not None:
        w = Window.partitionBy(wfh_user).orderBy(order_col)
        parts.append(wfh.select(
            F.concat(F.col(wfh_user).cast("string"), F.lit("_wfh")).alias("user_id"),
            (F.row_number().over(w) - 1).cast("int").alias("timepoint"),
            (F.col("work_hours") / 1.5).alias("Workload"),
            (F.col("screen_time_hours") / 1.5).alias("ScreenTime"),
            F.lit("WFH_Burnout").alias("Source")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def normalise_source(df: DataFrame, source: str = "DatasetSource", marker: str = "Synthetic") -> DataFrame:
    """StressLevel -> 1 + 5x for synthetic sources; ScreenTime x12 where the source's max <= 1.

    The per-source max is a grouped aggregate joined back (AQE broadcasts it: one row per source).
    """
    mx = df.groupBy(source).agg(F.max("ScreenTime").alias("_screen_max"))
    out = df.join(mx, on=source, how="left")
    synth = F.col(source).contains(marker)
    return out.withColumns({
        "StressLevel": F.when(synth, 1 + 5 * F.col("StressLevel")).otherwise(F.col("StressLevel")),
        "ScreenTime": F.when(synth & is_true(F.col("_screen_max") <= 1), F.col("ScreenTime") * 12)
        .otherwise(F.col("ScreenTime")),
    }).drop("_screen_max")


def balanced_pool(df: DataFrame, key: str, synthetic_rows: int | None = None, source: str = "DatasetSource",
                  marker: str = "Synthetic") -> DataFrame:
    """Every row of the non-synthetic sources (a NULL source counts as one) and an exact sample of
    ``synthetic_rows`` rows of the synthetic ones; None, the default, takes them all."""
    if synthetic_rows is None:
        return df
    synth = is_true(F.col(source).contains(marker))
    return df.filter(~synth).unionByName(cap_sample(df.filter(synth), key, synthetic_rows))


def holdout_map(df: DataFrame, column_map: dict[str, str], stress_col: str = "StressLevel",
                label_col: str = "burnout_risk", positive: Sequence[str] = ("High", "Medium")) -> DataFrame:
    """Rename, stress/10 clipped to 0-10, label in {High, Medium}."""
    out = df.withColumnsRenamed({k: v for k, v in column_map.items() if k in df.columns})
    return out.withColumns({
        stress_col: clip(F.col(stress_col) / 10, 0, 10),
        "RiskCategory": isin_false_on_null(capitalize(F.trim(F.col(label_col))), list(positive)).cast("int"),
    })
