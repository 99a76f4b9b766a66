"""Registered survey-pool queries (FB1, FB2, FB6): sources, schema, joins,
aggregates, set operations, scalar functions.  Each has a DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import (any_not_null, capitalize, clip, coerce_numeric, half_even, map_lookup,
                         row_mean, row_sum, step_bucket, word_or_number)
from ..functions.buckets import map_granular
from ..functions.maps import (BURNOUT_FREQUENCY_WORDS, FINANCIAL_STRESS_WORDS, HOLDOUT_SOURCES,
                              MASKED_INTEGRATION_COLUMNS, MISSING_FLAG_COLUMNS, MOOD_STEPS, REMOTE_STRESS_WORDS,
                              SLEEP_HOURS_WORDS, SLEEP_QUALITY_WORDS, SLEEP_STEPS, STRESS_LEVEL_WORDS, STRESS_STEPS,
                              STUDENT_STRESS_CODES, WORK_STEPS)
from ..operators import aggregates as agg
from ..operators import schema as sch
from ..operators.splits import cap_sample, user_split_table
from ..operators.timeline import deterioration_targets
from ..sources import fixtures as fx
from .q_timeline import CR, SPLIT, TARGETS, TL
from .registry import register

POOL = f"pool AS ({fx.survey_pool_sql()})"
NUM_RE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def sql_num(x: str) -> str:
    """SQL twin of ``coerce_numeric``."""
    return f"(CASE WHEN regexp_full_match(trim({x}), '{NUM_RE}') THEN CAST(trim({x}) AS DOUBLE) END)"


def sql_map(x: str, mapping: dict, default=None) -> str:
    whens = " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in mapping.items())
    return f"(CASE {x} {whens} ELSE {_lit(default) if default is not None else 'NULL'} END)"


def sql_cap(x: str) -> str:
    return f"(upper(substr({x}, 1, 1)) || lower(substr({x}, 2)))"


def _lit(v):
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    return str(v)


def pool(spark, sf_dir):
    return fx.survey_pool(spark, sf_dir)


# Source names used by the burnout / stress pool bindings (S1..S5 -> reference names).
BURNOUT_SOURCE_NAMES = {"S1": "Synthetic_Employee", "S2": "Healthcare_Workforce", "S3": "Remote_Work",
                        "S4": "Student_Burnout", "S5": "WFH_Corporate"}
STRESS_SOURCE_NAMES = {"S1": "Healthcare_Workforce", "S2": "Remote_Work", "S3": "Corporate_Stress",
                       "S4": "Student_Stress_Mon", "S5": "DASS_Clinical"}
STRESS_PRIORITY = {"Healthcare_Workforce": 1, "Remote_Work": 2, "Corporate_Stress": 3, "Student_Stress_Mon": 4,
                   "DASS_Clinical": 5}


# ------------------------------------------------------------------ A: sources
@register("holdout_sources", f"""WITH {POOL}
SELECT rec_id, {sql_map('DatasetSource', BURNOUT_SOURCE_NAMES)} AS DatasetSource FROM pool
WHERE {sql_map('DatasetSource', BURNOUT_SOURCE_NAMES)} NOT IN ({', '.join(_lit(s) for s in HOLDOUT_SOURCES)})""")
def q_holdout_sources(spark, sf_dir):
    """Hold-out sources removed before unification."""
    p = pool(spark, sf_dir).select("rec_id", map_lookup(BURNOUT_SOURCE_NAMES, "DatasetSource").alias("DatasetSource"))
    return p.filter(~F.col("DatasetSource").isin(HOLDOUT_SOURCES))


@register("head_n", f"WITH {POOL} SELECT rec_id, DatasetSource, WorkHours FROM pool ORDER BY rec_id LIMIT 1000")
def q_head_n(spark, sf_dir):
    """First n rows in an explicit order (top-n, the limit is the feature)."""
    return pool(spark, sf_dir).select("rec_id", "DatasetSource", "WorkHours").orderBy("rec_id").limit(1000)


@register("cap_sample", f"""WITH {POOL}
SELECT rec_id, DatasetSource FROM pool ORDER BY md5(CAST(rec_id AS VARCHAR) || '#42'), rec_id LIMIT 1000""")
def q_cap_sample(spark, sf_dir):
    """A4: exact-size deterministic sample (the cap is the operator)."""
    return cap_sample(pool(spark, sf_dir).select("rec_id", "DatasetSource"), "rec_id", 1000)


@register("profile_minmax", f"""WITH {POOL}
SELECT * FROM (
  SELECT 'WorkHours' AS "column", min(WorkHours) AS min, max(WorkHours) AS max, count(WorkHours) AS non_null FROM pool
  UNION ALL SELECT 'SleepHours', min(SleepHours), max(SleepHours), count(SleepHours) FROM pool
  UNION ALL SELECT 'ScreenTime', min(ScreenTime), max(ScreenTime), count(ScreenTime) FROM pool)""")
def q_profile_minmax(spark, sf_dir):
    """Min, max and non-null count of the first numeric columns."""
    return agg.min_max(pool(spark, sf_dir), ["WorkHours", "SleepHours", "ScreenTime"])


# ------------------------------------------------------------------ B: schema
@register("rename_map", f"""WITH {POOL}
SELECT rec_id, WorkHours AS work_hours, SleepHours AS sleep_hours, ScreenTime AS screen_time_hours FROM pool""")
def q_rename_map(spark, sf_dir):
    p = pool(spark, sf_dir).select("rec_id", "WorkHours", "SleepHours", "ScreenTime")
    return sch.rename_map(p, {"WorkHours": "work_hours", "SleepHours": "sleep_hours",
                              "ScreenTime": "screen_time_hours", "NotThere": "x"})


ALIGN_COLS = ["party_id", "name", "nation_id", "balance", "segment"]


@register("align_union", """
SELECT c_custkey AS party_id, c_name AS name, c_nationkey AS nation_id, c_acctbal AS balance,
       c_mktsegment AS segment, 'customer' AS DatasetSource FROM customer
UNION ALL
SELECT s_suppkey, s_name, s_nationkey, s_acctbal, NULL, 'supplier' FROM supplier""")
def q_align_union(spark, sf_dir):
    """B1 + B3 + B4 + G1 on FB6: two sources renamed, tagged, aligned and unioned."""
    return sch.unify_sources(fx.union_inputs(spark, sf_dir), fx.union_specs(), ALIGN_COLS)


@register("coerce_numeric", f"""WITH {POOL}
SELECT rec_id, {sql_num('StressText')} AS StressText, {sql_num('FinancialText')} AS FinancialText,
       {sql_num('QualityText')} AS QualityText FROM pool""")
def q_coerce_numeric(spark, sf_dir):
    """Text columns coerced to numbers, anything else NULL."""
    p = pool(spark, sf_dir).select("rec_id", "StressText", "FinancialText", "QualityText")
    return sch.coerce_columns(p, ["StressText", "FinancialText", "QualityText", "Absent"])


def _wn_sql(x, words, capital=False):
    key = sql_cap(f"trim({x})") if capital else f"lower(trim({x}))"
    m = {(k if capital else k.lower()): float(v) for k, v in words.items()}
    return f"coalesce({sql_map(key, m)}, {sql_num(f'lower(trim({x}))')})"


@register("word_or_number", f"""WITH {POOL}
SELECT rec_id, {_wn_sql('SleepText', SLEEP_HOURS_WORDS)} AS SleepHours,
       {_wn_sql('FinancialText', FINANCIAL_STRESS_WORDS)} AS FinancialStress,
       {_wn_sql('LevelText', STRESS_LEVEL_WORDS, True)} AS StressLevel,
       {_wn_sql('QualityText', SLEEP_QUALITY_WORDS, True)} AS SleepQuality FROM pool""")
def q_word_or_number(spark, sf_dir):
    """Known words mapped, else parsed as a number, else NULL."""
    p = pool(spark, sf_dir)

    def cap_words(c, words):
        return F.coalesce(map_lookup({k: float(v) for k, v in words.items()}, capitalize(F.trim(c))),
                          coerce_numeric(F.lower(F.trim(c))))
    return p.select(
        "rec_id",
        word_or_number("SleepText", SLEEP_HOURS_WORDS).alias("SleepHours"),
        word_or_number("FinancialText", FINANCIAL_STRESS_WORDS).alias("FinancialStress"),
        cap_words(F.col("LevelText"), STRESS_LEVEL_WORDS).alias("StressLevel"),
        cap_words(F.col("QualityText"), SLEEP_QUALITY_WORDS).alias("SleepQuality"),
    )


@register("scale_cols", f"""WITH {POOL}
SELECT rec_id, WorkStress * 10.0 AS WorkStress, EmotionalExhaustion * 0.5 AS EmotionalExhaustion FROM pool""")
def q_scale_cols(spark, sf_dir):
    p = pool(spark, sf_dir).select("rec_id", "WorkStress", "EmotionalExhaustion")
    return sch.scale_cols(p, {"WorkStress": 10, "EmotionalExhaustion": 0.5, "Absent": 3})


def _pool_columns():
    from ..sources.fixtures import DASS_ITEM_COUNT, FB1_NUMERIC, FB1_WORDS, PHQ_ITEM_COUNT
    base = ["rec_id", "cust_id", "DatasetSource", "WorkHours", "SleepHours", "ScreenTime", "WorkStress", "EmotionalExhaustion",
            "RiskCategory", "p", "y"]
    return (base + [n[0] for n in FB1_NUMERIC] + [f"Q{i}A" for i in range(1, DASS_ITEM_COUNT + 1)]
            + [f"item_phq{i}" for i in range(1, PHQ_ITEM_COUNT + 1)] + [w[0] for w in FB1_WORDS])


def _null_fraction_sql(cols):
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", avg(CASE WHEN \"{c}\" IS NULL THEN 1.0 ELSE 0.0 END) AS null_fraction FROM pool"
        for c in cols)
    return f"WITH {POOL} SELECT * FROM ({parts})"


@register("null_fraction", _null_fraction_sql(_pool_columns()))
def q_null_fraction(spark, sf_dir):
    """Null fraction of every pool column, one scan, long form."""
    return sch.null_fractions(pool(spark, sf_dir))


SPARSE_PROTECT = ["RiskCategory", "DatasetSource", "SleepHours", "GPA", "PHQ2"]


@register("sparse_cols", _null_fraction_sql(_pool_columns()).replace("SELECT * FROM (", "SELECT \"column\" FROM (", 1)
          + f""" AS t WHERE null_fraction > 0.7 AND "column" NOT IN ({', '.join(_lit(c) for c in SPARSE_PROTECT)})""")
def q_sparse_cols(spark, sf_dir):
    """Columns dropped as sparse (threshold 0.7 here; 0.8 in the depression pool)."""
    return sch.sparse_names(pool(spark, sf_dir), 0.7, SPARSE_PROTECT)


@register("missing_flags", f"""WITH {POOL}
SELECT rec_id, {', '.join(f'CAST({c} IS NULL AS INT) AS {c}_missing' for c in MISSING_FLAG_COLUMNS)},
       1 AS Absent_missing FROM pool""")
def q_missing_flags(spark, sf_dir):
    p = pool(spark, sf_dir).select("rec_id", *MISSING_FLAG_COLUMNS)
    out = sch.missing_flags(p, MISSING_FLAG_COLUMNS)
    out = sch.missing_flags(out, ["Absent"], absent_value=1)
    return out.select("rec_id", *[f"{c}_missing" for c in MISSING_FLAG_COLUMNS], "Absent_missing")


LEAKS = ["DASS_Stress", "StressLevel", "WorkStress", "EmotionalExhaustion", "priority"]


@register("purge_leaks", f"""WITH {POOL}
SELECT {', '.join(c for c in _pool_columns() if c not in LEAKS)} FROM pool""")
def q_purge_leaks(spark, sf_dir):
    return sch.purge_leaks(pool(spark, sf_dir), LEAKS)


@register("feature_views", f"""WITH {POOL}
SELECT rec_id, PHQ2, GAD2, OnlineStress, RiskCategory AS MentalHealthStatus FROM pool""")
def q_feature_views(spark, sf_dir):
    """Version B (diagnostic totals removed) of the hybrid feature view."""
    p = pool(spark, sf_dir).select("rec_id", "PHQ9", "GAD7", "PHQ2", "GAD2", "OnlineStress",
                                   F.col("RiskCategory").alias("MentalHealthStatus"))
    version_a, version_b = sch.feature_views(p, "MentalHealthStatus")
    assert "PHQ9" in version_a.columns and "PHQ9" not in version_b.columns
    return version_b


@register("row_filter", f"""WITH {POOL}
SELECT rec_id, DatasetSource FROM pool
WHERE DatasetSource IN ('S1', 'S3') AND WorkHours > 6 AND contains(coalesce(StressText, ''), 'o')""")
def q_row_filter(spark, sf_dir):
    """Equality / isin / contains / comparison mask (NULL never passes)."""
    p = pool(spark, sf_dir)
    cond = (F.col("DatasetSource").isin("S1", "S3") & (F.col("WorkHours") > 6)
            & F.coalesce(F.col("StressText").contains("o"), F.lit(False)))
    return sch.filter_rows(p, cond).select("rec_id", "DatasetSource")


@register("default_fill", f"""WITH {POOL}
SELECT rec_id, coalesce(WorkHours, 8.0) AS WorkHours, coalesce(SleepHours, 7.0) AS SleepHours,
       coalesce(ScreenTime, 5.0) AS ScreenTime, 3.0 AS Absent FROM pool""")
def q_default_fill(spark, sf_dir):
    """Per-column default for NULLs; an absent column becomes its default."""
    p = pool(spark, sf_dir).select("rec_id", "WorkHours", "SleepHours", "ScreenTime")
    return sch.default_fill(p, {"WorkHours": 8, "SleepHours": 7, "ScreenTime": 5, "Absent": 3})


@register("masked_copy", f"""WITH {POOL},
s AS (SELECT rec_id, 'Synthetic_Employee' AS DatasetSource, SlackActivity, MeetingParticipation, EmailSentiment,
             OvertimeHours, WorkHours FROM pool WHERE DatasetSource = 'S1')
SELECT * FROM s UNION ALL
SELECT rec_id, 'Synthetic_Clinical_Backbone', NULL, NULL, NULL, NULL, WorkHours FROM s""")
def q_masked_copy(spark, sf_dir):
    """Masked duplicate of the synthetic source for the clinical backbone."""
    s = pool(spark, sf_dir).filter(F.col("DatasetSource") == "S1").select(
        "rec_id", F.lit("Synthetic_Employee").alias("DatasetSource"), *MASKED_INTEGRATION_COLUMNS, "WorkHours")
    return sch.masked_copy(s, MASKED_INTEGRATION_COLUMNS, "Synthetic_Clinical_Backbone")


@register("feature_align", f"""WITH {POOL}
SELECT rec_id, WorkHours, SleepHours, 1.0 AS GPA_missing, 5.0 AS PHQ9, CAST(GPA IS NULL AS INT) AS GPA2_missing
FROM pool""")
def q_feature_align(spark, sf_dir):
    """Model feature list enforced; absent flags -> 1, absent features -> default (5.0 batch)."""
    p = pool(spark, sf_dir).select("rec_id", "WorkHours", "SleepHours", F.col("GPA").isNull().cast("int").alias("GPA2_missing"))
    return sch.feature_align(p, ["WorkHours", "SleepHours", "GPA_missing", "PHQ9", "GPA2_missing"], default=5.0,
                             keep=["rec_id"])


# ------------------------------------------------------------------ C: lookups and group joins
@register("lookup_map", f"""WITH {POOL}
SELECT rec_id,
  coalesce({sql_map('FrequencyText', {k: float(v) for k, v in BURNOUT_FREQUENCY_WORDS.items()})}, 5.0) AS EmotionalExhaustion_hc,
  {sql_map('RemoteStressText', REMOTE_STRESS_WORDS)} AS WorkStress_rw,
  {sql_map('CAST(rec_id % 3 AS INTEGER)', STUDENT_STRESS_CODES)} AS WorkStress_st,
  {sql_map('DatasetSource', STRESS_SOURCE_NAMES)} AS source_name
FROM pool""")
def q_lookup_map(spark, sf_dir):
    """Per-source word->number maps (exact keys), unmatched -> NULL or default."""
    p = pool(spark, sf_dir)
    return p.select(
        "rec_id",
        map_lookup({k: float(v) for k, v in BURNOUT_FREQUENCY_WORDS.items()}, "FrequencyText", 5.0)
        .alias("EmotionalExhaustion_hc"),
        map_lookup(REMOTE_STRESS_WORDS, "RemoteStressText").alias("WorkStress_rw"),
        map_lookup(STUDENT_STRESS_CODES, (F.col("rec_id") % 3).cast("int")).alias("WorkStress_st"),
        map_lookup(STRESS_SOURCE_NAMES, "DatasetSource").alias("source_name"),
    )


MEDIAN_COLS = ["WorkHours", "SleepHours", "ScreenTime", "GPA"]


@register("group_median_fill", f"""WITH {POOL},
g AS (SELECT DatasetSource, {', '.join(f'median({c}) AS m_{c}' for c in MEDIAN_COLS)} FROM pool GROUP BY 1),
a AS (SELECT {', '.join(f'median({c}) AS a_{c}' for c in MEDIAN_COLS)} FROM pool)
SELECT rec_id, {', '.join(f'coalesce({c}, m_{c}, a_{c}) AS {c}' for c in MEDIAN_COLS)}
FROM pool JOIN g USING (DatasetSource), a""")
def q_group_median_fill(spark, sf_dir):
    """C2 + D3: source median fill with a global fallback (S5 has no ScreenTime)."""
    p = pool(spark, sf_dir).select("rec_id", "DatasetSource", *MEDIAN_COLS)
    return agg.group_median_fill(p, MEDIAN_COLS).select("rec_id", *MEDIAN_COLS)


@register("user_split", f"WITH {TL}, {SPLIT} SELECT user_id, Split FROM split")
def q_user_split(spark, sf_dir):
    """User-level 40/60 and 80/20 split; one row per user."""
    return user_split_table(fx.timeline(spark, sf_dir))


# ------------------------------------------------------------------ D: aggregates
GLOBAL_MEDIAN_COLS = ["GPA", "SleepHours", "ScreenTime", "PHQ2"]


@register("global_median_fill", f"""WITH {POOL},
a AS (SELECT {', '.join(f'median({c}) AS a_{c}' for c in GLOBAL_MEDIAN_COLS)} FROM pool)
SELECT rec_id, {', '.join(f'coalesce({c}, a_{c}) AS {c}' for c in GLOBAL_MEDIAN_COLS)} FROM pool, a""")
def q_global_median_fill(spark, sf_dir):
    p = pool(spark, sf_dir).select("rec_id", *GLOBAL_MEDIAN_COLS)
    return agg.global_median_fill(p, GLOBAL_MEDIAN_COLS)


DESCRIBE_COLS = ["WorkHours", "SleepHours", "GPA", "Age"]


@register("describe", f"""WITH {POOL} SELECT * FROM (""" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST(count({c}) AS DOUBLE) AS count, avg({c}) AS mean, stddev_samp({c}) AS std,
       min({c}) AS min, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50,
       quantile_cont({c}, 0.75) AS q75, max({c}) AS max FROM pool""" for c in DESCRIBE_COLS) + ")")
def q_describe(spark, sf_dir):
    """Pandas-style describe with exact interpolated quartiles."""
    return agg.describe(pool(spark, sf_dir), DESCRIBE_COLS)


DUP_COLS = ["DatasetSource", "ExerciseFreq", "GAD2", "BreakFrequency"]


@register("dup_count", f"""WITH {POOL},
g AS (SELECT {', '.join(DUP_COLS)}, count(*) AS n FROM pool GROUP BY ALL)
SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates, CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_rows FROM g""")
def q_dup_count(spark, sf_dir):
    return agg.dup_count(pool(spark, sf_dir).select(*DUP_COLS))


@register("value_share", f"""WITH {POOL},
c AS (SELECT StressText, count(*) AS n FROM pool WHERE StressText IS NOT NULL GROUP BY 1)
SELECT StressText, n, n / sum(n) OVER () AS share, printf('%.1f%%', n / sum(n) OVER () * 100) AS share_pct FROM c""")
def q_value_share(spark, sf_dir):
    """Normalised value counts with a formatted percent."""
    return agg.value_share(pool(spark, sf_dir), "StressText")


COVERAGE_COLS = ["SlackActivity", "MeetingParticipation", "EmailSentiment"]


@register("source_coverage", f"""WITH {POOL}
SELECT DatasetSource, avg(CASE WHEN {' OR '.join(f'{c} IS NOT NULL' for c in COVERAGE_COLS)} THEN 1.0 ELSE 0.0 END) * 100
         AS coverage_pct, count(*) AS rows, avg(CAST(RiskCategory AS DOUBLE)) AS target_rate
FROM pool GROUP BY 1""")
def q_source_coverage(spark, sf_dir):
    """Behavioural-column coverage, size and target rate per source."""
    return agg.source_coverage(pool(spark, sf_dir), COVERAGE_COLS)


@register("quantile_label", f"""WITH {POOL}, c AS (SELECT quantile_cont(WorkStress, 0.85) AS cut FROM pool)
SELECT rec_id, CAST(coalesce(WorkStress >= cut, false) AS INT) AS label FROM pool, c""")
def q_quantile_label(spark, sf_dir):
    """label = at or above the interpolated 0.85 quantile."""
    return agg.quantile_label(pool(spark, sf_dir).select("rec_id", "WorkStress"), "WorkStress", 0.85).select(
        "rec_id", "label")


@register("mode_by_group", f"""WITH {POOL},
c AS (SELECT DatasetSource, ExerciseFreq, count(*) AS n FROM pool WHERE ExerciseFreq IS NOT NULL GROUP BY 1, 2)
SELECT DatasetSource, ExerciseFreq AS ExerciseFreq_mode FROM c
QUALIFY row_number() OVER (PARTITION BY DatasetSource ORDER BY n DESC, ExerciseFreq) = 1""")
def q_mode_by_group(spark, sf_dir):
    """Per-source mode, ties to the smallest value."""
    return agg.mode_by_group(pool(spark, sf_dir), "ExerciseFreq", ["DatasetSource"])


@register("distinct_users", f"""WITH {TL}
SELECT Source, count(DISTINCT user_id) AS distinct_user_id FROM tl GROUP BY 1""")
def q_distinct_users(spark, sf_dir):
    """Distinct users per timeline source."""
    return agg.distinct_count(fx.timeline(spark, sf_dir), "user_id", ["Source"])


ROW_COLS = ["WorkHours", "SleepHours", "ScreenTime"]


@register("rowwise_stats", f"""WITH {POOL}
SELECT rec_id,
  {' + '.join(f'coalesce({c}, 0.0)' for c in ROW_COLS)} AS row_sum,
  ({' + '.join(f'coalesce({c}, 0.0)' for c in ROW_COLS)}) /
     nullif(CAST({' + '.join(f'CAST({c} IS NOT NULL AS INT)' for c in ROW_COLS)} AS DOUBLE), 0) AS row_mean,
  {' OR '.join(f'{c} IS NOT NULL' for c in ROW_COLS)} AS any_present
FROM pool""")
def q_rowwise_stats(spark, sf_dir):
    """Row-wise sum (NaN skipped), mean (all-NaN -> NULL), any-not-null."""
    return pool(spark, sf_dir).select("rec_id", row_sum(ROW_COLS).alias("row_sum"), row_mean(ROW_COLS).alias("row_mean"),
                                      any_not_null(ROW_COLS).alias("any_present"))


@register("pos_weight", f"""WITH {POOL}
SELECT CAST(sum(CASE WHEN RiskCategory = 0 THEN 1 ELSE 0 END) AS BIGINT) AS negatives,
       CAST(sum(CASE WHEN RiskCategory = 1 THEN 1 ELSE 0 END) AS BIGINT) AS positives,
       CAST(sum(CASE WHEN RiskCategory = 0 THEN 1 ELSE 0 END) AS DOUBLE)
         / nullif(sum(CASE WHEN RiskCategory = 1 THEN 1 ELSE 0 END), 0) AS scale_pos_weight FROM pool""")
def q_pos_weight(spark, sf_dir):
    return agg.pos_weight(pool(spark, sf_dir))


@register("class_weights", f"""WITH {TL}, {CR}, {TARGETS},
c AS (SELECT Target, count(*) AS n_c FROM tgt WHERE Target IS NOT NULL GROUP BY 1)
SELECT Target, n_c, CAST(sum(n_c) OVER () AS DOUBLE) / (count(*) OVER () * n_c)
       * CASE WHEN Target = 3 THEN 1.5 ELSE 1.0 END AS class_weight FROM c""")
def q_class_weights(spark, sf_dir):
    """Balanced class weights with the crisis class boosted x1.5."""
    from ..operators.splits import class_weights
    t = deterioration_targets(fx.timeline(spark, sf_dir))
    return class_weights(t, "Target", boost={3: 1.5})


CORR_COLS = ["WorkHours", "SleepHours", "ScreenTime", "WorkStress"]


@register("corr_matrix", f"""WITH {POOL} SELECT * FROM (""" + " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS corr FROM pool"
    for a in CORR_COLS for b in CORR_COLS) + ")")
def q_corr_matrix(spark, sf_dir):
    """Pairwise-complete Pearson matrix, long form."""
    return agg.corr_matrix(pool(spark, sf_dir), CORR_COLS)


# ------------------------------------------------------------------ G: set operations
@register("distinct_rows", f"WITH {POOL} SELECT DISTINCT DatasetSource, ExerciseFreq, GAD2 FROM pool")
def q_distinct_rows(spark, sf_dir):
    return sch.distinct_rows(pool(spark, sf_dir).select("DatasetSource", "ExerciseFreq", "GAD2"))


@register("list_diff", f"""WITH {POOL},
a AS (SELECT ExerciseFreq, GAD2 FROM pool WHERE DatasetSource = 'S1'),
b AS (SELECT ExerciseFreq, GAD2 FROM pool WHERE DatasetSource = 'S2')
SELECT *, 'left_only' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
UNION ALL SELECT *, 'right_only' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def q_list_diff(spark, sf_dir):
    """Symmetric difference (multiset) of two sources' (ExerciseFreq, GAD2) pairs."""
    p = pool(spark, sf_dir)
    a = p.filter(F.col("DatasetSource") == "S1").select("ExerciseFreq", "GAD2")
    b = p.filter(F.col("DatasetSource") == "S2").select("ExerciseFreq", "GAD2")
    return sch.symmetric_difference(a, b)


CONSENSUS_FEATS = ["WorkHours", "SleepHours", "WorkStress", "EmotionalExhaustion", "GPA", "Age", "OnlineStress",
                   "DietQuality"]


@register("consensus", f"""WITH {POOL},
c AS (SELECT * FROM (""" + " UNION ALL ".join(
    f"SELECT DatasetSource AS list_id, '{c}' AS feature, abs(corr({c}, CAST(RiskCategory AS DOUBLE))) AS score "
    f"FROM pool GROUP BY 1" for c in CONSENSUS_FEATS) + """)),
top AS (SELECT list_id, feature FROM c WHERE score IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY list_id ORDER BY score DESC, feature) <= 3)
SELECT feature, count(*) AS n_lists FROM top GROUP BY 1 HAVING count(*) >= 2""")
def q_consensus(spark, sf_dir):
    """Features in the top-3 |corr with label| list of at least two sources."""
    from pyspark.sql.window import Window
    p = pool(spark, sf_dir)
    wide = p.groupBy(F.col("DatasetSource").alias("list_id")).agg(
        *[F.abs(F.corr(c, F.col("RiskCategory").cast("double"))).alias(c) for c in CONSENSUS_FEATS])
    pairs = ", ".join(f"'{c}', `{c}`" for c in CONSENSUS_FEATS)
    long = wide.selectExpr("list_id", f"stack({len(CONSENSUS_FEATS)}, {pairs}) AS (feature, score)")
    w = Window.partitionBy("list_id").orderBy(F.col("score").desc(), F.col("feature"))
    top = long.filter(F.col("score").isNotNull()).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= 3)
    return sch.consensus(top, "feature", "list_id", 2)


@register("priority_dedup", f"""WITH {POOL},
s AS (SELECT rec_id, {sql_map('DatasetSource', STRESS_SOURCE_NAMES)} AS DatasetSource, ExerciseFreq, GAD2,
             BreakFrequency FROM pool)
SELECT rec_id, DatasetSource, ExerciseFreq, GAD2, BreakFrequency FROM s
QUALIFY row_number() OVER (PARTITION BY ExerciseFreq, GAD2, BreakFrequency
                           ORDER BY coalesce({sql_map('DatasetSource', STRESS_PRIORITY)}, 99), rec_id) = 1""")
def q_priority_dedup(spark, sf_dir):
    """Keep the highest-priority source's row per behavioural fingerprint."""
    from ..operators.dedup import priority_dedup
    s = pool(spark, sf_dir).select("rec_id", map_lookup(STRESS_SOURCE_NAMES, "DatasetSource").alias("DatasetSource"),
                                   "ExerciseFreq", "GAD2", "BreakFrequency")
    return priority_dedup(s, ["ExerciseFreq", "GAD2", "BreakFrequency"], STRESS_PRIORITY, tie_break="rec_id")


# ------------------------------------------------------------------ H: scalar functions
@register("clip", f"""WITH {POOL}
SELECT rec_id,
  CASE WHEN WorkStress IS NULL THEN NULL ELSE least(greatest(WorkStress, 2.0), 8.0) END AS stress_clipped,
  CASE WHEN SleepHours IS NULL THEN NULL ELSE greatest(SleepHours - 6.0, 0.0) END AS sleep_over6,
  WorkHours / greatest(1.0, coalesce(SleepHours, 0.0)) AS work_per_sleep,
  abs(WorkStress - 5.0) AS stress_dev,
  least(10.0, WorkHours) AS work_capped
FROM pool""")
def q_clip(spark, sf_dir):
    """H5: clip / abs / max(1, x) denominators with pandas NULL rules."""
    p = pool(spark, sf_dir)
    return p.select(
        "rec_id",
        clip("WorkStress", 2, 8).alias("stress_clipped"),
        clip(F.col("SleepHours") - 6.0, 0, None).alias("sleep_over6"),
        (F.col("WorkHours") / F.greatest(F.lit(1.0), F.coalesce(F.col("SleepHours"), F.lit(0.0)))).alias("work_per_sleep"),
        F.abs(F.col("WorkStress") - 5.0).alias("stress_dev"),
        F.least(F.lit(10.0), F.col("WorkHours")).alias("work_capped"),
    )


def _gran_sql(x, smin=1.0, smax=10.0, tmin=1.0, tmax=10.0):
    return (f"(CASE WHEN {x} IS NULL THEN NULL ELSE least(greatest({tmin} + ({x} - {smin}) / ({smax} - {smin}) * "
            f"({tmax} - {tmin}), {tmin}), {tmax}) END)")


@register("map_granular", f"""WITH {POOL}
SELECT rec_id, {_gran_sql('(11.0 - WorkStress)', tmin=2.5, tmax=8.5)} AS WorkStressMini,
       {_gran_sql('SleepHours', smax=12.0, tmin=4.0, tmax=9.0)} AS SleepMini,
       {_gran_sql('EmotionalExhaustion', tmin=2.0, tmax=9.0)} AS ExhaustionMini FROM pool""")
def q_map_granular(spark, sf_dir):
    """H6: linear slider rescale with clipping."""
    p = pool(spark, sf_dir)
    return p.select("rec_id",
                    map_granular(11.0 - F.col("WorkStress"), target_min=2.5, target_max=8.5).alias("WorkStressMini"),
                    map_granular("SleepHours", scale_max=12.0, target_min=4.0, target_max=9.0).alias("SleepMini"),
                    map_granular("EmotionalExhaustion", target_min=2.0, target_max=9.0).alias("ExhaustionMini"))


def _step_sql(x, steps, fill):
    bounds, top = steps
    v = f"coalesce({x}, {fill})"
    return "(CASE " + " ".join(f"WHEN {v} < {b} THEN {float(val)}" for b, val in bounds) + f" ELSE {float(top)} END)"


@register("step_bucket", f"""WITH {POOL}
SELECT rec_id, {_step_sql('WorkStress', MOOD_STEPS, 5.0)} AS mood_step,
       {_step_sql('SleepHours', SLEEP_STEPS, 7.0)} AS sleep_step,
       {_step_sql('WorkHours', WORK_STEPS, 5.0)} AS work_step,
       {_step_sql('EmotionalExhaustion', STRESS_STEPS, 5.0)} AS stress_step FROM pool""")
def q_step_bucket(spark, sf_dir):
    """H7: three-level step buckets with NULL pre-fill."""
    p = pool(spark, sf_dir)
    return p.select("rec_id", step_bucket("WorkStress", MOOD_STEPS, 5.0).alias("mood_step"),
                    step_bucket("SleepHours", SLEEP_STEPS, 7.0).alias("sleep_step"),
                    step_bucket("WorkHours", WORK_STEPS, 5.0).alias("work_step"),
                    step_bucket("EmotionalExhaustion", STRESS_STEPS, 5.0).alias("stress_step"))


@register("half_even", f"""WITH {POOL}
SELECT rec_id, round_even(WorkStress, 0) AS ws_r0, round_even(SleepHours, 0) AS sleep_r0,
       round_even(PHQ9 * (2.0 / 9.0), 0) AS phq2_est FROM pool""")
def q_half_even(spark, sf_dir):
    """Half-to-even rounding (2.5 -> 2), as numpy."""
    p = pool(spark, sf_dir)
    return p.select("rec_id", half_even("WorkStress").alias("ws_r0"), half_even("SleepHours").alias("sleep_r0"),
                    half_even(F.col("PHQ9") * (2 / 9)).alias("phq2_est"))


@register("minmax10", f"""WITH {POOL},
n AS (SELECT rec_id, {sql_num('StressText')} AS s, WorkHours AS w FROM pool),
m AS (SELECT median(s) AS ms, median(w) AS mw FROM n),
f AS (SELECT rec_id, coalesce(s, ms) AS s, coalesce(w, mw) AS w FROM n, m),
r AS (SELECT min(s) AS lo_s, max(s) AS hi_s, min(w) AS lo_w, max(w) AS hi_w FROM f)
SELECT rec_id, CASE WHEN hi_s > lo_s THEN 10 * (s - lo_s) / (hi_s - lo_s) ELSE 5.0 END AS StressText,
               CASE WHEN hi_w > lo_w THEN 10 * (w - lo_w) / (hi_w - lo_w) ELSE 5.0 END AS WorkHours
FROM f, r""")
def q_minmax10(spark, sf_dir):
    """H9: numeric coerce, median fill, min-max to 0-10."""
    p = pool(spark, sf_dir).select("rec_id", "StressText", "WorkHours")
    return agg.minmax10(p, ["StressText", "WorkHours"])
