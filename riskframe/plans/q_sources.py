"""Sources in parts and by config: JSON arrays (A4) and mapping configs (A5)."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions.maps import FINANCIAL_STRESS_WORDS, SLEEP_HOURS_WORDS, STRESS_LEVEL_WORDS
from ..session import scratch_path
from ..sources import files as FS
from ..sources import json_arrays as JA
from ..sources import mapping as MP
from .q_survey import POOL, pool, sql_map
from .registry import register

ARRAY_SCHEMA = "rec_id BIGINT, DatasetSource STRING, WorkHours DOUBLE, StressText STRING, Age DOUBLE, note STRING"


@register("json_array_scan", f"""WITH {POOL}
SELECT rec_id, DatasetSource, WorkHours, StressText, Age, 'a "quoted" {{brace}} [' || CAST(rec_id AS VARCHAR) || '] \\ end' AS note FROM pool""")
def q_json_array_scan(spark, sf_dir):
    """A4: JSON array files read by byte ranges of 64 kB, whatever their texts hold."""
    note = F.concat(F.lit('a "quoted" {brace} ['), F.col("rec_id").cast("string"), F.lit("] \\ end"))
    p = pool(spark, sf_dir).select("rec_id", "DatasetSource", "WorkHours", "StressText", "Age", note.alias("note"))
    path = JA.write_json_arrays(p, scratch_path(spark, "json_array"))
    return JA.read_json_arrays(spark, path, ARRAY_SCHEMA, part_bytes=1 << 16)


# ------------------------------------------------------------------ A5
COMMON = ["SleepHours", "GPA", "FinancialStress", "PHQ2", "WorkHours", "StressLevel"]


def _configs(paths):
    """Two configs over four files: answers and words of two depression sources, scores and words of two burnout sources."""
    depression = {"common_features": ["SleepHours", "GPA", "FinancialStress", "PHQ2"], "sources": [
        {"source_name": "PHQ9_14Day", "path": paths["S1"], "fmt": "csv",
         "column_map": {"sleep": "SleepHours", "gpa": "GPA", "money": "FinancialStress"},
         "words": {"SleepHours": SLEEP_HOURS_WORDS, "FinancialStress": FINANCIAL_STRESS_WORDS},
         "items": {"target_raw": {"sum": [f"item_phq{i}" for i in range(1, 10)]}, "PHQ2": {"sum": ["item_phq1", "item_phq2"], "clip": [0, 6]}},
         "target_rule": "target_raw >= 10"},
        {"source_name": "Student_Depression", "path": paths["S2"], "fmt": "tsv", "column_map": {"cgpa": "GPA", "answer": "target_raw"},
         "scaling": {"GPA": 0.4}, "target_rule": "trim(target_raw) IN ('1', '1.0', 'Yes', 'True')"},
        {"source_name": "Absent_Source", "path": paths["S1"] + "-absent", "fmt": "csv"}]}
    burnout = {"common_features": ["WorkHours", "SleepHours", "StressLevel"], "sources": [
        {"source_name": "Healthcare_Workforce", "path": paths["S3"], "schema": "hours DOUBLE, SleepHours DOUBLE, level STRING, frequency STRING",
         "column_map": {"hours": "WorkHours", "level": "StressLevel"}, "words": {"StressLevel": STRESS_LEVEL_WORDS},
         "target_rule": "initcap(trim(frequency)) IN ('Often', 'Always', 'Frequently')"},
        {"source_name": "Remote_Work", "path": paths["S4"], "fmt": "parquet", "column_map": {"burnout_score": "StressLevel"},
         "target_rule": "StressLevel >= 6"},
        {"source_name": "WFH_Corporate", "path": paths["S4"], "fmt": "parquet"}]}
    return json.dumps(depression), burnout


_PHQ = [f"item_phq{i}" for i in range(1, 10)]
_NUM = "CASE WHEN regexp_full_match(trim({0}), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(trim({0}) AS DOUBLE) END"


def _words_sql(column, table):
    words = sql_map(f"lower(trim({column}))", {k.lower(): float(v) for k, v in table.items()})
    return f"coalesce({words}, {_NUM.format(f'lower(trim({column}))')})"


@register("mapped_sources", f"""WITH {POOL}
SELECT 'PHQ9_14Day' AS DatasetSource, {_words_sql('SleepText', SLEEP_HOURS_WORDS)} AS SleepHours, GPA,
  {_words_sql('FinancialText', FINANCIAL_STRESS_WORDS)} AS FinancialStress,
  least(greatest(CAST(coalesce(item_phq1, 0) + coalesce(item_phq2, 0) AS DOUBLE), 0.0), 6.0) AS PHQ2, CAST(NULL AS DOUBLE) AS WorkHours,
  CAST(NULL AS DOUBLE) AS StressLevel, CAST({' + '.join(f'coalesce({c}, 0)' for c in _PHQ)} >= 10 AS INTEGER) AS RiskCategory
FROM pool WHERE DatasetSource = 'S1'
UNION ALL SELECT 'Student_Depression', NULL, GPA * 0.4, NULL, NULL, NULL, NULL,
  CAST(coalesce(trim(BinaryText) IN ('1', '1.0', 'Yes', 'True'), false) AS INTEGER) FROM pool WHERE DatasetSource = 'S2'
UNION ALL SELECT 'Healthcare_Workforce', SleepHours, NULL, NULL, NULL, WorkHours, {_words_sql('LevelText', STRESS_LEVEL_WORDS)},
  CAST(coalesce(trim(FrequencyText) IN ('Often', 'Always', 'Frequently'), false) AS INTEGER) FROM pool WHERE DatasetSource = 'S3'
UNION ALL SELECT 'Remote_Work', SleepHours, NULL, NULL, NULL, WorkHours, StressLevel,
  CAST(coalesce(StressLevel >= 6, false) AS INTEGER) FROM pool WHERE DatasetSource = 'S4'""")
def q_mapped_sources(spark, sf_dir):
    """A5: two mapping configs unify four files (CSV, TSV, JSON array, Parquet); one is absent, one held out."""
    p = pool(spark, sf_dir)
    of = lambda s, *columns: p.where(F.col("DatasetSource") == s).select(*columns)
    paths = {s: scratch_path(spark, f"mapped-{s}") for s in ("S1", "S2", "S3", "S4")}
    FS.write_table(of("S1", F.col("SleepText").alias("sleep"), F.col("GPA").alias("gpa"), F.col("FinancialText").alias("money"), *_PHQ), paths["S1"], "csv")
    FS.write_table(of("S2", F.col("GPA").alias("cgpa"), F.col("BinaryText").alias("answer")), paths["S2"], "tsv")
    JA.write_json_arrays(of("S3", F.col("WorkHours").alias("hours"), "SleepHours", F.col("LevelText").alias("level"),
                            F.col("FrequencyText").alias("frequency")), paths["S3"])
    FS.write_table(of("S4", "WorkHours", "SleepHours", F.col("StressLevel").alias("burnout_score")), paths["S4"])
    out, _ = MP.unify(spark, list(_configs(paths)))
    return out.select("DatasetSource", *COMMON, "RiskCategory")
