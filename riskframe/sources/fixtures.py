"""Fixture bindings FB1-FB7: the driver's tables reshaped into reference inputs.

Each binding is defined once, as a parameter table, and rendered two ways:
as Spark DataFrame expressions (what the library runs) and as SQL text (what
the DuckDB oracle runs).  Both derive every value from whole tables, so the
work grows with the scale factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- FB1 spec
# (column, prime, modulus, divisor, low, null rule); null rule is a tuple of
# ("mod", n) -> null when o_orderkey % n = 0, ("src", [..]) -> null for those
# sources, ("only", [..]) -> null unless one of those sources.
# PHQ-9 items are named item_phq1..9: Spark resolves names case-insensitively,
# so phq9 would clash with the PHQ9 total.
FB1_NUMERIC = [
    ("PHQ9", 17, 28, 1, 0, None),
    ("GAD7", 19, 22, 1, 0, None),
    ("PHQ2", 23, 7, 1, 0, ("mod", 13)),
    ("GAD2", 29, 7, 1, 0, None),
    ("GPA", 31, 41, 10, 0, ("mod", 5)),
    ("Age", 41, 48, 1, 18, None),
    ("AcademicStress", 43, 101, 10, 0, ("src", ["S4"])),
    ("FinancialStress", 47, 101, 10, 0, ("mod", 9)),
    ("OnlineStress", 53, 101, 10, 0, None),
    ("ExerciseFreq", 59, 8, 1, 0, None),
    ("DietQuality", 61, 101, 10, 0, None),
    ("SleepQuality", 67, 101, 10, 0, ("mod", 8)),
    ("FamilySupport", 71, 101, 10, 0, None),
    ("PeerRelationship", 73, 101, 10, 0, None),
    ("SocialActivity", 79, 101, 10, 0, None),
    ("SelfEfficacy", 83, 101, 10, 0, None),
    ("JobSatisfaction", 89, 101, 10, 0, ("src", ["S2"])),
    ("PhysicalActivity", 97, 101, 10, 0, ("mod", 6)),
    ("SlackActivity", 103, 101, 100, 0, ("src", ["S4", "S5"])),
    ("MeetingParticipation", 107, 101, 100, 0, ("src", ["S4", "S5"])),
    ("EmailSentiment", 109, 101, 100, 0, ("src", ["S4", "S5"])),
    ("WorkloadScore", 113, 101, 100, 0, ("src", ["S5"])),
    ("OvertimeHours", 127, 41, 1, 0, ("src", ["S3"])),
    ("PerformanceScore", 131, 51, 10, 0, None),
    ("ExperienceYears", 137, 40, 1, 0, ("mod", 10)),
    ("BreakFrequency", 139, 11, 1, 0, None),
    ("StressLevel", 149, 101, 10, 0, ("mod", 12)),
    ("DASS_Stress", 151, 43, 1, 0, ("only", ["S5"])),
]
DASS_ITEM_COUNT = 42
PHQ_ITEM_COUNT = 9

# Word columns: (column, modulus, values by o_orderkey % modulus; None = NULL).
FB1_WORDS = [
    ("StressText", 6, [" High ", "low", "MODERATE", "7.5", "n/a", None]),
    ("SleepText", 8, ["5-6 hours", "Less than 5 hours ", "7-8 hours", "more than 8 hours", "8-9 HOURS", "Others", "6.5", None]),
    ("FinancialText", 6, ["High", "moderate", " low ", "No", "3.5", None]),
    ("FrequencyText", 7, ["Never", "Rarely", "Sometimes", "Frequently", "Always", "Often", None]),
    ("LevelText", 8, ["Low", "Medium", "Moderate", " high", "Severe", "Extreme", "6.0", "unknown"]),
    ("QualityText", 6, ["Poor", "average", "Good", "Excellent", "7.0", None]),
    ("GenderText", 8, ["Male", "female", "M", "f", "1", "0", "other", None]),
    ("BinaryText", 9, ["1", "0", "1.0", "0.0", "Yes", "No", "True", "False", "maybe"]),
    ("RemoteStressText", 4, ["High", "Medium", "Low", None]),
]


def _null_cond_spark(rule, k, src):
    if rule is None:
        return None
    kind, arg = rule
    if kind == "mod":
        return k % arg == 0
    if kind == "src":
        return src.isin(arg)
    return ~src.isin(arg)


def _null_cond_sql(rule):
    if rule is None:
        return None
    kind, arg = rule
    if kind == "mod":
        return f"o_orderkey % {arg} = 0"
    names = ", ".join(f"'{a}'" for a in arg)
    if kind == "src":
        return f"{_SRC_SQL} IN ({names})"
    return f"{_SRC_SQL} NOT IN ({names})"


_SRC_SQL = "('S' || substr(o_orderpriority, 1, 1))"


def _pool_exprs(string_type: str) -> list[str]:
    """FB1 column expressions, rendered from the spec in one SQL dialect."""
    parts = [
        "o_orderkey AS rec_id",
        "o_custkey AS cust_id",
        f"{_SRC_SQL} AS DatasetSource",
        "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(4.0 AS DOUBLE) + CAST(o_custkey % 9 AS DOUBLE) END AS WorkHours",
        "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(3.0 AS DOUBLE) + CAST(o_orderkey % 13 AS DOUBLE) / 2.0 END"
        " AS SleepHours",
        "CASE WHEN substr(o_orderpriority, 1, 1) = '5' OR o_orderkey % 3 = 0 THEN NULL "
        "ELSE CAST(o_custkey % 70 AS DOUBLE) END AS ScreenTime",
        "CAST((o_orderkey * 37) % 101 AS DOUBLE) / 10.0 AS WorkStress",
        "CAST((o_custkey * 13) % 101 AS DOUBLE) / 10.0 AS EmotionalExhaustion",
        "CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS INTEGER) AS RiskCategory",
        # FB3 score and label on the same rows, for scoring operators
        "CAST((o_orderkey * 7919) % 1000 AS DOUBLE) / 1000.0 AS p",
        "CAST(CASE WHEN (o_orderkey * 7919) % 1000 + o_custkey % 600 > 900 THEN 1 ELSE 0 END AS INTEGER) AS y",
    ]
    for name, prime, m, d, lo, rule in FB1_NUMERIC:
        value = f"(CAST({float(lo)} AS DOUBLE) + CAST((o_orderkey * {prime}) % {m} AS DOUBLE) / {float(d)})"
        cond = _null_cond_sql(rule)
        parts.append(f"{value if cond is None else f'CASE WHEN {cond} THEN NULL ELSE {value} END'} AS {name}")
    for n in range(1, DASS_ITEM_COUNT + 1):
        parts.append(f"CAST(1 + (o_orderkey * {2 * n + 1}) % 4 AS INTEGER) AS Q{n}A")
    for n in range(1, PHQ_ITEM_COUNT + 1):
        v = f"CAST((o_orderkey * {2 * n + 3}) % 4 AS INTEGER)"
        parts.append(f"{f'CASE WHEN o_orderkey % 14 = 0 THEN NULL ELSE {v} END' if n == 9 else v} AS item_phq{n}")
    for name, m, values in FB1_WORDS:
        whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None)
        parts.append(f"CAST(CASE o_orderkey % {m} {whens} ELSE NULL END AS {string_type}) AS {name}")
    return parts


def survey_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FB1: one survey record per order, five sources S1..S5 (one projection of ``orders``)."""
    return table(spark, sf_dir, "orders").selectExpr(*_pool_exprs("STRING"))


def survey_pool_sql() -> str:
    return "SELECT " + ",\n  ".join(_pool_exprs("VARCHAR")) + "\nFROM orders"


# ---------------------------------------------------------------- FB2
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FB2: per-user daily timeline derived from ``events``.

    Grouping on the derived string user key (with the source, a function of
    it) makes the later per-user windows reuse this exchange.
    """
    ev = table(spark, sf_dir, "events")
    uid = F.concat(F.col("user_id").cast("string"), F.lit("_ev"))
    src = F.when(F.col("user_id") % 3 == 0, "Depression_14D").otherwise("WFH_Burnout")
    a = ev.groupBy(uid.alias("user_id"), src.alias("Source"), F.date_trunc("day", "ts").alias("day")).agg(
        F.avg("value").alias("av"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("e"),
    )
    from ..operators.timeline import ordinal  # E1 over the explicit day order
    n = F.col("n").cast("double")
    return ordinal(a, "user_id", "day").select(
        "user_id",
        "timepoint",
        F.least(F.lit(10.0), F.round("av", 4) / 12.0).alias("Stress"),
        F.when(F.col("n") % 5 == 0, None).otherwise(F.least(F.lit(10.0), 3.0 + n * 1.5)).alias("Sleep"),
        F.when((F.col("n") == 1) & (F.col("e") == 0), None)
        .otherwise(F.least(F.lit(10.0), 10.0 * F.col("e").cast("double") / n)).alias("Workload"),
        F.lit(None).cast("double").alias("Depression"),
        "Source",
    )


TIMELINE_SQL = """
SELECT CAST(user_id AS VARCHAR) || '_ev' AS user_id,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) - 1 AS INTEGER) AS timepoint,
  least(10.0::DOUBLE, round(av, 4) / 12.0) AS Stress,
  CASE WHEN n % 5 = 0 THEN NULL ELSE least(10.0::DOUBLE, 3.0 + CAST(n AS DOUBLE) * 1.5) END AS Sleep,
  CASE WHEN n = 1 AND e = 0 THEN NULL ELSE least(10.0::DOUBLE, 10.0 * CAST(e AS DOUBLE) / CAST(n AS DOUBLE)) END AS Workload,
  CAST(NULL AS DOUBLE) AS Depression,
  CASE WHEN user_id % 3 = 0 THEN 'Depression_14D' ELSE 'WFH_Burnout' END AS Source
FROM (SELECT user_id, date_trunc('day', ts) AS day, avg(value) AS av, count(*) AS n,
             sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS e
      FROM events GROUP BY 1, 2) a
"""


# ---------------------------------------------------------------- FB3
def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FB3: (rec_id, DatasetSource, p, y) with 1,000 distinct scores and many ties."""
    o = table(spark, sf_dir, "orders")
    h = (F.col("o_orderkey") * 7919) % 1000
    return o.select(
        F.col("o_orderkey").alias("rec_id"),
        F.concat(F.lit("S"), F.substring("o_orderpriority", 1, 1)).alias("DatasetSource"),
        (h.cast("double") / 1000.0).alias("p"),
        F.when(h + F.col("o_custkey") % 600 > 900, 1).otherwise(0).alias("y"),
    )


SCORED_SQL = f"""
SELECT o_orderkey AS rec_id, {_SRC_SQL} AS DatasetSource,
  CAST((o_orderkey * 7919) % 1000 AS DOUBLE) / 1000.0 AS p,
  CAST(CASE WHEN (o_orderkey * 7919) % 1000 + o_custkey % 600 > 900 THEN 1 ELSE 0 END AS INTEGER) AS y
FROM orders
"""


# ---------------------------------------------------------------- FB5
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FB5: JSON text per event; every 10th row corrupted by a trailing brace."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "event_id",
        F.when(F.col("event_id") % 10 == 0, F.concat("props", F.lit("}"))).otherwise(F.col("props")).alias("payload"),
    )


JSON_SQL = """
SELECT event_id, CASE WHEN event_id % 10 = 0 THEN props || '}' ELSE props END AS payload FROM events
"""


# ---------------------------------------------------------------- FB6
def union_inputs(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """FB6: customer and supplier, each with its own column names."""
    return [table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")]


def union_specs() -> list[dict]:
    return [
        {"source_name": "customer",
         "column_map": {"c_custkey": "party_id", "c_name": "name", "c_nationkey": "nation_id",
                        "c_acctbal": "balance", "c_mktsegment": "segment"}},
        {"source_name": "supplier",
         "column_map": {"s_suppkey": "party_id", "s_name": "name", "s_nationkey": "nation_id",
                        "s_acctbal": "balance"}},
    ]


# ---------------------------------------------------------------- FB7
def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FB7: embedding vectors with a rare class (label 0 against the rest)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "embedding", F.when(F.col("label") == 0, 1).otherwise(0).alias("y"))
