"""Registered rows-only queries: file sources / sinks (A1-A3, A9, A11), SMOTE (J10),
model training, selection, calibration and search (J12-J24), experiment harnesses
(J37-J40) and plain model scoring (K2).

These have no DuckDB twin (model fits, file round trips); the driver checks
them by rows.  Every one reads the fixture tables, so its work grows with them.
Files go under the shared ``spark.checkpoint.dir`` (never a machine-local folder).
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from ..functions import map_lookup
from ..functions.maps import (CLINICAL_SOURCES, CLINICAL_WEIGHTS, DETERIORATION_CLASS_WEIGHTS, INTEGRATED_SOURCES,
                              INTEGRATED_WEIGHTS, POOL_SYNTHETIC_ROWS, STRESS_SOURCE_WEIGHTS)
from ..operators import experiments as X
from ..operators import features as FE
from ..operators import labels as L
from ..operators import pipelines as PL
from ..operators import train as TR
from ..operators.boosting import SoftmaxBoost
from ..operators.sampling import smote
from ..operators.splits import source_weight, stratified_split
from ..session import scratch_path
from ..sources import files as FS
from ..sources import fixtures as fx
from .deterioration import build_features
from .q_labels import ANX_COLS, BURN_COLS, BURN_FLAGS, STRESS_IN, STRESS_OUT
from .q_survey import BURNOUT_SOURCE_NAMES, POOL, STRESS_SOURCE_NAMES, pool
from .q_timeline import DETERIORATION_SQL
from .registry import register

GBT_SMALL = {"maxIter": 20, "maxDepth": 4}
FOREST_SMALL = {"numTrees": 30, "maxDepth": 6}


# ------------------------------------------------------------------ model inputs
def stress_table(spark, sf_dir, more=()):
    """FB1 -> I6 composite target on the raw columns -> I16 features (leak columns purged), with ``more`` of them."""
    p = pool(spark, sf_dir).select("rec_id", map_lookup(STRESS_SOURCE_NAMES, "DatasetSource").alias("DatasetSource"),
                                   *STRESS_IN, "WorkStress")
    p = L.stress_target(p).withColumn("WorkStress", F.col("WorkStress") * 1.2)
    return FE.feat_stress(p).select("rec_id", "DatasetSource", "Target", *STRESS_OUT, *more)


def vector_table(spark, sf_dir):
    """FB7 embeddings as one double column per dimension plus the rare-class label."""
    v = fx.vectors(spark, sf_dir)
    dim = v.agg(F.max(F.size("embedding"))).first()[0] or 0
    return v.select("vec_id", "y", *[F.col("embedding")[i].cast("double").alias(f"emb_{i}") for i in range(dim)])


def _emb(df):
    return [c for c in df.columns if c.startswith("emb_")]


def _split(df, key, label, strata=()):
    s = X.split_cached(df, key, label, strata)
    return s.filter(~F.col("is_test")), s.filter(F.col("is_test"))


# ------------------------------------------------------------------ A: files
def _pool_extract(spark, sf_dir):
    return pool(spark, sf_dir).select("rec_id", "DatasetSource", "WorkHours", "SleepHours", "StressText", "Age")


_EXTRACT_SQL = f"WITH {POOL} SELECT rec_id, DatasetSource, WorkHours, SleepHours, StressText, Age FROM pool"


@register("csv_scan", f"""SELECT CAST(rec_id AS DOUBLE) AS rec_id, 'csv_pool' AS DatasetSource, WorkHours, SleepHours,
  trim(StressText) AS StressText, Age FROM ({_EXTRACT_SQL})""")
def q_csv_scan(spark, sf_dir):
    """A1: header CSV written by Spark, read back as text, numerics coerced."""
    path = FS.write_table(_pool_extract(spark, sf_dir), scratch_path(spark, "csv_scan"), "csv")
    spec = FS.SourceSpec("csv_pool", path, "csv", numeric=("rec_id", "WorkHours", "SleepHours", "Age"))
    return FS.read_source(spark, spec)


@register("tsv_scan", f"""SELECT CAST(rec_id AS VARCHAR) AS rec_id, 'tsv_pool' AS DatasetSource, WorkHours AS work_hours, SleepHours AS sleep_hours,
  trim(StressText) AS StressText, CAST(Age AS VARCHAR) AS Age FROM ({_EXTRACT_SQL})""")
def q_tsv_scan(spark, sf_dir):
    """A2: tab-separated source chosen by the spec (``fmt='tsv'``), renamed on read."""
    path = FS.write_table(_pool_extract(spark, sf_dir), scratch_path(spark, "tsv_scan"), "tsv")
    spec = FS.SourceSpec.from_dict({"source_name": "tsv_pool", "path": path, "fmt": "tsv",
                                    "column_map": {"WorkHours": "work_hours", "SleepHours": "sleep_hours"},
                                    "numeric": ["work_hours", "sleep_hours"]})
    return FS.read_source(spark, spec)


@register("headerless_scan", f"""SELECT DatasetSource AS DatasetSource_raw, WorkHours AS Age_raw, Age AS ExperienceYears,
  'corporate' AS DatasetSource FROM ({_EXTRACT_SQL})
UNION ALL SELECT 'DatasetSource', NULL, NULL, 'corporate'""")
def q_headerless_scan(spark, sf_dir):
    """A3: headerless read by position; the written header line becomes a row of NULL numbers."""
    path = FS.write_table(_pool_extract(spark, sf_dir), scratch_path(spark, "headerless"), "csv")
    spec = FS.SourceSpec("corporate", path, "csv", header=False, positions={1: "DatasetSource_raw", 2: "Age_raw",
                                                                             5: "ExperienceYears"},
                         numeric=("Age_raw", "ExperienceYears"))
    return FS.read_source(spark, spec)


@register("json_scan", f"""SELECT rec_id, 'synthetic_json' AS DatasetSource, WorkHours, SleepHours, StressText, Age FROM ({_EXTRACT_SQL})""")
def q_json_scan(spark, sf_dir):
    """A4 (read side) and A6: JSON-lines source plus an absent source reported as skipped."""
    path = FS.write_table(_pool_extract(spark, sf_dir), scratch_path(spark, "json_scan"), "json")
    frames, skipped = FS.load_sources(spark, [
        FS.SourceSpec("synthetic_json", path, "json", multiline=False),
        FS.SourceSpec("missing_source", path + "-absent", "csv")])
    assert skipped.count() == 1
    return frames[0]


@register("table_sink", f"WITH {POOL} SELECT rec_id, DatasetSource, WorkHours, SleepHours FROM pool")
def q_table_sink(spark, sf_dir):
    """Stage sink partitioned by source, read back whole (a per-source read prunes to one partition)."""
    path = FS.write_table(pool(spark, sf_dir).select("rec_id", "DatasetSource", "WorkHours", "SleepHours"),
                          scratch_path(spark, "stage"), partition_by=["DatasetSource"])
    return spark.read.parquet(path)


# ------------------------------------------------------------------ J10: SMOTE
def _draw_sql(tag, digits):
    return f"CAST(('0x' || substr(md5(id || '#' || j || '#42#{tag}'), 1, {digits})) AS BIGINT)"


@register("smote", f"""WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, CASE WHEN label = 0 THEN 1 ELSE 0 END AS y FROM embeddings),
m AS (SELECT id, vec, row_number() OVER (ORDER BY md5(id || '#42'), id) AS rk FROM v WHERE y = 1),
c AS (SELECT CAST(sum(y) AS BIGINT) AS n_min, CAST(greatest(sum(y), sum(1 - y)) - sum(y) AS BIGINT) AS n_new, least(0, min(id)) AS lowest FROM v),
nn AS (SELECT a.id, b.id AS rid, b.vec AS nv, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.vec, b.vec), b.id) - 1 AS r
       FROM m a JOIN m b ON a.id <> b.id),
rp AS (SELECT id, vec, rk, unnest(range(n_new // n_min + CASE WHEN rk <= n_new % n_min THEN 1 ELSE 0 END)) AS j FROM m, c WHERE n_min >= 2),
pk AS (SELECT rp.*, {_draw_sql('nn', 8)} % least(5, n_min - 1) AS r, {_draw_sql('gap', 12)} / 281474976710656.0 AS u, n_min, lowest FROM rp, c),
s AS (SELECT lowest - (rk + j * n_min) AS vec_id, 1 AS y, true AS is_synthetic, vec, nv, u FROM pk JOIN nn ON nn.id = pk.id AND nn.r = pk.r
      UNION ALL SELECT id, y, false, vec, vec, 0.0 FROM v)
SELECT vec_id, y, is_synthetic, unnest(range(len(vec))) AS dim, unnest([vec[i] + u * (nv[i] - vec[i]) FOR i IN range(1, len(vec) + 1)]) AS value FROM s""")
def q_smote(spark, sf_dir):
    """SMOTE on FB7 (rare class 1), k=5, seed 42, over exact neighbours; a row per entry of every vector."""
    out = smote(fx.vectors(spark, sf_dir), "vec_id", "embedding", "y", k=5, seed=42)
    return out.select("vec_id", "y", "is_synthetic", F.posexplode("embedding").alias("dim", "value"))


# ------------------------------------------------------------------ J12-J13 selection
@register("forest_importance")
def q_forest_importance(spark, sf_dir):
    """Forest importance ranking of the stress features."""
    return TR.forest_importance(spark, stress_table(spark, sf_dir), STRESS_OUT, "Target", **FOREST_SMALL)


@register("rfe_select")
def q_rfe_select(spark, sf_dir):
    """Recursive elimination to 8 features (2 per round)."""
    return TR.recursive_elimination(spark, stress_table(spark, sf_dir), STRESS_OUT, "Target", 8, step=2,
                                    **FOREST_SMALL)


# ------------------------------------------------------------------ J15-J20 training
def _predictions(bundle, test, key, label):
    return bundle.transform(test).select(key, F.col(label).alias("y"), "p", "needs_attention")


@register("train_logreg")
def q_train_logreg(spark, sf_dir):
    """Logistic regression on the embedding columns; test-set probabilities."""
    v = vector_table(spark, sf_dir)
    train, test = _split(v, "vec_id", "y")
    b = TR.Bundle("logreg", _emb(v), "y", "logreg").fit(train)
    return _predictions(b, test, "vec_id", "y")


@register("train_forest")
def q_train_forest(spark, sf_dir):
    """Random forest on the stress features."""
    s = stress_table(spark, sf_dir)
    train, test = _split(s, "rec_id", "Target")
    b = TR.Bundle("forest", STRESS_OUT, "Target", "forest", params=FOREST_SMALL).fit(train)
    return _predictions(b, test, "rec_id", "Target")


@register("train_gbt")
def q_train_gbt(spark, sf_dir):
    """Boosted trees with per-source sample weights."""
    s = source_weight(stress_table(spark, sf_dir), STRESS_SOURCE_WEIGHTS)
    train, test = _split(s, "rec_id", "Target")
    b = TR.Bundle("gbt", STRESS_OUT, "Target", "gbt", params=GBT_SMALL).fit(train, "sample_weight")
    return _predictions(b, test, "rec_id", "Target")


TL_FEATURES = ["MoodMini", "SleepMini", "WorkloadMini", "EscalationVelocity_Mini", "SleepDecline_7D",
               "ConsecutiveRiskDays", "RecoveryDeficitSlope", "MoodVolatility", "BurnoutAcceleration"]


#: Smaller than the production defaults of ``SoftmaxBoost`` (300 rounds of depth 6 at rate 0.03).
BOOST_SMALL = {"rounds": 8, "depth": 4, "rate": 0.3}


def boosted_deterioration(spark, sf_dir):
    """The 4-class booster on the timeline's training users with the fixed class weights, and the other users' rows."""
    t = build_features(fx.timeline(spark, sf_dir)).withColumn("key", F.concat_ws("#", "user_id", "timepoint"))
    t = t.withColumn("w", map_lookup({k: float(v) for k, v in DETERIORATION_CLASS_WEIGHTS.items()}, "Target", 1.0)).checkpoint()
    model = SoftmaxBoost(TL_FEATURES, 4, **BOOST_SMALL).fit(t.where("Split = 'train'"), "Target", "key", "w")
    return model, t.where("Split <> 'train'")


@register("train_multiclass")
def q_train_multiclass(spark, sf_dir):
    """Softmax boosting of the 4-class deterioration target with the fixed 1 / 2 / 4 / 10 class weights."""
    model, test = boosted_deterioration(spark, sf_dir)
    return model.transform(test).select("user_id", "timepoint", "Target", *[F.col("probability")[c].alias(f"prob_{c}") for c in range(4)],
                                        F.col("prediction").alias("pred"))


@register("multiclass_checks", f"""SELECT user_id, timepoint, Target, true AS sums_to_one, true AS all_positive, true AS pred_is_likeliest,
  {BOOST_SMALL["rounds"]} AS rounds_with_falling_loss, true AS same_after_reload
FROM ({DETERIORATION_SQL}) WHERE Split <> 'train'""")
def q_multiclass_checks(spark, sf_dir):
    """What must hold for every scored row: probabilities, the predicted class, the loss of the rounds, a reload."""
    model, test = boosted_deterioration(spark, sf_dir)
    path = model.save(spark, scratch_path(spark, "boost"))
    scored = SoftmaxBoost.load(spark, path).transform(model.transform(test), "again", "pred_again")
    p = F.col("probability")
    falls = sum(b < a for a, b in zip(model.losses, model.losses[1:]))
    total = F.aggregate(p, F.lit(0.0), lambda a, v: a + v)
    return scored.select("user_id", "timepoint", "Target", (F.abs(total - 1) < 1e-9).alias("sums_to_one"),
                         F.forall(p, lambda v: v > 0).alias("all_positive"),
                         (p[F.col("prediction")] == F.array_max(p)).alias("pred_is_likeliest"),
                         F.lit(falls).alias("rounds_with_falling_loss"), (p == F.col("again")).alias("same_after_reload"))


@register("soft_vote")
def q_soft_vote(spark, sf_dir):
    """Mean probability of logistic regression, forest and boosted trees."""
    s = stress_table(spark, sf_dir)
    train, test = _split(s, "rec_id", "Target")
    members = [TR.Bundle("lr", STRESS_OUT, "Target", "logreg").fit(train),
               TR.Bundle("rf", STRESS_OUT, "Target", "forest", params=FOREST_SMALL).fit(train),
               TR.Bundle("gbt", STRESS_OUT, "Target", "gbt", params=GBT_SMALL).fit(train)]
    return TR.soft_vote(test, members).select("rec_id", F.col("Target").alias("y"), "p")


@register("train_mlp")
def q_train_mlp(spark, sf_dir):
    """Feed-forward classifier 64/32/16 hidden layers (sigmoid hidden units in Spark)."""
    v = vector_table(spark, sf_dir)
    train, test = _split(v, "vec_id", "y")
    n = len(_emb(v))
    b = TR.Bundle("mlp", _emb(v), "y", "mlp", params={"layers": [n, 64, 32, 16, 2]}).fit(train)
    return _predictions(b, test, "vec_id", "y")


# ------------------------------------------------------------------ J21-J22 calibration
@register("fold_calibrated")
def q_fold_calibrated(spark, sf_dir):
    """5-fold isotonic calibration of logistic regression; mean of the fold members."""
    v = vector_table(spark, sf_dir)
    train, test = _split(v, "vec_id", "y")
    members = TR.fold_calibrated(train, lambda: TR.Bundle("lr", _emb(v), "y", "logreg"), "vec_id", 5)
    return TR.calibrated_transform(test, members).select("vec_id", "y", "p")


@register("isotonic_full", f"""WITH s AS ({fx.SCORED_SQL}),
t AS (SELECT p, sum(y) AS s, count(*) AS n, row_number() OVER (ORDER BY p) AS i FROM s GROUP BY p),
c AS (SELECT p, i, s, n, sum(s) OVER (ORDER BY i) AS cs, sum(n) OVER (ORDER BY i) AS cn FROM t),
m AS (SELECT a.i AS a, b.i AS b, CAST(b.cs - a.cs + a.s AS DOUBLE) / CAST(b.cn - a.cn + a.n AS DOUBLE) AS mean FROM c a JOIN c b ON a.i <= b.i),
f AS (SELECT b, max(low) AS p_cal FROM (SELECT b, min(mean) OVER (PARTITION BY a ORDER BY b DESC) AS low FROM m) GROUP BY b)
SELECT rec_id, s.p, y, p_cal FROM s JOIN c ON s.p = c.p JOIN f ON f.b = c.i""")
def q_isotonic_full(spark, sf_dir):
    """Isotonic map fitted on all FB3 scores; out-of-range scores clip to the ends."""
    s = fx.scored_rows(spark, sf_dir)
    iso = TR.isotonic_fit(s)
    return iso.transform(s).select("rec_id", "p", "y", "p_cal")


# ------------------------------------------------------------------ J24 search
@register("random_search")
def q_random_search(spark, sf_dir):
    """10 sampled forest settings, 3-fold CV, positive-class recall."""
    space = {"numTrees": [10, 20, 30], "maxDepth": [3, 5, 7], "minInstancesPerNode": [1, 5, 10]}
    return TR.random_search(spark, stress_table(spark, sf_dir), STRESS_OUT, "Target", "forest", space,
                            n_iter=10, folds=3)


# ------------------------------------------------------------------ J37-J40 harnesses
PROXIES = ["WeeklyStressTrend", "ConsecutivePoorSleepDays", "HighWorkloadFrequency"]
ENGINEERED = ["RecentStressSpike", "RecoveryFailureScore", "StressLoad", "BurnoutRiskCalc", *PROXIES]
LEAKY = ["WorkStressMini", "ExhaustionMini", "WorkStress_missing", "EmotionalExhaustion_missing"]


@register("ablation")
def q_ablation(spark, sf_dir):
    """Variants A-F on one cached split (run on the engineered table, see README)."""
    drawn = PROXIES[1:]
    s = stress_table(spark, sf_dir, drawn)
    s = s.withColumns({f"DatasetSource_{v}": (F.col("DatasetSource") == v).cast("double")
                       for v in sorted(STRESS_SOURCE_NAMES.values())[1:]})
    allf = STRESS_OUT + drawn + [c for c in s.columns if c.startswith("DatasetSource_")]
    variants = {
        "Variant A (Full)": allf,
        "Variant B (No Eng)": [f for f in allf if f not in ENGINEERED],
        "Variant C (No Proxies)": [f for f in allf if f not in PROXIES],
        "Variant D (Cross-Domain)": [f for f in allf if not f.startswith("DatasetSource")],
        # without the target's own columns and everything computed from them
        "Variant E (Target-Blind)": [f for f in allf if f not in LEAKY + ENGINEERED],
        "Variant F (Minimal)": ["SleepHours", "ScreenTime", "WorkHours", "Age", "ExperienceYears"],
    }
    return X.ablation(s, "rec_id", "Target", variants, "gbt", **GBT_SMALL)


BURN_FEATURES = ["DigitalOverloadIndex", "WorkloadIntensity", "StressLoad", "SleepDebt", "RecoveryScore"]


def burnout_table(spark, sf_dir, prepare=lambda p: p):
    """Burnout features of the pool; ``prepare`` changes the raw rows first."""
    p = pool(spark, sf_dir).select("rec_id", map_lookup(BURNOUT_SOURCE_NAMES, "DatasetSource").alias("DatasetSource"),
                                   "RiskCategory", "p", "ScreenTime", *BURN_COLS)
    f = FE.feat_burnout(prepare(p))
    return f.select("rec_id", "DatasetSource", "RiskCategory", *BURN_FEATURES,
                    *[f"{c}_missing" for c in BURN_FLAGS], "SlackActivity", "MeetingParticipation", "EmailSentiment")


@register("experiment_grid")
def q_experiment_grid(spark, sf_dir):
    """Original, normalised and balanced pools (I22) x two hold-out sources that no pool holds; soft vote of
    boosted trees and a forest."""
    held = F.col("DatasetSource").isin("Student_Burnout", "WFH_Corporate")
    plain = burnout_table(spark, sf_dir)
    normal = burnout_table(spark, sf_dir, L.normalise_source).filter(~held)
    variants = {
        "BASELINE": plain.filter(~held),
        "NORMALIZED_MIXED": normal,
        "BALANCED_HYBRID": L.balanced_pool(normal, "rec_id", POOL_SYNTHETIC_ROWS),
    }
    holdouts = {"Workplace_Success_Anchor": plain.filter(F.col("DatasetSource") == "WFH_Corporate"),
                "Psychological_Stress_Test": plain.filter(F.col("DatasetSource") == "Student_Burnout")}
    return X.experiment_grid(variants, holdouts, BURN_FEATURES, "RiskCategory",
                             {"gbt": GBT_SMALL, "forest": FOREST_SMALL})


@register("dual_model")
def q_dual_model(spark, sf_dir):
    """Integrated model on the sources with workplace integrations, clinical model on its own four sources,
    each with its own source weights."""
    flags = [f"{c}_missing" for c in BURN_FLAGS]
    clinical = [c for c in flags if "Slack" not in c and "Meeting" not in c]
    _bundles, report = X.dual_model(burnout_table(spark, sf_dir), "rec_id", "RiskCategory", {
        "integrated": X.SubModel(BURN_FEATURES + flags, INTEGRATED_SOURCES, INTEGRATED_WEIGHTS),
        "clinical": X.SubModel(["StressLoad", "SleepDebt", "RecoveryScore"] + clinical, CLINICAL_SOURCES,
                               CLINICAL_WEIGHTS, 0.4)}, **GBT_SMALL)
    return report


@register("model_build")
def q_model_build(spark, sf_dir):
    """Split -> SMOTE -> 5-fold calibrated logistic regression -> threshold pick -> evaluate -> save."""
    v = vector_table(spark, sf_dir)
    emb = _emb(v)

    def oversample(train):
        arr = train.select("vec_id", "y", F.array(*emb).alias("vec"))
        s = smote(arr, "vec_id", "vec", "y")
        return s.select("vec_id", "y", *[F.col("vec")[i].alias(c) for i, c in enumerate(emb)])

    return X.model_build(spark, v, "vec_id", "y", emb, "logreg", oversample=oversample,
                         save_to=scratch_path(spark, "bundle_hybrid"))


# ------------------------------------------------------------------ A11-A12, K2
@register("bundle_score")
def q_bundle_score(spark, sf_dir):
    """Fit a burnout bundle, save it to shared storage, load it back and score
    every row with the plain class-1 probability at the bundle threshold."""
    b = burnout_table(spark, sf_dir)
    train, _test = _split(b, "rec_id", "RiskCategory")
    bundle = TR.Bundle("burnout", BURN_FEATURES, "RiskCategory", "gbt", 0.5, "2", params=GBT_SMALL).fit(train)
    path = bundle.save(spark, scratch_path(spark, "bundle_burnout"))
    loaded = TR.Bundle.load(spark, path)
    assert loaded.features == BURN_FEATURES and loaded.threshold == 0.5
    return loaded.transform(b).select("rec_id", "p", "needs_attention",
                                      F.lit(loaded.name).alias("model"), F.lit(loaded.version).alias("version"))


# ------------------------------------------------------------------ 2.M streaming extension
STREAM_SQL = """
WITH d AS (SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, avg(value) AS av, count(*) AS n,
             count(*) FILTER (WHERE event_type = 'error') AS e
           FROM events WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY ALL),
i AS (SELECT user_id, day, n AS n_events, least(10.0::DOUBLE, round(av, 4) / 12.0::DOUBLE) AS Stress,
        CASE WHEN n % 5 = 0 THEN NULL ELSE least(10.0::DOUBLE, 3.0::DOUBLE + n * 1.5::DOUBLE) END AS Sleep,
        CASE WHEN n = 1 AND e = 0 THEN NULL ELSE least(10.0::DOUBLE, 10.0::DOUBLE * e / n) END AS Workload FROM d),
c AS (SELECT *, (Stress + coalesce(Workload, 0)) / CASE WHEN Workload IS NULL THEN 1 ELSE 2 END AS CompositeRisk,
        row_number() OVER (PARTITION BY user_id ORDER BY day) AS rn FROM i),
g AS (SELECT *, rn - row_number() OVER (PARTITION BY user_id, CompositeRisk > 7 ORDER BY day) AS island FROM c)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, n_events, Stress, Sleep, Workload, CompositeRisk,
  avg(CompositeRisk) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS RollingMean_7D,
  CASE WHEN CompositeRisk > 7 THEN row_number() OVER (PARTITION BY user_id, CompositeRisk > 7, island ORDER BY day)
       ELSE 0 END AS ConsecutiveRiskDays, rn AS history_len,
  CASE WHEN rn >= 7 THEN 'ok' ELSE 'insufficient_data' END AS status
FROM g"""


@register("stream_daily_state", STREAM_SQL)
def q_stream_daily_state(spark, sf_dir):
    """Streaming extension: events replayed as a file stream in time order with an end mark, watermark 1 hour, per-user
    daily state in the state store; every day closes."""
    from ..streaming import daily_state as DS
    events = fx.table(spark, sf_dir, "events")
    files = DS.files_per_piece(events)
    src = DS.split_by_time(events, scratch_path(spark, "events_feed"), files=files)
    DS.write_end_mark(spark, src)
    out = DS.run_available(spark, src, scratch_path(spark, "daily_state"), scratch_path(spark, "daily_state_ckpt"), files)
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


# ------------------------------------------------------------------ J23 permutation importance
@register("permutation_importance")
def q_permutation_importance(spark, sf_dir):
    """Permutation importance (AUC drop) of the forest's stress features on the test split."""
    s = stress_table(spark, sf_dir)
    train, test = _split(s, "rec_id", "Target")
    b = TR.Bundle("forest", STRESS_OUT, "Target", "forest", params=FOREST_SMALL).fit(train)
    return TR.permutation_importance(spark, b, test, "rec_id")


PERMUTED = ["WorkHours", "SleepHours", "ScreenTime", "Age"]


@register("permutation_checks", f"""WITH {POOL}, c AS (SELECT unnest(['', {', '.join(f"'{f}'" for f in PERMUTED)}]) AS copy)
SELECT copy, feature, count(*) AS n_rows, count(v) AS n_values, sum(v) AS total, sum(v * v) AS squares,
  CASE WHEN copy = feature THEN true ELSE false END AS moved
FROM c, (SELECT unnest([{', '.join(f"'{f}'" for f in PERMUTED)}]) AS feature, unnest([{', '.join(f'CAST({f} AS DOUBLE)' for f in PERMUTED)}]) AS v FROM pool)
GROUP BY copy, feature""")
def q_permutation_checks(spark, sf_dir):
    """Every copy holds the same values in every feature, and only its own feature has moved."""
    p = pool(spark, sf_dir).select("rec_id", *[F.col(f).cast("double").alias(f) for f in PERMUTED])
    p = p.withColumns({f"_{f}": F.col(f) for f in PERMUTED})  # the values before
    copies = TR.permuted_copies(p, "rec_id", PERMUTED)
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("v"), F.col(f).eqNullSafe(F.col(f"_{f}")).alias("same"))
                                for f in PERMUTED]))
    cells = copies.select(F.col("_feature").alias("copy"), cells.alias("c")).select("copy", "c.*")
    return cells.groupBy("copy", "feature").agg(F.count("*").alias("n_rows"), F.count("v").alias("n_values"), F.sum("v").alias("total"),
                                                F.sum(F.col("v") * F.col("v")).alias("squares"), (~F.bool_and("same")).alias("moved"))


# ------------------------------------------------------------------ J40: persisted builds
BUILDS = {
    "hybrid_build": dict(rules=["hybrid_label", "hybrid_features"], purge=["PHQ9", "GAD7", "ClinicalTotal", "RiskScore", "RiskCategoryName"],
                         candidates=[*ANX_COLS, "GPA", "Age", "PHQ2", "GAD2", "StressLoad", "LifestyleScore", "SupportScore", "DigitalOverload",
                                     "MentalResilience", "BurnoutRisk", "RiskIndex"], k=15, n_select=12, step=4),
    "anxiety_build": dict(rules=["anxiety_label", "anxiety_features", "view_without_diagnostics"], purge=["GAD2"], select=False,
                          candidates=[*ANX_COLS, "GPA", "Age", "StressLoad", "LifestyleScore", "SupportScore", "RiskScore", "WellnessScore"]),
}
BUILD_LABELS = {"hybrid_build": "CAST((PHQ9 + GAD7) / 48 * 100 > 30 AS INTEGER)", "anxiety_build": "CAST(GAD7 >= 10 AS INTEGER)"}


def _build(spark, sf_dir, name):
    """Split, fit, save, load; the test rows scored by the fitted and by the loaded pipeline."""
    p = pool(spark, sf_dir).select("rec_id", "PHQ9", "GAD7", *ANX_COLS, "GPA", "Age", "GAD2")
    p = p.withColumn("y", F.expr(BUILD_LABELS[name]))
    rows = stratified_split(p, "rec_id", ["y"]).checkpoint()
    model = PL.build(rows, name, folds=3, forest={"numTrees": 10, "maxDepth": 5}, **BUILDS[name])
    path = scratch_path(spark, name)
    model.save(path)
    test = rows.where("is_test")
    before = model.transform(test).select("rec_id", "RiskCategory", "p", "needs_attention")
    after = PipelineModel.load(path).transform(test).select("rec_id", F.col("p").alias("p2"), F.col("needs_attention").alias("n2"))
    same = (F.abs(F.col("p") - F.col("p2")) < 1e-12) & (F.col("needs_attention") == F.col("n2"))
    return before.join(after, "rec_id").select("rec_id", F.col("RiskCategory").alias("label"), F.col("p").between(0, 1).alias("is_probability"),
                                               same.alias("same_after_reload"))


def _build_sql(label):
    return f"""WITH {POOL}, s AS (SELECT rec_id, {label} AS label FROM pool),
c AS (SELECT label, count(*) AS n_s FROM s GROUP BY label),
a AS (SELECT *, sum(n_s) OVER () AS n, ceil(CAST(sum(n_s) OVER () AS DOUBLE) * 0.2) AS ntt FROM c),
b AS (SELECT *, ntt * n_s / n AS exact, floor(ntt * n_s / n) AS base FROM a),
d AS (SELECT *, ntt - sum(base) OVER () AS lft, row_number() OVER (ORDER BY exact - base DESC, label) AS r FROM b),
rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(rec_id AS VARCHAR) || '#42'), rec_id) AS rk FROM s)
SELECT rec_id, label, true AS is_probability, true AS same_after_reload
FROM rk JOIN d USING (label) WHERE rk <= base + CAST(r <= lft AS INTEGER)"""


@register("hybrid_build", _build_sql(BUILD_LABELS["hybrid_build"]))
def q_hybrid_build(spark, sf_dir):
    """Hybrid labels and composites, three-list selection with fallback, SMOTE in the fit, calibration, threshold."""
    return _build(spark, sf_dir, "hybrid_build")


@register("anxiety_build", _build_sql(BUILD_LABELS["anxiety_build"]))
def q_anxiety_build(spark, sf_dir):
    """Anxiety label and composites, version B features, SMOTE in the fit, calibration, threshold."""
    return _build(spark, sf_dir, "anxiety_build")
