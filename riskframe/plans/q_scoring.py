"""Registered metric (J25-J36), sort (F), scoring (K) and text (H, L) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import capitalize
from ..functions.maps import EXTERNAL_STRESS_WORDS, MODEL_REGISTRY, REMOTE_BURNOUT_WORDS, SLEEP_QUALITY_WORDS
from ..functions.noise import integer_jitter
from ..operators import metrics as M
from ..operators import score as S
from ..operators import text as T
from ..operators.prep import PopulationScaler
from ..operators.ranks import quantiles
from ..operators.timeline import deterioration_targets, serve_deterioration
from ..sources import fixtures as fx
from . import q_timeline as qt
from .q_survey import POOL, STRESS_PRIORITY, STRESS_SOURCE_NAMES, _lit, _null_fraction_sql, _pool_columns, pool, sql_map
from .registry import register

SC = f"s AS ({fx.SCORED_SQL})"
SWEEP_T = [0.25, 0.35, 0.45, 0.55, 0.65, 0.75, 0.85, 0.95]


def scored(spark, sf_dir):
    return fx.scored_rows(spark, sf_dir)


def _rates_sql(src: str) -> str:
    return f"""SELECT *, CASE WHEN tp + fp + tn + fn = 0 THEN 0.0 ELSE CAST(tp + tn AS DOUBLE) / (tp + fp + tn + fn) END AS accuracy,
  CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS precision,
  CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS recall,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END AS f1,
  CASE WHEN fp + tn = 0 THEN 0.0 ELSE CAST(fp AS DOUBLE) / (fp + tn) END AS fpr FROM {src}"""


def _counts_sql(t: float, extra: str = "") -> str:
    return (f"count_if(p >= {t} AND y = 1) AS tp, count_if(p >= {t} AND y <> 1) AS fp, "
            f"count_if(p < {t} AND y <> 1) AS tn, count_if(p < {t} AND y = 1) AS fn{extra}")


# ------------------------------------------------------------------ J: metrics
@register("confusion", f"WITH {SC} SELECT {_counts_sql(0.65)} FROM s")
def q_confusion(spark, sf_dir):
    """Confusion counts at 0.65."""
    return M.confusion(scored(spark, sf_dir), 0.65)


@register("metrics_at", f"WITH {SC}, c AS (SELECT {_counts_sql(0.65)} FROM s) {_rates_sql('c')}")
def q_metrics_at(spark, sf_dir):
    """Accuracy / precision / recall / F1 / FPR at 0.65."""
    return M.metrics_at(scored(spark, sf_dir), 0.65)


SWEEP_SQL = " UNION ALL ".join(
    f"SELECT CAST({t!r} AS DOUBLE) AS threshold, {_counts_sql(t)} FROM s" for t in SWEEP_T)


@register("threshold_sweep", f"WITH {SC}, c AS ({SWEEP_SQL}) {_rates_sql('c')}")
def q_threshold_sweep(spark, sf_dir):
    """Eight thresholds from one scan."""
    return M.threshold_sweep(scored(spark, sf_dir), SWEEP_T)


@register("pick_threshold", f"""WITH {SC}, c AS ({SWEEP_SQL}), sw AS ({_rates_sql('c')}),
cand AS (SELECT * FROM (SELECT *, 'recall_and_fpr' AS rule, 0 AS o FROM sw WHERE recall >= 0.7 AND fpr <= 0.25
                        QUALIFY row_number() OVER (ORDER BY recall DESC, threshold) = 1)
         UNION ALL
         SELECT * FROM (SELECT *, 'recall_only' AS rule, 1 AS o FROM sw WHERE recall >= 0.7
                        QUALIFY row_number() OVER (ORDER BY fpr, threshold) = 1))
SELECT * EXCLUDE (o) FROM cand ORDER BY o LIMIT 1""")
def q_pick_threshold(spark, sf_dir):
    """constrained arg-max over the sweep."""
    return M.pick_threshold(M.threshold_sweep(scored(spark, sf_dir), SWEEP_T))


AUC_CORE = """t AS (SELECT {by}p AS score, count_if(y = 1) AS pos, count_if(y <> 1) AS neg FROM s GROUP BY ALL),
c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {part} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
         AS neg_below, sum(pos) OVER (PARTITION BY {part}) AS P, sum(neg) OVER (PARTITION BY {part}) AS N FROM t)"""


@register("roc_auc", f"""WITH {SC}, {AUC_CORE.format(by='', part='1')}
SELECT sum(pos * (neg_below + 0.5 * neg)) / (CAST(max(P) AS DOUBLE) * max(N)) AS roc_auc FROM c""")
def q_roc_auc(spark, sf_dir):
    """Exact AUC with ties counted half, two-level prefix sums."""
    return M.roc_auc(scored(spark, sf_dir))


@register("roc_points", f"""WITH {SC}, t AS (SELECT p AS score, count_if(y = 1) AS pos, count_if(y <> 1) AS neg FROM s GROUP BY 1)
SELECT score AS threshold, CAST(sum(pos) OVER w AS DOUBLE) / sum(pos) OVER () AS tpr,
       CAST(sum(neg) OVER w AS DOUBLE) / sum(neg) OVER () AS fpr
FROM t WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_roc_points(spark, sf_dir):
    """ROC curve points at every distinct score."""
    return M.roc_points(scored(spark, sf_dir))


@register("pr_points", f"""WITH {SC}, t AS (SELECT p AS score, count_if(y = 1) AS pos, count_if(y <> 1) AS neg FROM s GROUP BY 1)
SELECT score AS threshold, CAST(sum(pos) OVER w AS DOUBLE) / (sum(pos) OVER w + sum(neg) OVER w) AS precision,
       CAST(sum(pos) OVER w AS DOUBLE) / sum(pos) OVER () AS recall
FROM t WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_pr_points(spark, sf_dir):
    """Precision-recall points at every distinct score."""
    return M.pr_points(scored(spark, sf_dir))


OVR_SCORES = {c: f"score_{c}" for c in range(4)}


def _ovr_input(spark, sf_dir):
    t = deterioration_targets(fx.timeline(spark, sf_dir))
    return t.select("user_id", "timepoint", "Target", *[
        (1.0 / (1.0 + F.abs(F.col("Target_Current") - c) + F.abs(F.col("RiskVelocity")) / 1000.0)).alias(name)
        for c, name in OVR_SCORES.items()])


@register("auc_ovr", f"""WITH {qt.TL}, {qt.CR}, {qt.TARGETS},
x AS (SELECT Target, """ + ", ".join(
    f"1.0 / (1.0 + abs(Target_Current - {c}) + abs(RiskVelocity) / 1000.0) AS score_{c}" for c in range(4)) + """
      FROM tgt WHERE Target IS NOT NULL),
l AS (""" + " UNION ALL ".join(
    f"SELECT {c} AS cls, score_{c} AS score, CAST(Target = {c} AS INT) AS yc FROM x" for c in range(4)) + """),
t AS (SELECT cls, score, count_if(yc = 1) AS pos, count_if(yc <> 1) AS neg FROM l GROUP BY ALL),
c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY cls ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
         AS neg_below, sum(pos) OVER (PARTITION BY cls) AS P, sum(neg) OVER (PARTITION BY cls) AS N FROM t),
a AS (SELECT cls, sum(pos * (neg_below + 0.5 * neg)) / (CAST(max(P) AS DOUBLE) * max(N)) AS auc FROM c GROUP BY cls)
SELECT avg(auc) AS auc_ovr FROM a""")
def q_auc_ovr(spark, sf_dir):
    """Macro one-vs-rest AUC of class scores against the 4-class lead target."""
    return M.auc_ovr(_ovr_input(spark, sf_dir), "Target", OVR_SCORES)


@register("brier", f"WITH {SC} SELECT avg(pow(p - y, 2)) AS brier FROM s")
def q_brier(spark, sf_dir):
    return M.brier(scored(spark, sf_dir))


_EDGES = M.uniform_edges(10)


@register("reliability", f"""WITH {SC}
SELECT {' + '.join(f'CAST(p > {e!r} AS INTEGER)' for e in _EDGES)} AS bin, avg(p) AS prob_pred,
       avg(CAST(y AS DOUBLE)) AS prob_true, count(*) AS n FROM s GROUP BY 1""")
def q_reliability(spark, sf_dir):
    """10-bin reliability curve, (a, b] edges as numpy linspace."""
    return M.reliability(scored(spark, sf_dir), 10)


@register("prob_hist", f"""WITH {SC}, r AS (SELECT min(p) AS lo, max(p) AS hi FROM s),
b AS (SELECT y AS label, CAST(least(floor((p - lo) * (25 / (hi - lo))), 24) AS INTEGER) AS bin, lo, hi FROM s, r)
SELECT label, bin, count(*) AS count, any_value(lo) + bin * ((any_value(hi) - any_value(lo)) / 25) AS bin_lo,
       any_value(lo) + (bin + 1) * ((any_value(hi) - any_value(lo)) / 25) AS bin_hi FROM b GROUP BY label, bin""")
def q_prob_hist(spark, sf_dir):
    """Per-class probability histogram over 25 common bins."""
    return M.prob_hist(scored(spark, sf_dir), 25)


@register("class_report", f"""WITH {qt.TL}, {qt.CR}, {qt.TARGETS},
x AS (SELECT Target AS yv, Target_Current AS pv FROM tgt WHERE Target IS NOT NULL),
classes AS (SELECT yv AS cls FROM x UNION SELECT pv FROM x),
k AS (SELECT cls, (SELECT count(*) FROM x WHERE yv = cls AND pv = cls) AS tp,
             (SELECT count(*) FROM x WHERE yv = cls) AS support, (SELECT count(*) FROM x WHERE pv = cls) AS predicted
      FROM classes)
SELECT cls, CASE WHEN predicted = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / predicted END AS precision,
       CASE WHEN support = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / support END AS recall,
       CASE WHEN predicted + support = 0 THEN 0.0 ELSE CAST(2 * tp AS DOUBLE) / (predicted + support) END AS f1,
       support FROM k""")
def q_class_report(spark, sf_dir):
    """Per-class report of the persistence prediction (current class) vs the 7-step-ahead class."""
    t = deterioration_targets(fx.timeline(spark, sf_dir))
    return M.class_report(t, "Target", "Target_Current")


@register("source_audit", f"""WITH {SC}, {AUC_CORE.format(by='DatasetSource, ', part='DatasetSource')},
a AS (SELECT DatasetSource, CASE WHEN max(P) = 0 OR max(N) = 0 THEN NULL
             ELSE sum(pos * (neg_below + 0.5 * neg)) / (CAST(max(P) AS DOUBLE) * max(N)) END AS roc_auc
      FROM c GROUP BY 1),
m AS (SELECT DatasetSource, count(*) AS records, avg(CAST(y AS DOUBLE)) AS positive_rate, avg(pow(p - y, 2)) AS brier,
             {_counts_sql(0.65)} FROM s GROUP BY 1),
r AS ({_rates_sql('m')})
SELECT DatasetSource, records, positive_rate, recall, precision, roc_auc, fpr, brier
FROM r JOIN a USING (DatasetSource) WHERE records >= 10""")
def q_source_audit(spark, sf_dir):
    """Per-source audit at threshold 0.65 (sources under 10 rows skipped)."""
    return M.source_audit(scored(spark, sf_dir), 0.65)


@register("rank_models", f"""WITH {SC}, {AUC_CORE.format(by='DatasetSource, ', part='DatasetSource')},
a AS (SELECT DatasetSource, sum(pos * (neg_below + 0.5 * neg)) / (CAST(max(P) AS DOUBLE) * max(N)) AS roc_auc
      FROM c GROUP BY 1),
m AS (SELECT DatasetSource, {_counts_sql(0.5)} FROM s GROUP BY 1),
r AS ({_rates_sql('m')})
SELECT DatasetSource AS model, recall, f1, roc_auc,
       row_number() OVER (ORDER BY recall DESC, f1 DESC, roc_auc DESC, DatasetSource) AS rank
FROM r JOIN a USING (DatasetSource)""")
def q_rank_models(spark, sf_dir):
    """F2: per-source 'models' ranked by Recall, F1, ROC-AUC."""
    s = scored(spark, sf_dir)
    table = M.metrics_at(s, 0.5, by=["DatasetSource"]).join(M.roc_auc(s, by=["DatasetSource"]), "DatasetSource")
    table = table.select(F.col("DatasetSource").alias("model"), "recall", "f1", "roc_auc")
    return M.rank_models(table)


# ------------------------------------------------------------------ F: sorts
@register("sort_key", f"""WITH {POOL}
SELECT rec_id, coalesce({sql_map(sql_map('DatasetSource', STRESS_SOURCE_NAMES), STRESS_PRIORITY)}, 99) AS priority
FROM pool ORDER BY priority, rec_id""")
def q_sort_key(spark, sf_dir):
    """sort by source priority (tie-break on the record key; the reference sort is unstable)."""
    from ..functions import map_lookup
    p = pool(spark, sf_dir).select("rec_id", map_lookup(STRESS_PRIORITY, map_lookup(STRESS_SOURCE_NAMES, "DatasetSource"),
                                                        99).alias("priority"))
    return p.orderBy("priority", "rec_id")


@register("topk", f"WITH {POOL} SELECT rec_id, WorkStress FROM pool ORDER BY WorkStress DESC, rec_id LIMIT 10")
def q_topk(spark, sf_dir):
    """top-10 report (the limit is the feature)."""
    return pool(spark, sf_dir).select("rec_id", "WorkStress").orderBy(F.col("WorkStress").desc(), "rec_id").limit(10)


TOP_FEATS = ["WorkHours", "SleepHours", "WorkStress", "EmotionalExhaustion", "GPA"]


def _contrib_df(spark, sf_dir):
    p = pool(spark, sf_dir).select("rec_id", *TOP_FEATS)
    scaler = PopulationScaler(TOP_FEATS).fit(p)
    z = scaler.transform(p, suffix="_z").withColumns({f"{c}_z": F.coalesce(F.col(f"{c}_z"), F.lit(0.0)) for c in TOP_FEATS})
    return S.top_contributors(z, TOP_FEATS, impact_suffix="_z")


def _label_sql(name, value):
    v = f"printf('%.1f', round_even(coalesce({value}, 0.0), 1))"
    return f"""CASE WHEN contains({name}, 'Sleep') THEN 'Sleep pattern variance (' || {v} || 'h)'
  WHEN contains({name}, 'WorkHours') THEN 'Workload intensity (' || {v} || 'h)'
  WHEN contains({name}, 'Stress') THEN 'Elevated ' || lower({name}) || ' signals'
  WHEN contains({name}, 'Mood') THEN 'Emotional fluctuations'
  WHEN contains({name}, 'Workload') THEN 'High task density'
  WHEN contains({name}, 'GAD2') OR contains({name}, 'PHQ2') THEN 'Clinical screening markers'
  ELSE 'Impact from ' || lower(trim(regexp_replace({name}, '([A-Z])', ' \\1', 'g'))) END"""


CONTRIB_SQL = f"""WITH {POOL},
st AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in TOP_FEATS)} FROM pool),
z AS (SELECT rec_id, {', '.join(f"{c}" for c in TOP_FEATS)}, {', '.join(
    f"coalesce(({c} - m_{c}) / CASE WHEN s_{c} = 0 OR s_{c} IS NULL THEN 1.0 ELSE s_{c} END, 0.0) AS z_{c}"
    for c in TOP_FEATS)} FROM pool, st),
l AS (""" + " UNION ALL ".join(
    f"SELECT rec_id, {i} AS pos, '{c}' AS name, abs(z_{c}) AS impact, {c} AS value FROM z"
    for i, c in enumerate(TOP_FEATS)) + """),
r AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY impact DESC, pos) AS rk FROM l)
SELECT rec_id, string_agg(name, '|' ORDER BY rk) AS contributors_features,
       string_agg(""" + _label_sql("name", "value") + """, '|' ORDER BY rk) AS contributors
FROM r WHERE rk <= 3 GROUP BY rec_id"""


@register("row_top3", CONTRIB_SQL.replace(
    "string_agg(" + _label_sql("name", "value") + ", '|' ORDER BY rk) AS contributors", "count(*) AS k"))
def q_row_top3(spark, sf_dir):
    """per row, the three features with the largest |z|."""
    c = _contrib_df(spark, sf_dir)
    return c.select("rec_id", F.array_join("contributors_features", "|").alias("contributors_features"),
                    F.size("contributors_features").cast("long").alias("k"))


@register("contributors", CONTRIB_SQL)
def q_contributors(spark, sf_dir):
    """K7: top-3 drivers with humanised labels (|scaled value| path)."""
    c = _contrib_df(spark, sf_dir)
    return c.select("rec_id", F.array_join("contributors_features", "|").alias("contributors_features"),
                    F.array_join("contributors", "|").alias("contributors"))


# ------------------------------------------------------------------ K: scoring
def _adj_sql(kind):
    w = "coalesce(GAD2, 2.0)" if kind == "anxiety" else "coalesce(PHQ2, 2.0)"
    base = f"p * (0.8 + 0.4 * ({w} / 6.0))"
    cond = "coalesce(GAD2, 2.0) = 0 AND coalesce(PHQ2, 2.0) = 0"
    v = f"(CASE WHEN {cond} THEN least({base}, 0.20) ELSE {base} END)"
    return f"least(greatest({v}, 0.0), 0.99)"


@register("adjust_prob", f"""WITH {POOL}
SELECT rec_id, {_adj_sql('anxiety')} AS prob_anxiety, {_adj_sql('depression')} AS prob_depression FROM pool""")
def q_adjust_prob(spark, sf_dir):
    """K1: anxiety / depression probability adjustment (missing screening items default to 2)."""
    p = pool(spark, sf_dir).select("rec_id", "p", F.coalesce("GAD2", F.lit(2.0)).alias("GAD2"),
                                   F.coalesce("PHQ2", F.lit(2.0)).alias("PHQ2"))
    out = S.adjust_prob(p, "p", "anxiety", out="prob_anxiety")
    out = S.adjust_prob(out, "p", "depression", out="prob_depression")
    return out.select("rec_id", "prob_anxiety", "prob_depression")


@register("dampen", f"""SELECT user_id,
  CASE WHEN coalesce(last_mood >= 8.0 AND last_sleep >= 7.0 AND last_workload <= 3.0, false)
       THEN (1.0 - (1.0 - least(1.0, MoodVolatility / 3.0))) * 0.3 ELSE 1.0 - (1.0 - least(1.0, MoodVolatility / 3.0)) END
    AS prob,
  coalesce(last_mood >= 8.0 AND last_sleep >= 7.0 AND last_workload <= 3.0, false) AS dampened
FROM ({qt.SERVE_SQL}) AS sv""")
def q_dampen(spark, sf_dir):
    """K4: deterioration risk = 1 - P(stable), dampened on a healthy last day.

    P(stable) here is a stand-in derived from the user's volatility feature
    (the trained model's class-0 probability takes its place in production)."""
    latest = serve_deterioration(qt.serve_history(spark, sf_dir))
    latest = latest.withColumn("p_stable", 1.0 - F.least(F.lit(1.0), F.col("MoodVolatility") / 3.0))
    return S.dampen(latest, "p_stable").select("user_id", "prob", "dampened")


@register("route_and_band", f"""WITH {POOL},
r AS (SELECT rec_id, SlackActivity IS NOT NULL OR MeetingParticipation IS NOT NULL OR EmailSentiment IS NOT NULL AS integ, p
      FROM pool),
b AS (SELECT rec_id, integ, p, CASE WHEN integ THEN 0.5 ELSE 0.4 END AS t FROM r)
SELECT rec_id, CASE WHEN integ THEN 'integrated' ELSE 'clinical' END AS selected_model,
  round_even(p, 4) AS burnout_probability,
  CASE WHEN p > 0.8 THEN 'high' WHEN p >= t THEN 'moderate' ELSE 'safe' END AS risk_level,
  round_even(least(greatest(1 - abs(p - t) * 2, 0.65), 0.98), 2) AS confidence_score,
  CAST(p >= t AS INTEGER) AS needs_attention FROM b""")
def q_route_and_band(spark, sf_dir):
    """K5: integrated / clinical routing, bands and confidence."""
    p = pool(spark, sf_dir).select("rec_id", "SlackActivity", "MeetingParticipation", "EmailSentiment", "p")
    out = S.route_and_band(p, "p", "p")
    return out.select("rec_id", "selected_model", "burnout_probability", "risk_level", "confidence_score",
                      "needs_attention")


TYPES = ["stress", "deterioration", "anxiety", "depression", "burnout"]


def _score_sql(prob, kind_sql):
    t = "CASE " + " ".join(f"WHEN {kind_sql} = '{k}' THEN {MODEL_REGISTRY[k]['threshold']}" for k in TYPES) + " ELSE 0.5 END"
    raw = f"(CASE WHEN {prob} >= {t} THEN 70.0 + ({prob} - {t}) / (1.0 - {t} + 1e-9) * 30.0 ELSE {prob} / {t} * 69.0 END)"
    return f"least(greatest({raw}, 0.0), 100.0)"


def _level_sql(s):
    return (f"CASE WHEN {s} >= 85 THEN 'SEVERE' WHEN {s} >= 70 THEN 'HIGH' WHEN {s} >= 50 THEN 'MODERATE' "
            f"WHEN {s} >= 25 THEN 'MILD' ELSE 'MINIMAL' END")


KIND_SQL = "(CASE rec_id % 5 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(TYPES)) + " END)"
VERSION_SQL = "CASE predictionType " + " ".join(f"WHEN '{k}' THEN '{MODEL_REGISTRY[k]['version']}'" for k in TYPES) + \
    " ELSE 'unknown' END"


@register("risk_level", f"""WITH {POOL}, k AS (SELECT rec_id, p, {KIND_SQL} AS predictionType FROM pool),
sc AS (SELECT *, {_score_sql('p', 'predictionType')} AS s FROM k)
SELECT rec_id, predictionType, CAST(trunc(s) AS INTEGER) AS score, {_level_sql('s')} AS riskLevel,
       {VERSION_SQL} AS modelVersion FROM sc""")
def q_risk_level(spark, sf_dir):
    """H8 / K6: probability -> 0-100 score (threshold at 70) -> level, per model type."""
    kind = F.element_at(F.array(*[F.lit(k) for k in TYPES]), (F.col("rec_id") % 5 + 1).cast("int"))
    p = pool(spark, sf_dir).select("rec_id", "p", kind.alias("predictionType"))
    return S.format_result(p, "p", "predictionType").select("rec_id", "predictionType", "score", "riskLevel",
                                                             "modelVersion")


BATCH_TYPES = TYPES + ["wellbeing"]


@register("score_batch", f"""WITH {POOL},
k AS (SELECT rec_id, p, GAD2, PHQ2, (CASE rec_id % 6 {' '.join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(BATCH_TYPES))} END)
        AS predictionType FROM pool),
pr AS (SELECT *, CASE predictionType WHEN 'anxiety' THEN {_adj_sql('anxiety')} WHEN 'depression' THEN {_adj_sql('depression')}
                 ELSE p END AS prob FROM k),
sc AS (SELECT *, {_score_sql('prob', 'predictionType')} AS s, predictionType IN ({', '.join(_lit(t) for t in TYPES)}) AS ok
       FROM pr)
SELECT rec_id, predictionType, ok AS success,
  CASE WHEN ok THEN NULL ELSE 'Unknown prediction type ' || predictionType END AS message,
  CASE WHEN ok THEN CAST(trunc(s) AS INTEGER) END AS score, CASE WHEN ok THEN {_level_sql('s')} END AS riskLevel,
  CASE WHEN ok THEN {VERSION_SQL} END AS modelVersion FROM sc""")
def q_score_batch(spark, sf_dir):
    """K8: score a mixed batch by prediction type; unknown types are reported as failed rows."""
    kind = F.element_at(F.array(*[F.lit(k) for k in BATCH_TYPES]), (F.col("rec_id") % 6 + 1).cast("int"))
    p = pool(spark, sf_dir).select("rec_id", "p", F.coalesce("GAD2", F.lit(2.0)).alias("GAD2"),
                                   F.coalesce("PHQ2", F.lit(2.0)).alias("PHQ2"), kind.alias("predictionType"))
    p = S.adjust_prob(p, "p", "anxiety", out="_pa")
    p = S.adjust_prob(p, "p", "depression", out="_pd")
    prob = F.when(F.col("predictionType") == "anxiety", F.col("_pa")).when(
        F.col("predictionType") == "depression", F.col("_pd")).otherwise(F.col("p"))
    p = p.withColumn("prob", prob)
    res = S.format_result(p, "prob", "predictionType")
    ok = F.col("predictionType").isin(TYPES)
    return res.select("rec_id", "predictionType", ok.alias("success"),
                      F.when(~ok, F.concat(F.lit("Unknown prediction type "), F.col("predictionType"))).alias("message"),
                      F.when(ok, F.col("score")).alias("score"), F.when(ok, F.col("riskLevel")).alias("riskLevel"),
                      F.when(ok, F.col("modelVersion")).alias("modelVersion"))


# ------------------------------------------------------------------ H / L: text
@register("crisis_flag", f"""SELECT conv_id, turn,
  {' OR '.join(f"contains(lower(text), '{k}')" for k in T.CRISIS_KEYWORDS)} AS crisis,
  CASE WHEN {' OR '.join(f"contains(lower(text), '{k}')" for k in T.CRISIS_KEYWORDS)} THEN 'SEVERE' ELSE 'MED' END AS riskLevel,
  CASE WHEN {' OR '.join(f"contains(lower(text), '{k}')" for k in T.CRISIS_KEYWORDS)} THEN 'SUICIDE' ELSE 'OTHER' END AS category,
  CASE WHEN {' OR '.join(f"contains(lower(text), '{k}')" for k in T.CRISIS_KEYWORDS)}
       THEN {_lit('|'.join(T.CRISIS_HIT['suggestions']))} ELSE {_lit('|'.join(T.CRISIS_MISS['suggestions']))} END AS suggestions
FROM conversations""")
def q_crisis_flag(spark, sf_dir):
    """H2 / L1: keyword crisis fallback over every conversation turn (whole texts)."""
    c = fx.table(spark, sf_dir, "conversations")
    out = T.crisis_flag(c, "text")
    return out.select("conv_id", "turn", "crisis", "riskLevel", "category",
                      F.array_join("suggestions", "|").alias("suggestions"))


@register("norm_text", """SELECT doc_id, md5(lower(trim(text))) AS text_norm_md5, length(lower(trim(text))) AS norm_len,
  upper(substr(trim(source), 1, 1)) || lower(substr(trim(source), 2)) AS source_cap FROM documents""")
def q_norm_text(spark, sf_dir):
    """H1: lower / strip / capitalize over whole documents (digest of the normalised text)."""
    d = fx.table(spark, sf_dir, "documents")
    n = T.normalise_text(F.col("text"))
    return d.select("doc_id", F.md5(n).alias("text_norm_md5"), F.length(n).cast("long").alias("norm_len"),
                    capitalize(F.trim("source")).alias("source_cap"))


@register("humanize", _null_fraction_sql(_pool_columns()).replace(
    "SELECT * FROM (", "SELECT \"column\", lower(trim(regexp_replace(\"column\", '([A-Z])', ' \\1', 'g'))) AS humanized FROM (",
    1) + " AS t")
def q_humanize(spark, sf_dir):
    """H3: camel-case feature names (from the pool's null-fraction profile) -> lower-case words."""
    from ..operators.schema import null_fractions
    prof = null_fractions(pool(spark, sf_dir))
    return prof.select("column", S.humanize(F.col("column")).alias("humanized"))


@register("format_label", f"""WITH {POOL}
SELECT rec_id, printf('%.1f', round_even(SleepHours, 1)) || 'h' AS sleep_label,
  printf('%.1f%%', round_even(WorkStress * 10.0, 1)) AS stress_pct,
  CAST(rec_id AS VARCHAR) || '_ev' AS user_key,
  array_to_string([DatasetSource, StressText], ', ') AS joined FROM pool""")
def q_format_label(spark, sf_dir):
    """H4: number formats, id suffix and list join."""
    p = pool(spark, sf_dir)
    return p.select(
        "rec_id",
        F.when(F.col("SleepHours").isNotNull(),
               F.concat(F.format_string("%.1f", F.bround("SleepHours", 1)), F.lit("h"))).alias("sleep_label"),
        F.when(F.col("WorkStress").isNotNull(),
               F.format_string("%.1f%%", F.bround(F.col("WorkStress") * 10.0, 1))).alias("stress_pct"),
        F.concat(F.col("rec_id").cast("string"), F.lit("_ev")).alias("user_key"),
        F.array_join(F.array("DatasetSource", "StressText"), ", ").alias("joined"),
    )


JSON_SCHEMA = "k INT, title STRING, summary STRING, recommendations ARRAY<STRING>, encouragement STRING"


def _jv(x):
    w = f"('[' || {x} || ']')"
    return (f"(coalesce(CASE WHEN json_valid({w}) THEN json_array_length({w}) = 1 AND starts_with(ltrim({x}), '{{') "
            f"ELSE false END, false))")


@register("json_defaults", f"""WITH j AS ({fx.JSON_SQL})
SELECT event_id,
  CASE WHEN {_jv('payload')} THEN CAST(payload ->> '$.k' AS INTEGER) END AS reply_k,
  CASE WHEN {_jv('payload')} THEN coalesce(payload ->> '$.title', {_lit(T.WEEKLY_DEFAULTS['title'])})
       ELSE {_lit(T.WEEKLY_FALLBACK['title'])} END AS reply_title,
  CASE WHEN {_jv('payload')} THEN coalesce(payload ->> '$.summary', '') ELSE {_lit(T.WEEKLY_FALLBACK['summary'])} END
    AS reply_summary,
  CASE WHEN {_jv('payload')} THEN '' ELSE {_lit('|'.join(T.WEEKLY_FALLBACK['recommendations']))} END AS reply_recommendations,
  CASE WHEN {_jv('payload')} THEN coalesce(payload ->> '$.encouragement', {_lit(T.WEEKLY_DEFAULTS['encouragement'])})
       ELSE {_lit(T.WEEKLY_FALLBACK['encouragement'])} END AS reply_encouragement,
  {_jv('payload')} AS reply_valid
FROM j""")
def q_json_defaults(spark, sf_dir):
    """JSON replies with per-field defaults, list head, whole-row fallback."""
    j = fx.json_props(spark, sf_dir)
    out = T.parse_with_defaults(j, "payload", JSON_SCHEMA, T.WEEKLY_DEFAULTS, T.WEEKLY_FALLBACK,
                                {"recommendations": 3})
    return out.select("event_id", "reply_k", "reply_title", "reply_summary",
                      F.array_join("reply_recommendations", "|").alias("reply_recommendations"),
                      "reply_encouragement", "reply_valid")


@register("fallback_flag", """SELECT conv_id, turn, NOT coalesce(contains(text, 'SYSTEM_FALLBACK'), false) AS aiAvailable
FROM conversations""")
def q_fallback_flag(spark, sf_dir):
    """AI-availability flag per reply."""
    c = fx.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", T.fallback_flag(F.col("text")).alias("aiAvailable"))


@register("insight_text", f"""WITH {POOL}, k AS (SELECT rec_id, p, {KIND_SQL} AS predictionType FROM pool),
sc AS (SELECT *, {_score_sql('p', 'predictionType')} AS s FROM k),
r AS (SELECT rec_id, predictionType, CAST(trunc(s) AS INTEGER) AS score, {_level_sql('s')} AS riskLevel FROM sc)
SELECT rec_id,
  CASE WHEN riskLevel IN ('HIGH', 'SEVERE') THEN 'Elevated ' || upper(substr(predictionType, 1, 1)) || lower(substr(predictionType, 2))
       || ' Signals Detected' ELSE upper(substr(predictionType, 1, 1)) || lower(substr(predictionType, 2)) || ' Check-in' END AS title,
  'Your current score of ' || CAST(score AS VARCHAR) || ' indicates a ' || lower(riskLevel) || ' level of ' || lower(predictionType)
    || '.' AS summary,
  'This result is primarily influenced by: recent patterns.' AS why,
  CASE WHEN riskLevel IN ('HIGH', 'SEVERE') THEN {_lit('|'.join(T.INSIGHT_ACTIONS_ELEVATED))} ELSE {_lit('|'.join(T.INSIGHT_ACTIONS))} END
    AS actions,
  CASE WHEN riskLevel IN ('HIGH', 'SEVERE') THEN {_lit(T.INSIGHT_SAFETY_NOTE)} END AS safetyNote,
  {sql_map('riskLevel', T.TONE_BY_LEVEL, T.TONE_DEFAULT)} AS tone
FROM r""")
def q_insight_text(spark, sf_dir):
    """L2 / L3: rule-based insight text and tone for every scored row."""
    kind = F.element_at(F.array(*[F.lit(k) for k in TYPES]), (F.col("rec_id") % 5 + 1).cast("int"))
    p = pool(spark, sf_dir).select("rec_id", "p", kind.alias("predictionType"))
    r = S.format_result(p, "p", "predictionType").withColumn("contributors", F.lit(None).cast("array<string>"))
    out = T.insight_text(r)
    return out.select("rec_id", "title", "summary", "why", F.array_join("actions", "|").alias("actions"), "safetyNote",
                      "tone")


def _u_sql(key, tag):
    return (f"(CAST(('0x' || substr(md5(CAST({key} AS VARCHAR) || '#42#{tag}'), 1, 13))::BIGINT AS DOUBLE)"
            f" / 4503599627370496.0)")


@register("jitter0", f"""WITH {POOL}
SELECT rec_id, least(greatest(round_even(PHQ9 * (2.0 / 9.0), 0), 0.0), 6.0) AS PHQ2_noise0,
  least(greatest(round_even(PHQ9 * (2.0 / 9.0), 0) + (floor({_u_sql('rec_id', 'phq2')} * 3.0) - 1), 0.0), 6.0) AS PHQ2_jittered
FROM pool""")
def q_jitter0(spark, sf_dir):
    """Hash-derived +-1 jitter (reproducible); noise 0 leaves the value unchanged."""
    from ..functions import clip, half_even
    p = pool(spark, sf_dir)
    base = half_even(F.col("PHQ9") * (2 / 9))
    return p.select("rec_id", clip(base, 0, 6).alias("PHQ2_noise0"),
                    clip(base + integer_jitter("rec_id", 42, "phq2"), 0, 6).alias("PHQ2_jittered"))


# ------------------------------------------------------------------ J36: external validation
EV_RENAME = {"work_hours": "WorkHours", "sleep_hours": "SleepHours", "screen_time_hours": "ScreenTime",
             "burnout_score": "StressLevel", "meetings_count": "MeetingParticipation"}
EV_SCALE = ["StressLevel", "WorkHours", "SleepHours", "ScreenTime"]
# Stand-in models (fixed linear probabilities over the 0-10 rescaled columns); a
# trained bundle's probability columns take their place in production.
EV_INTEGRATED = ({"StressLevel": 0.06, "WorkHours": 0.02, "SleepHours": -0.02, "ScreenTime": 0.01}, 0.05)
EV_CLINICAL = ({"StressLevel": 0.05, "SleepHours": -0.01}, 0.1)


def _lin_sql(model) -> str:
    weights, b = model
    z = _lit(float(b))
    for c, w in weights.items():
        z = f"({z} + {_lit(float(w))} * {c})"
    return f"least(greatest({z}, CAST(0.01 AS DOUBLE)), CAST(0.99 AS DOUBLE))"


def _mm_sql(c):
    return f"CASE WHEN hi_{c} > lo_{c} THEN 10 * ({c} - lo_{c}) / (hi_{c} - lo_{c}) ELSE 5.0 END AS {c}"


def _external_sql(scenario, labelled):
    """Metrics of a scenario whose rows ``labelled`` selects: y, integ and the scaling columns."""
    return f"""WITH {POOL}, {labelled},
m AS (SELECT {', '.join(f'median({c}) AS med_{c}' for c in EV_SCALE)} FROM l),
f AS (SELECT y, integ, {', '.join(f'coalesce({c}, med_{c}) AS {c}' for c in EV_SCALE)} FROM l, m),
r AS (SELECT {', '.join(f'min({c}) AS lo_{c}, max({c}) AS hi_{c}' for c in EV_SCALE)} FROM f),
x AS (SELECT y, integ, {', '.join(_mm_sql(c) for c in EV_SCALE)} FROM f, r),
pr AS (SELECT y, integ, CASE WHEN integ THEN {_lin_sql(EV_INTEGRATED)} ELSE {_lin_sql(EV_CLINICAL)} END AS p0 FROM x),
b AS (SELECT '{scenario}' AS Scenario, y, round_even(p0, 4) AS p,
             CAST(p0 >= CASE WHEN integ THEN 0.5 ELSE 0.4 END AS INT) AS na,
             CASE WHEN integ THEN 'integrated' ELSE 'clinical' END AS sel FROM pr),
t AS (SELECT Scenario, p AS score, count_if(y = 1) AS pos, count_if(y <> 1) AS neg FROM b GROUP BY ALL),
c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY Scenario ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
         AS neg_below, sum(pos) OVER (PARTITION BY Scenario) AS P, sum(neg) OVER (PARTITION BY Scenario) AS N FROM t),
a AS (SELECT Scenario, CASE WHEN max(P) = 0 OR max(N) = 0 THEN 0.0
                            ELSE sum(pos * (neg_below + 0.5 * neg)) / (CAST(max(P) AS DOUBLE) * max(N)) END AS AUC
      FROM c GROUP BY Scenario),
g AS (SELECT Scenario, count_if(na = 1 AND y = 1) AS tp, count_if(na = 1 AND y <> 1) AS fp,
             count_if(na <> 1 AND y = 1) AS fn, avg(pow(p - y, 2)) AS Brier FROM b GROUP BY Scenario),
rt AS (SELECT Scenario, sel AS Routing FROM b GROUP BY Scenario, sel
       QUALIFY row_number() OVER (PARTITION BY Scenario ORDER BY count(*) DESC, sel) = 1)
SELECT g.Scenario, AUC, CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS Recall,
       CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS Precision, Brier, Routing
FROM g JOIN a ON g.Scenario = a.Scenario JOIN rt ON g.Scenario = rt.Scenario"""


@register("external_validation", _external_sql("Workplace_Generalization", f"""q AS (SELECT quantile_cont(StressLevel, 0.85) AS cut FROM pool),
l AS (SELECT CAST(coalesce(StressLevel >= cut, false) AS INT) AS y, MeetingParticipation IS NOT NULL AS integ,
             {', '.join(EV_SCALE)} FROM pool, q)"""))
def q_external_validation(spark, sf_dir):
    """Workplace scenario -- label at the 0.85 quantile of the raw score, then
    rename, 0-10 rescale, route and band, metrics (one row)."""
    raw = pool(spark, sf_dir).select(*[F.col(v).alias(k) for k, v in EV_RENAME.items()])
    cut = quantiles(raw, ["burnout_score"], [0.85]).first()[0]
    label = F.col("burnout_score") >= F.lit(cut)
    return M.external_validation(
        raw, label, "Workplace_Generalization", EV_SCALE,
        M.linear_scorer(*EV_INTEGRATED), M.linear_scorer(*EV_CLINICAL), rename=EV_RENAME)


# the second scenario brings worded stress, sleep quality and burnout level, and no integration column
EV_STUDENT = {"daily_study_hours": "WorkHours", "daily_sleep_hours": "SleepHours", "screen_time_hours": "ScreenTime",
              "stress_level": "StressLevel", "burnout_level": "RiskCategory"}
EV_WORDS = {"StressLevel": EXTERNAL_STRESS_WORDS, "SleepQuality": SLEEP_QUALITY_WORDS}


@register("external_psychological", _external_sql("Psychological_Generalization", f"""l AS (
  SELECT CAST(coalesce(upper(substr(trim(LevelText), 1, 1)) || lower(substr(trim(LevelText), 2)) = 'High', false) AS INT) AS y, false AS integ,
    coalesce({sql_map("upper(substr(trim(StressText), 1, 1)) || lower(substr(trim(StressText), 2))", EXTERNAL_STRESS_WORDS)}, 5.0) AS StressLevel,
    WorkHours, SleepHours, ScreenTime FROM pool)"""))
def q_external_psychological(spark, sf_dir):
    """Student scenario -- label from the worded burnout level, worded stress mapped before the rescale."""
    p = pool(spark, sf_dir)
    raw = p.select(F.col("WorkHours").alias("daily_study_hours"), F.col("SleepHours").alias("daily_sleep_hours"),
                   F.col("ScreenTime").alias("screen_time_hours"), F.col("StressText").alias("stress_level"),
                   F.col("LevelText").alias("burnout_level"), F.col("QualityText").alias("SleepQuality"))
    label = capitalize(F.trim("burnout_level")).isin(["High"])
    return M.external_validation(raw, label, "Psychological_Generalization", EV_SCALE, M.linear_scorer(*EV_INTEGRATED),
                                 M.linear_scorer(*EV_CLINICAL), rename=EV_STUDENT, words=EV_WORDS)


BLIND_FEATURES = ["StressLoad", "RecentStressSpike", "Age", "AcademicStress"]
BLIND_MODEL = ({"StressLoad": 0.03, "RecentStressSpike": 0.04, "Age": -0.005, "AcademicStress": 0.02}, 0.2)


@register("external_blind_stress", f"""WITH {POOL},
w AS (SELECT {sql_map("RemoteStressText", REMOTE_BURNOUT_WORDS)} AS s, CAST(SleepHours AS DOUBLE) AS h, CAST(Age AS DOUBLE) AS Age FROM pool),
f AS (SELECT CAST(coalesce(s >= 7.5, false) AS INT) AS y, coalesce(s, 5.0::DOUBLE) AS StressLoad, Age, 0.0::DOUBLE AS AcademicStress,
        coalesce(s, 5.0::DOUBLE) + least(greatest(8.0::DOUBLE - coalesce(h, 7.0::DOUBLE), 0.0::DOUBLE), 8.0::DOUBLE) AS RecentStressSpike FROM w),
p AS (SELECT y, {_lin_sql(BLIND_MODEL)} AS p FROM f),
t AS (SELECT p, count_if(y = 1) AS pos, count_if(y <> 1) AS neg FROM p WHERE p IS NOT NULL GROUP BY p),
c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM t),
a AS (SELECT CASE WHEN sum(pos) = 0 OR sum(neg) = 0 THEN 0.0
             ELSE sum(pos * (below + 0.5 * neg)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) END AS AUC FROM c),
g AS (SELECT count_if(p >= 0.5 AND y = 1) AS tp, count_if(p >= 0.5 AND y <> 1) AS fp, count_if(y = 1) AS pos, count(*) AS n FROM p)
SELECT AUC, CASE WHEN pos = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / pos END AS Recall,
       CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS Precision, n FROM a, g""")
def q_external_blind_stress(spark, sf_dir):
    """Blind stress audit -- worded stress, engineered load and spike, absent features 0."""
    raw = pool(spark, sf_dir).select(F.col("RemoteStressText").alias("Stress_Level"), F.col("SleepHours").alias("Sleep_Hours"), "Age")
    return M.blind_stress_audit(raw, REMOTE_BURNOUT_WORDS, BLIND_FEATURES, M.linear_scorer(*BLIND_MODEL))
