"""Evaluation metrics (J25-J36) as aggregations over (score, label[, group]).

Scale rules:
* confusion counts, sweeps, Brier and reliability are single-pass partial
  aggregations (one scan for every threshold / bin / source);
* AUC and curve points never run a global window over raw rows: rows are
  first collapsed to one row per distinct score (partial aggregation), then a
  two-level prefix sum runs -- bucket totals over a small table, and an
  in-bucket window partitioned by score range.  A hot score value collapses
  to one row in the first step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import map_lookup, numeric_col
from .ranks import before_in_order, in_ranges, null_safe

DEFAULT_SWEEP = [0.25, 0.30, 0.35, 0.40, 0.45, 0.50]


def _counts(p: Column, y: Column, t) -> list[Column]:
    pred = p >= t
    pos = y == 1
    return [F.count_if(pred & pos).alias("tp"), F.count_if(pred & ~pos).alias("fp"),
            F.count_if(~pred & ~pos).alias("tn"), F.count_if(~pred & pos).alias("fn")]


def confusion(df: DataFrame, threshold: float = 0.5, score: str = "p", label: str = "y",
              by: Sequence[str] = ()) -> DataFrame:
    """Tp / fp / tn / fn at ``score >= threshold`` (one aggregation)."""
    cols = _counts(F.col(score), F.col(label), F.lit(threshold))
    return df.groupBy(*by).agg(*cols) if by else df.agg(*cols)


def _div0(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def with_rates(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1, FPR from confusion counts; 0 on zero division."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision = _div0(tp, tp + fp)
    recall = _div0(tp, tp + fn)
    return counts.withColumns({
        "accuracy": _div0(tp + tn, tp + fp + tn + fn),
        "precision": precision,
        "recall": recall,
        "f1": _div0(2 * tp, 2 * tp + fp + fn),
        "fpr": _div0(fp, fp + tn),
    })


def metrics_at(df: DataFrame, threshold: float = 0.5, score: str = "p", label: str = "y",
               by: Sequence[str] = ()) -> DataFrame:
    return with_rates(confusion(df, threshold, score, label, by))


def threshold_sweep(df: DataFrame, thresholds: Sequence[float] = DEFAULT_SWEEP, score: str = "p",
                    label: str = "y") -> DataFrame:
    """Metrics for every threshold from ONE scan (2 x n conditional sums), long form."""
    p, y = F.col(score), F.col(label)
    aggs = []
    for i, t in enumerate(thresholds):
        pred = p >= float(t)
        aggs += [F.count_if(pred & (y == 1)).alias(f"tp_{i}"), F.count_if(pred & (y != 1)).alias(f"fp_{i}"),
                 F.count_if(~pred & (y != 1)).alias(f"tn_{i}"), F.count_if(~pred & (y == 1)).alias(f"fn_{i}")]
    wide = df.agg(*aggs)
    rows = ", ".join(f"CAST({float(t)!r} AS DOUBLE), tp_{i}, fp_{i}, tn_{i}, fn_{i}" for i, t in enumerate(thresholds))
    long = wide.selectExpr(f"stack({len(thresholds)}, {rows}) AS (threshold, tp, fp, tn, fn)")
    return with_rates(long)


def pick_threshold(sweep: DataFrame, min_recall: float = 0.70, max_fpr: float = 0.25) -> DataFrame:
    """recall >= .70 and FPR <= .25 -> highest recall; else recall >= .70 -> lowest FPR.

    Returns one row with ``rule`` naming the branch taken, or a status row
    (``rule = 'none'``) when no threshold reaches the recall floor.
    """
    ok = sweep.filter((F.col("recall") >= min_recall) & (F.col("fpr") <= max_fpr))
    first = ok.orderBy(F.col("recall").desc(), F.col("threshold")).limit(1).withColumn("rule", F.lit("recall_and_fpr"))
    fallback = (sweep.filter(F.col("recall") >= min_recall).orderBy(F.col("fpr").asc(), F.col("threshold"))
                .limit(1).withColumn("rule", F.lit("recall_only")))
    both = first.unionByName(fallback).withColumn("_o", F.when(F.col("rule") == "recall_and_fpr", 0).otherwise(1))
    return both.orderBy("_o").limit(1).drop("_o")


# ------------------------------------------------------------------ ranking metrics
def score_table(df: DataFrame, score: str = "p", label: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """One row per (group, distinct score) with positive / negative counts (partial aggregation).
    Rows without a score or a label rank nowhere and count for neither class."""
    y = F.col(label)
    return df.where(F.col(score).isNotNull() & y.isNotNull()).groupBy(*by, F.col(score).alias("score")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y != 1).alias("neg"))


def cumulative(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Exact prefix sums of pos / neg over scores DESCENDING, two-level.

    Ranges follow (group, score), so a large group or one with a narrow score range is
    spread as well.  Within a range a window orders only its distinct scores.  Adds
    ``pos_above`` and ``neg_above`` (strictly higher scores), plus group totals ``P`` and ``N``.
    """
    by = list(by)
    s = in_ranges(scores, by, "score")
    keys = [*by, "_range"]
    sums = s.groupBy(*keys).agg(F.sum("pos").alias("_bp"), F.sum("neg").alias("_bn"), F.max("score").alias("_top"))
    sums = before_in_order(sums, by, "_top", ["_bp", "_bn"], descending=True).drop("_bp", "_bn", "_top")
    within = Window.partitionBy(*keys).orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding,
                                                                                Window.currentRow)
    inner = s.select("*", (F.sum("pos").over(within) - F.col("pos")).alias("_ip"),
                     (F.sum("neg").over(within) - F.col("neg")).alias("_in"))
    out = null_safe(inner, sums, keys)
    return out.select(*by, "score", "pos", "neg", (F.col("_bp_before") + F.col("_ip")).alias("pos_above"),
                      (F.col("_bn_before") + F.col("_in")).alias("neg_above"),
                      F.col("_bp_total").alias("P"), F.col("_bn_total").alias("N"))


def roc_auc(df: DataFrame, score: str = "p", label: str = "y", by: Sequence[str] = (),
            single_class=None) -> DataFrame:
    """ROC-AUC with ties counted half (Mann-Whitney), per group when ``by``.

    A group with one class gets ``single_class`` (NULL by default; the
    reference uses NaN, 0.0 or 0.5 depending on the script).
    """
    cum = cumulative(score_table(df, score, label, by), by)
    # each positive beats every negative with a lower score, ties count half
    neg_below = F.col("N") - F.col("neg_above") - F.col("neg")
    part = F.col("pos") * (neg_below + 0.5 * F.col("neg"))
    g = cum.groupBy(*by).agg(F.sum(part).alias("_u"), F.first("P").alias("P"), F.first("N").alias("N"))
    auc = F.when((F.col("P") == 0) | (F.col("N") == 0), F.lit(single_class).cast("double")) \
        .otherwise(F.col("_u") / (F.col("P").cast("double") * F.col("N")))
    return g.select(*by, auc.alias("roc_auc"))


def roc_points(df: DataFrame, score: str = "p", label: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """(threshold, tpr, fpr) at every distinct score (no intermediate-point dropping)."""
    cum = cumulative(score_table(df, score, label, by), by)
    tp = F.col("pos_above") + F.col("pos")
    fp = F.col("neg_above") + F.col("neg")
    return cum.select(*by, F.col("score").alias("threshold"), _div0(tp, F.col("P")).alias("tpr"),
                      _div0(fp, F.col("N")).alias("fpr"))


def pr_points(df: DataFrame, score: str = "p", label: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """(threshold, precision, recall) at every distinct score."""
    cum = cumulative(score_table(df, score, label, by), by)
    tp = F.col("pos_above") + F.col("pos")
    fp = F.col("neg_above") + F.col("neg")
    return cum.select(*by, F.col("score").alias("threshold"), _div0(tp, tp + fp).alias("precision"),
                      _div0(tp, F.col("P")).alias("recall"))


def auc_ovr(df: DataFrame, label: str, score_cols: dict, by: Sequence[str] = ()) -> DataFrame:
    """Macro one-vs-rest AUC: mean over classes of AUC(score_c, label == c).

    The class scores are stacked into one long table so all classes share one
    pass of the two-level prefix sum.
    """
    pairs = ", ".join(f"{int(c)}, CAST(`{s}` AS DOUBLE)" for c, s in score_cols.items())
    long = df.selectExpr(*[f"`{b}`" for b in by], f"`{label}` AS _y",
                         f"stack({len(score_cols)}, {pairs}) AS (_cls, _score)")
    long = long.withColumn("_yc", (F.col("_y") == F.col("_cls")).cast("int"))
    per = roc_auc(long, "_score", "_yc", [*by, "_cls"])
    return per.groupBy(*by).agg(F.avg("roc_auc").alias("auc_ovr"))


def brier(df: DataFrame, score: str = "p", label: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Mean squared error of the probability."""
    b = F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier")
    return df.groupBy(*by).agg(b) if by else df.agg(b)


# Inner bin edges exactly as numpy ``linspace(0, 1, n + 1)`` produces them.
def uniform_edges(n_bins: int) -> list[float]:
    step = 1.0 / n_bins
    return [i * step for i in range(1, n_bins)]


def reliability(df: DataFrame, n_bins: int = 10, score: str = "p", label: str = "y") -> DataFrame:
    """Calibration curve, equal-width bins with (a, b] edges; empty bins absent."""
    b = F.lit(0)
    for e in uniform_edges(n_bins):
        b = b + (F.col(score) > F.lit(e)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.avg(F.col(score)).alias("prob_pred"),
                                          F.avg(F.col(label).cast("double")).alias("prob_true"),
                                          F.count(F.lit(1)).alias("n"))


def prob_hist(df: DataFrame, n_bins: int = 25, score: str = "p", label: str = "y") -> DataFrame:
    """Per-class histogram over common equal-width bins spanning [min, max].

    min / max come from one aggregation (two numbers on the driver)."""
    row = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi")).first()
    lo, hi = float(row["lo"]), float(row["hi"])
    width = (hi - lo) / n_bins if hi > lo else 1.0
    idx = F.least(F.floor((F.col(score) - lo) * (n_bins / (hi - lo if hi > lo else 1.0))), F.lit(n_bins - 1)).cast("int")
    out = df.groupBy(F.col(label).alias("label"), idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return out.withColumns({"bin_lo": F.lit(lo) + F.col("bin") * width, "bin_hi": F.lit(lo) + (F.col("bin") + 1) * width})


def class_report(df: DataFrame, label: str = "y", pred: str = "pred") -> DataFrame:
    """Per-class precision / recall / F1 / support from one (label, pred) count table."""
    cm = df.groupBy(F.col(label).alias("_y"), F.col(pred).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    classes = cm.select(F.col("_y").alias("cls")).union(cm.select(F.col("_p").alias("cls"))).distinct()
    tp = cm.filter(F.col("_y") == F.col("_p")).select(F.col("_y").alias("cls"), F.col("_n").alias("tp"))
    support = cm.groupBy(F.col("_y").alias("cls")).agg(F.sum("_n").alias("support"))
    predicted = cm.groupBy(F.col("_p").alias("cls")).agg(F.sum("_n").alias("predicted"))
    r = classes.join(tp, "cls", "left").join(support, "cls", "left").join(predicted, "cls", "left").fillna(
        0, ["tp", "support", "predicted"])
    precision = _div0(F.col("tp"), F.col("predicted"))
    recall = _div0(F.col("tp"), F.col("support"))
    return r.select("cls", precision.alias("precision"), recall.alias("recall"),
                    _div0(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"),
                    F.col("support").cast("long").alias("support"))


def source_audit(df: DataFrame, threshold: float = 0.65, source: str = "DatasetSource", score: str = "p",
                 label: str = "y", min_n: int = 10, single_class_auc=None) -> DataFrame:
    """Per source n, positive rate, recall, precision, AUC, FPR, Brier (one pass per metric family)."""
    y = F.col(label)
    base = df.groupBy(source).agg(
        F.count(F.lit(1)).alias("records"), F.avg(y.cast("double")).alias("positive_rate"),
        F.avg(F.pow(F.col(score) - y, 2)).alias("brier"), *_counts(F.col(score), y, F.lit(threshold)))
    rates = with_rates(base).drop("accuracy", "f1")
    auc = roc_auc(df, score, label, [source], single_class_auc)
    out = rates.join(auc, on=source, how="left").filter(F.col("records") >= min_n)
    return out.select(source, "records", "positive_rate", "recall", "precision", "roc_auc", "fpr", "brier")


def rank_models(table: DataFrame, keys: Sequence[str] = ("recall", "f1", "roc_auc"), name: str = "model") -> DataFrame:
    """F2: order a model summary by Recall, F1, ROC-AUC (descending), with the rank."""
    w = Window.orderBy(*[F.col(k).desc() for k in keys], F.col(name))
    return table.withColumn("rank", F.row_number().over(w))


# ------------------------------------------------------------------ J36: external validation
def linear_scorer(weights: dict[str, float], intercept: float, lo: float = 0.01, hi: float = 0.99) -> Column:
    """A fixed linear probability clipped to [lo, hi] (plain IEEE arithmetic, left to right)."""
    z = F.lit(intercept)
    for c, w in weights.items():
        z = z + F.lit(w) * F.col(c)
    return F.least(F.greatest(z, F.lit(lo)), F.lit(hi))


def external_validation(df: DataFrame, label: Column, scenario: str, scale: Sequence[str],
                        prob_integrated: Column, prob_clinical: Column, rename: dict | None = None,
                        words: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Audit one external scenario end to end.

    The ground-truth label is computed on the raw columns *before* renaming
    (as the reference does), then worded columns are mapped, the scaling columns are numeric-coerced,
    median-filled and min-max rescaled to 0-10 (H9), each row is routed to
    the integrated or clinical model and banded (K5), and one row of metrics
    comes back: AUC (0.0 when only one class is present), recall and
    precision of ``needs_attention``, Brier of the rounded probability, and
    the most frequent routing (ties to the first name).  Every step is an
    aggregation or a projection; only the per-column statistics reach the
    driver.
    """
    from .aggregates import minmax10
    from .schema import rename_map
    from .score import route_and_band
    x = df.withColumn("GroundTruthLabel", F.coalesce(label, F.lit(False)).cast("int"))
    if rename:
        x = rename_map(x, rename)
    x = minmax10(x, [c for c in scale if c in x.columns], words)
    x = x.withColumns({"_p_int": prob_integrated, "_p_cli": prob_clinical})
    r = route_and_band(x, "_p_int", "_p_cli").select(
        F.lit(scenario).alias("Scenario"), F.col("GroundTruthLabel").alias("y"),
        F.col("burnout_probability").alias("p"), "needs_attention", "selected_model")
    y, pred = F.col("y"), F.col("needs_attention") == 1
    tp, fp, fn = F.count_if(pred & (y == 1)), F.count_if(pred & (y != 1)), F.count_if(~pred & (y == 1))
    base = r.groupBy("Scenario").agg(
        _div0(tp, tp + fn).alias("Recall"), _div0(tp, tp + fp).alias("Precision"),
        F.avg(F.pow(F.col("p") - y, 2)).alias("Brier"),
        F.mode("selected_model", deterministic=True).alias("Routing"))
    auc = roc_auc(r, "p", "y", ["Scenario"], single_class=0.0).withColumnRenamed("roc_auc", "AUC")
    # one row per scenario on each side: merge by aggregation (no join on the literal key)
    both = base.unionByName(auc, allowMissingColumns=True)
    return both.groupBy("Scenario").agg(*[F.max(c).alias(c) for c in ("AUC", "Recall", "Precision", "Brier",
                                                                     "Routing")])


def blind_stress_audit(df: DataFrame, words: dict[str, float], features: Sequence[str], probability: Column,
                       severe: float = 7.5, threshold: float = 0.5) -> DataFrame:
    """J36, blind test: one row (AUC, Recall, Precision, n) of a stress model on a set it has never seen.

    ``df`` has Stress_Level (a word), Sleep_Hours and Age.  The word is mapped exactly as it stands; the truth is mapped
    stress at or above ``severe`` (an unknown word: 0).  Load and recent spike are made of it with 5 and 7 for missing
    stress and sleep, and features of the model that the set does not have are 0.  ``probability`` is an expression over
    ``features``; a row without one counts as not flagged and is left out of the AUC.
    """
    x = df.select(map_lookup(words, "Stress_Level").alias("WorkStress"),
                  numeric_col(df, "Sleep_Hours").cast("double").alias("SleepHours"),
                  numeric_col(df, "Age").cast("double").alias("Age"))
    load = F.coalesce("WorkStress", F.lit(5.0))
    short = F.least(F.greatest(8.0 - F.coalesce("SleepHours", F.lit(7.0)), F.lit(0.0)), F.lit(8.0))
    x = x.withColumns({"Target": F.coalesce(F.col("WorkStress") >= severe, F.lit(False)).cast("int"), "StressLoad": load,
                       "RecentStressSpike": load + short})
    x = x.withColumns({f: F.lit(0.0) for f in features if f not in x.columns})
    r = x.select("Target", probability.alias("p"))
    y, flag = F.col("Target") == 1, F.coalesce(F.col("p") >= threshold, F.lit(False))
    tp, fp, fn = F.count_if(flag & y), F.count_if(flag & ~y), F.count_if(~flag & y)
    base = r.agg(_div0(tp, tp + fn).alias("Recall"), _div0(tp, tp + fp).alias("Precision"), F.count(F.lit(1)).alias("n"))
    auc = roc_auc(r, "p", "Target", single_class=0.0).select(F.col("roc_auc").alias("AUC"))
    both = base.unionByName(auc, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("AUC", "Recall", "Precision", "n")])
