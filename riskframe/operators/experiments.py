"""Experiment harnesses over Spark ML fits (J37 ablation, J38 grid, J39 dual model, J40 build).

Each harness shares one cached, exactly split table across its fits and
returns a small metric DataFrame; metrics are distributed aggregations
(:mod:`.metrics`), so a scored test set is never collected.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as BL
from . import metrics as M
from .aggregates import group_median_fill
from .isotonic import IsotonicMap
from .prep import spread
from .splits import source_weight, stratified_split
from .train import Bundle, fits_in_blocks, soft_vote


def evaluate(scored: DataFrame, name: str, threshold: float, score: str = "p", label: str = "y",
             name_col: str = "model", **tags) -> DataFrame:
    """One metric row: n, AUC (ties half), recall, precision, F1, FPR, Brier at ``threshold``."""
    s = scored.select(F.lit(name).alias(name_col), F.col(score).alias("p"), F.col(label).cast("int").alias("y"))
    base = M.with_rates(s.groupBy(name_col).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"),
        *M._counts(F.col("p"), F.col("y"), F.lit(threshold))))
    auc = M.roc_auc(s, "p", "y", [name_col])
    out = base.join(auc, name_col).select(name_col, "n", "roc_auc", "recall", "precision", "f1", "fpr", "brier")
    return out.select(*[F.lit(v).alias(k) for k, v in tags.items()], "*")


def split_cached(df: DataFrame, key: str, label: str, strata: Sequence[str] = (), test_frac: float = 0.2,
                 seed: int = 42) -> DataFrame:
    """Exact stratified 80/20 split, materialised once for all fits of a harness.

    ``checkpoint()`` (to the shared ``spark.checkpoint.dir``) cuts the lineage,
    so a lost executor re-reads the split instead of recomputing it.  The parts are
    of bounded rows (:func:`.prep.spread`): every pass of a fit reads a part as one task.
    """
    return spread(stratified_split(df, key, [label, *strata], test_frac, seed), df.count()).checkpoint()


def ablation(df: DataFrame, key: str, label: str, variants: dict[str, Sequence[str]], kind: str = "gbt",
             threshold: float = 0.5, **params) -> DataFrame:
    """One fit per feature subset on the same split; one metric row per variant.  Boosted trees on more rows than one
    part are grown on blocks of bytes (:mod:`.blocks`), all variants in the same passes."""
    from .prep import MedianImputer, PopulationScaler
    data = split_cached(df, key, label)
    train, test = data.filter(~F.col("is_test")), data.filter(F.col("is_test"))
    # medians and scaler statistics are per column: fit them once over every feature
    every = sorted({f for feats in variants.values() for f in feats})
    imp = MedianImputer(every).fit(train)
    sc = PopulationScaler(every).fit(imp.transform(train))
    rows = []
    opts = {"maxIter": 30, "maxDepth": 4, "stepSize": 0.1, **params}
    if kind == "gbt" and fits_in_blocks(data, data.count(), label, opts, ("maxIter", "maxDepth", "stepSize"), opts["maxDepth"]):
        b = Bundle("all", every, label, kind, threshold, imputer=imp, scaler=sc)
        inputs, place = b._inputs(), {f: i for i, f in enumerate(every)}
        known = b.prepare(train)
        edges = BL.find_edges(known, inputs)
        trees = BL.boost(BL.pack(known, inputs, F.col(label), edges), [[place[f] for f in feats] for feats in variants.values()],
                         opts["maxIter"], opts["maxDepth"], opts["stepSize"])
        scored = BL.boosted_probabilities(b.prepare(test), inputs, edges, trees, opts["stepSize"], [label]).checkpoint()
        for i, (name, feats) in enumerate(variants.items()):
            rows.append(evaluate(scored.select(label, F.col("p")[i].alias("p")), name, threshold, label=label, name_col="variant",
                                 n_features=len(feats)))
        return reduce(DataFrame.unionByName, rows)
    for name, feats in variants.items():
        b = Bundle(name, list(feats), label, kind, threshold, params=params).fit(train, imputer=imp, scaler=sc)
        rows.append(evaluate(b.transform(test), name, threshold, label=label, name_col="variant",
                             n_features=len(feats)))
    return reduce(DataFrame.unionByName, rows)


def experiment_grid(variants: dict[str, DataFrame], holdouts: dict[str, DataFrame], features: Sequence[str],
                    label: str, kinds: dict[str, dict], threshold: float = 0.5, fill: float = 5.0) -> DataFrame:
    """Per variant pool a soft vote (J19) of the learners in ``kinds`` (kind -> parameters), scored on every
    hold-out (missing / bad values -> ``fill``)."""
    rows = []
    for vname, pool in variants.items():
        data = spread(pool, pool.count()).checkpoint()  # read by every learner and its statistics
        members = [Bundle(vname, list(features), label, kind, threshold, params=params).fit(data)
                   for kind, params in kinds.items()]
        for hname, hold in holdouts.items():
            h = hold.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(fill)) for c in features})
            rows.append(evaluate(soft_vote(h, members), vname, threshold, label=label, name_col="variant",
                                 holdout=hname))
    return reduce(DataFrame.unionByName, rows)


@dataclass
class SubModel:
    """One model of :func:`dual_model`: its features, its sources (None: all) and its weight per source."""
    features: Sequence[str]
    sources: Sequence[str] | None = None
    weights: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5


def dual_model(df: DataFrame, key: str, label: str, models: dict[str, SubModel], source: str = "DatasetSource",
               kind: str = "gbt", **params) -> tuple[dict[str, Bundle], DataFrame]:
    """One model per entry, each on its own sources, with gaps filled by the source's median (J1) and its own
    weights (J8).  Returns the bundles and one metric row per model over the held-out rows of its sources."""
    bundles, rows = {}, []
    for name, m in models.items():
        part = df if m.sources is None else df.filter(F.col(source).isin(list(m.sources)))
        gaps = [f for f in m.features if not f.endswith("_missing")]
        data = split_cached(source_weight(group_median_fill(part, gaps, source), m.weights, source), key, label, [source])
        b = Bundle(name, list(m.features), label, kind, m.threshold, params=params)
        bundles[name] = b.fit(data.filter(~F.col("is_test")), "sample_weight")
        rows.append(evaluate(b.transform(data.filter("is_test")), name, m.threshold, label=label))
    return bundles, reduce(DataFrame.unionByName, rows)


def save_calibrated(spark: SparkSession, members: Sequence[tuple[Bundle, object]], path: str) -> str:
    """Base bundles and their calibration maps as one saved model."""
    for i, (b, iso) in enumerate(members):
        b.save(spark, f"{path}/member_{i}")
        iso.save(f"{path}/calibrator_{i}")
    return path


def load_calibrated(spark: SparkSession, path: str, members: int) -> list[tuple[Bundle, object]]:
    """The members written by :func:`save_calibrated`, ready for ``calibrated_transform``."""
    return [(Bundle.load(spark, f"{path}/member_{i}"), IsotonicMap.load(spark, f"{path}/calibrator_{i}"))
            for i in range(members)]


def model_build(spark: SparkSession, df: DataFrame, key: str, label: str, features: Sequence[str],
                kind: str = "logreg", oversample: Callable[[DataFrame], DataFrame] | None = None,
                calibrate: bool = True, folds: int = 5, min_recall: float = 0.70, max_fpr: float = 0.25,
                sweep: Sequence[float] = tuple(i / 100 for i in range(5, 100, 5)), save_to: str | None = None,
                **params) -> DataFrame:
    """Split -> (oversample) -> fit (fold-calibrated) -> pick threshold on the test
    sweep (F5) -> evaluate -> (save the members with their calibration maps).  Returns the evaluation row with the
    chosen threshold and rule."""
    from .train import calibrated_transform, fold_calibrated
    data = split_cached(df, key, label)
    train, test = data.filter(~F.col("is_test")), data.filter(F.col("is_test"))
    if oversample is not None:
        # the oversampled set (kNN + replicas) feeds every fold's statistics and fit:
        # materialise it once on the shared checkpoint folder
        train = oversample(train).checkpoint()

    def make():
        return Bundle(f"{label}_{kind}", list(features), label, kind, params=params)

    if calibrate:
        members = fold_calibrated(train, make, key, folds)
        scored = calibrated_transform(test, members)
    else:
        members = [(make().fit(train), None)]
        scored = members[0][0].transform(test)
    scored = scored.select(F.col("p"), F.col(label).cast("int").alias("y")).checkpoint()
    pick = M.pick_threshold(M.threshold_sweep(scored, list(sweep)), min_recall, max_fpr).first()
    t = float(pick["threshold"]) if pick is not None and pick["threshold"] is not None else 0.5
    rule = pick["rule"] if pick is not None and "rule" in pick.asDict() else "none"
    if save_to:
        for b, _ in members:
            b.threshold = t
        if calibrate:
            save_calibrated(spark, members, save_to)
        else:
            members[0][0].save(spark, f"{save_to}/member_0")
    return evaluate(scored, f"{label}_{kind}", t, chosen_threshold=t, rule=rule)
