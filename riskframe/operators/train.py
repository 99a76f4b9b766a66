"""Model training, calibration, selection and bundles.

Everything heavy is a Spark ML fit or a DataFrame aggregation over the
executors; the driver holds only parameters, fitted coefficients / trees and
small metric tables.  A :class:`Bundle` keeps the exact median imputer, the
population scaler, the ordered feature list, the threshold and the fitted
``PipelineModel`` together, and saves / loads them as one directory on shared
storage (Spark writers only; nothing is written from the driver's disk).
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import Imputer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import blocks as BL
from .isotonic import isotonic_fit
from .prep import ROWS_PER_TASK, MedianImputer, PopulationScaler, spread

CLASSIFIERS = {
    "logreg": lambda **p: LogisticRegression(**{"maxIter": 100, **p}),
    "forest": lambda **p: RandomForestClassifier(**{"numTrees": 50, "maxDepth": 8, "seed": 42, **p}),
    "gbt": lambda **p: GBTClassifier(**{"maxIter": 30, "maxDepth": 4, "stepSize": 0.1, "seed": 42, **p}),
    "mlp": lambda **p: MultilayerPerceptronClassifier(**{"maxIter": 100, "seed": 42, **p}),
}


def classifier(kind: str, label: str = "label", features: str = "features", weight: str | None = None,
               prefix: str = "", **params):
    """A Spark ML classifier by name with our column conventions."""
    est = CLASSIFIERS[kind](labelCol=label, featuresCol=features, predictionCol=f"{prefix}prediction", **params)
    extra = {"rawPredictionCol": f"{prefix}rawPrediction", "probabilityCol": f"{prefix}probability"}
    if weight:
        extra["weightCol"] = weight
    for name, value in extra.items():
        if not est.hasParam(name):
            if name == "weightCol":
                raise ValueError(f"{kind} does not take sample weights")
            continue
        est.set(est.getParam(name), value)
    return est


def positive_prob(prob_col: str = "probability", cls: int = 1) -> Column:
    """Class-``cls`` probability out of a probability vector column (K2)."""
    return vector_to_array(F.col(prob_col))[cls]


def as_vector(df: DataFrame, array_col: str, out: str = "features") -> DataFrame:
    """FB7 helper: array<float> embedding -> ML vector."""
    return df.withColumn(out, array_to_vector(F.col(array_col).cast("array<double>")))


@dataclass
class Bundle:
    """Model + imputer + scaler + ordered features + threshold + version."""
    name: str
    features: list[str]
    label: str
    kind: str
    threshold: float = 0.5
    version: str = "1"
    imputer: MedianImputer | None = None
    scaler: PopulationScaler | None = None
    model: PipelineModel | None = None
    params: dict = field(default_factory=dict)

    # ---------------------------------------------------------------- fit / score
    def _inputs(self) -> list[str]:
        return [f"__x_{c}" for c in self.features]

    def prepare(self, df: DataFrame) -> DataFrame:
        """Impute and scale exactly the bundle's features, in order (B17), into private
        ``__x_*`` columns: the caller's columns are never overwritten, so several
        bundles can score the same rows in one pass."""
        missing = [c for c in self.features if c not in df.columns]
        if missing:
            raise ValueError(f"{self.name}: missing features {missing}")
        out = {}
        for c, name in zip(self.features, self._inputs()):
            x = F.col(c).cast("double")
            if self.imputer is not None:
                x = F.coalesce(x, F.lit(self.imputer.medians.get(c)).cast("double"))
            if self.scaler is not None:
                mean, std = self.scaler.stats[c]
                x = (x - F.lit(mean).cast("double")) / (1.0 if (std is None or std == 0) else float(std))
            out[name] = x
        return df.withColumns(out)

    def fit(self, df: DataFrame, weight: str | None = None, imputer: MedianImputer | None = None,
            scaler: PopulationScaler | None = None) -> "Bundle":
        """Fit on ``df``.  ``imputer`` / ``scaler`` fitted earlier on the same rows over a
        superset of the features are reused (per-column statistics, so the subset is exact)."""
        if imputer is not None and scaler is not None:
            self.imputer = MedianImputer(self.features, medians={c: imputer.medians[c] for c in self.features})
            self.scaler = PopulationScaler(self.features, stats={c: scaler.stats[c] for c in self.features})
        else:
            self.imputer = MedianImputer(self.features).fit(df)
            self.scaler = PopulationScaler(self.features).fit(self.imputer.transform(df))
        params = dict(self.params)
        if self.kind == "mlp" and "layers" not in params:
            params["layers"] = [len(self.features), 32, 16, 2]
        pipe = Pipeline(stages=[
            VectorAssembler(inputCols=self._inputs(), outputCol="features", handleInvalid="keep"),
            classifier(self.kind, self.label, "features", weight, **params)])
        # iterative learners re-read their input every pass: keep only the prepared
        # columns, persisted for the duration of the fit (recomputable from lineage)
        keep = [*self._inputs(), self.label, *([weight] if weight else [])]
        data = self.prepare(df).select(*keep).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            self.model = pipe.fit(data)
        finally:
            data.unpersist()
        return self

    def raw_transform(self, df: DataFrame) -> DataFrame:
        """The model's own output columns (features, rawPrediction, probability, prediction)."""
        return self.model.transform(self.prepare(df)).drop(*self._inputs())

    def transform(self, df: DataFrame, out: str = "p") -> DataFrame:
        """K2: ``df`` plus the plain class-1 probability and the 0/1 decision at the threshold."""
        scored = self.raw_transform(df).withColumn(out, positive_prob())
        scored = scored.drop("features", "rawPrediction", "probability", "prediction")
        return scored.withColumn("needs_attention", (F.col(out) >= self.threshold).cast("int"))

    # ---------------------------------------------------------------- persistence
    def meta(self) -> dict:
        return {"name": self.name, "features": self.features, "label": self.label, "kind": self.kind,
                "threshold": self.threshold, "version": self.version, "params": self.params,
                "medians": self.imputer.medians if self.imputer else None,
                "scaler": {c: list(v) for c, v in self.scaler.stats.items()} if self.scaler else None}

    def save(self, spark: SparkSession, path: str) -> str:
        """Write the bundle atomically enough for re-runs: model, then metadata (one JSON row)."""
        self.model.write().overwrite().save(f"{path}/model")
        spark.createDataFrame([(json.dumps(self.meta()),)], "meta string").coalesce(1) \
            .write.mode("overwrite").text(f"{path}/meta")
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Bundle":
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        b = cls(meta["name"], meta["features"], meta["label"], meta["kind"], meta["threshold"], meta["version"],
                params=meta.get("params") or {})
        if meta.get("medians") is not None:
            b.imputer = MedianImputer(b.features, medians=meta["medians"])
        if meta.get("scaler") is not None:
            b.scaler = PopulationScaler(b.features, stats={c: tuple(v) for c, v in meta["scaler"].items()})
        b.model = PipelineModel.load(f"{path}/model")
        return b


def registry_table(spark: SparkSession, bundles: Sequence[Bundle], paths: Sequence[str]) -> DataFrame:
    """One row per model: name, version, threshold, feature count, location."""
    rows = [(b.name, b.version, float(b.threshold), len(b.features), p) for b, p in zip(bundles, paths)]
    return spark.createDataFrame(rows, "model string, version string, threshold double, n_features int, path string")


# -------------------------------------------------------------------- J19: soft vote
def soft_vote(df: DataFrame, bundles: Sequence[Bundle], out: str = "p") -> DataFrame:
    """Average the class-1 probability of several bundles in one pass over ``df``."""
    x = df
    for i, b in enumerate(bundles):
        x = b.transform(x, out=f"_p{i}").drop("needs_attention")
    total = F.col("_p0")
    for i in range(1, len(bundles)):
        total = total + F.col(f"_p{i}")
    return x.withColumn(out, total / len(bundles)).drop(*[f"_p{i}" for i in range(len(bundles))])


# -------------------------------------------------------------------- J21 / J22: calibration
def fold_id(key: str, folds: int, seed: int = 42) -> Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit("fold")), F.lit(folds))


def fold_calibrated(df: DataFrame, make: Callable[[], Bundle], key: str, folds: int = 5, seed: int = 42,
                    weight: str | None = None) -> list[tuple[Bundle, object]]:
    """Per fold fit the base bundle on the other folds and an isotonic map on
    the held-out fold's scores; prediction = mean over folds (as ``cv=5`` calibration)."""
    x = df.withColumn("_fold", fold_id(key, folds, seed))
    out = []
    for f in range(folds):
        b = make().fit(x.filter(F.col("_fold") != f), weight)
        held = b.transform(x.filter(F.col("_fold") == f)).select("p", F.col(b.label).alias("y"))
        out.append((b, isotonic_fit(held)))
    return out


def calibrated_transform(df: DataFrame, members: Sequence[tuple[Bundle, object]], out: str = "p") -> DataFrame:
    x = df
    for i, (b, iso) in enumerate(members):
        s = b.transform(x, out="_raw").drop("needs_attention")
        x = iso.setFeaturesCol("_raw").setPredictionCol(f"_c{i}").transform(s).drop("_raw")
    total = F.col("_c0")
    for i in range(1, len(members)):
        total = total + F.col(f"_c{i}")
    return x.withColumn(out, total / len(members)).drop(*[f"_c{i}" for i in range(len(members))])


# -------------------------------------------------------------------- fits of more than one part
def fits_in_blocks(df: DataFrame, n: int, label: str, params: Sequence[str], taken: Sequence[str], depth: int) -> bool:
    """Whether a fit on the ``n`` rows of ``df`` is grown on blocks of bytes (:mod:`.blocks`): more rows than one part, labels
    of 0 and 1 alone, parameters among ``taken``.  Small fits stay with Spark ML."""
    if n <= ROWS_PER_TASK or depth > BL.DEEPEST or not set(params) <= set(taken):
        return False
    y = F.col(label)
    return df.agg(F.count_if(y.isNull() | ~y.isin(0, 1))).first()[0] == 0


# -------------------------------------------------------------------- J12 / J13: importance and RFE
def forest_importance(spark: SparkSession, df: DataFrame, features: Sequence[str], label: str,
                      **params) -> DataFrame:
    """Random-forest impurity importances as a (feature, importance, rank) table."""
    b = Bundle("forest_importance", list(features), label, "forest", params=params).fit(spread(df, df.count()))
    imp = b.model.stages[-1].featureImportances.toArray().tolist()
    rows = sorted(zip(features, imp), key=lambda t: (-t[1], t[0]))
    return spark.createDataFrame([(f, float(v), i + 1) for i, (f, v) in enumerate(rows)],
                                 "feature string, importance double, rank int")


def recursive_elimination(spark: SparkSession, df: DataFrame, features: Sequence[str], label: str,
                          n_select: int, step: int = 1, **params) -> DataFrame:
    """Refit a forest and drop the ``step`` least important features until ``n_select`` remain.

    The assembled training vectors are cached once; each round slices them.  More rows than one part are binned once
    instead, and each round grows its forest on the blocks (:mod:`.blocks`).
    Returns (feature, selected, eliminated_round) -- round 0 means kept.
    """
    imp = MedianImputer(list(features)).fit(df)
    n = df.count()
    opts = {"numTrees": 50, "maxDepth": 8, "minInstancesPerNode": 1, "seed": 42, **params}
    in_blocks = fits_in_blocks(df, n, label, opts, ("numTrees", "maxDepth", "minInstancesPerNode", "seed"), opts["maxDepth"])
    if in_blocks:
        filled = imp.transform(df)
        data = BL.pack(spread(filled, n), features, F.col(label), BL.find_edges(filled, features))
    else:
        data = VectorAssembler(inputCols=list(features), outputCol="all", handleInvalid="keep").transform(
            imp.transform(spread(df, n))).select("all", F.col(label).cast("double").alias("label")).cache()
    alive = list(range(len(features)))
    dropped: dict[str, int] = {}
    rnd = 0
    try:
        while len(alive) > n_select:
            rnd += 1
            if in_blocks:
                trees = BL.forest(data, alive, opts["numTrees"], opts["maxDepth"], [opts["minInstancesPerNode"]], opts["seed"])[0]
                scores = BL.importances(trees, len(features))[alive].tolist()
            else:
                sliced = VectorSlicer(inputCol="all", outputCol="features", indices=alive).transform(data)
                m = classifier("forest", "label", "features", **params).fit(sliced)
                scores = m.featureImportances.toArray().tolist()
            order = sorted(range(len(alive)), key=lambda j: (scores[j], features[alive[j]]))
            cut = order[:min(step, len(alive) - n_select)]
            for j in cut:
                dropped[features[alive[j]]] = rnd
            alive = [a for j, a in enumerate(alive) if j not in set(cut)]
    finally:
        data.unpersist()
    rows = [(f, f not in dropped, dropped.get(f, 0)) for f in features]
    return spark.createDataFrame(rows, "feature string, selected boolean, eliminated_round int")


# -------------------------------------------------------------------- J24: randomised search
def sample_params(space: dict[str, list], n_iter: int, seed: int = 42) -> list[dict]:
    """Draw ``n_iter`` parameter sets from lists of candidate values (seeded, driver-side metadata)."""
    rng = random.Random(seed)
    keys = sorted(space)
    return [{k: rng.choice(space[k]) for k in keys} for _ in range(n_iter)]


def random_search(spark: SparkSession, df: DataFrame, features: Sequence[str], label: str, kind: str,
                  space: dict[str, list], n_iter: int = 10, folds: int = 3, seed: int = 42,
                  parallelism: int = 4, key: str = "rec_id") -> DataFrame:
    """Sampled parameter maps, ``folds``-fold cross validation scored by positive-class recall.

    Folds come from a hash of ``key``, so they do not move with the partitioning.  Missing values take the (sketched)
    median of the fold's training rows, found once per fold: all trials of a fold are fitted on the same vectors.
    Forests on more rows than one part are grown on blocks of bytes (:mod:`.blocks`), all trials of a fold together.
    Returns (trial, params_json, mean_recall, rank)."""
    x = df.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("label"),
                  F.coalesce(fold_id(key, folds, seed), F.lit(0)).cast("int").alias("_fold"))
    n = df.count()
    filled = [f"_filled_{i}" for i in range(len(features))]
    imputer = Imputer(inputCols=list(features), outputCols=filled, strategy="median", relativeError=0.0001)
    trials = sample_params(space, n_iter, seed)
    taken = ("numTrees", "maxDepth", "minInstancesPerNode")
    if kind == "forest" and fits_in_blocks(x, n, "label", list(space), taken, max(t.get("maxDepth", 8) for t in trials)):
        metrics = _recalls_in_blocks(x, n, imputer, filled, [{"numTrees": 50, "maxDepth": 8, "minInstancesPerNode": 1, **t} for t in trials], folds)
        return _ranked_trials(spark, trials, metrics)
    x = spread(x, n).persist(StorageLevel.MEMORY_AND_DISK)
    est = classifier(kind, "label", "features")
    assembler = VectorAssembler(inputCols=filled, outputCol="features", handleInvalid="keep")
    maps = [{est.getParam(k): v for k, v in t.items()} for t in trials]
    ev = MulticlassClassificationEvaluator(labelCol="label", metricName="recallByLabel", metricLabel=1.0)
    metrics = np.zeros((folds, len(trials)))
    try:
        for fold in range(folds):
            parts = x.where(F.col("_fold") != fold), x.where(F.col("_fold") == fold)
            for part, what in zip(parts, ("training", "validation")):
                if part.isEmpty():
                    raise ValueError(f"The {what} data at fold {fold} is empty.")
            # the medians come from the fold's own training rows
            fill = imputer.fit(parts[0])
            train, held = (assembler.transform(fill.transform(part)).select("features", "label").persist(StorageLevel.MEMORY_AND_DISK)
                           for part in parts)
            fits = est.fitMultiple(train, maps)

            def tried(_, fits=fits, held=held):
                i, model = next(fits)
                return i, ev.evaluate(model.transform(held))

            try:
                with ThreadPool(min(parallelism, len(maps))) as threads:
                    for i, metric in threads.imap_unordered(inheritable_thread_target(spark)(tried), range(len(maps))):
                        metrics[fold, i] = metric
            finally:
                train.unpersist()
                held.unpersist()
    finally:
        x.unpersist()
    return _ranked_trials(spark, trials, metrics)


def _recalls_in_blocks(x: DataFrame, n: int, imputer: Imputer, filled: Sequence[str], trials: Sequence[dict], folds: int) -> np.ndarray:
    """(fold, trial) recalls of forests.  Trials that differ in trees and depth alone are parts of one forest, since its draws
    depend on neither."""
    least = sorted({t["minInstancesPerNode"] for t in trials})
    most, deepest = max(t["numTrees"] for t in trials), max(t["maxDepth"] for t in trials)
    metrics = np.zeros((folds, len(trials)))
    for fold in range(folds):
        held = F.col("_fold") == fold
        counts = x.agg(F.count_if(~held), F.count_if(held)).first()
        for size, what in zip(counts, ("training", "validation")):
            if not size:
                raise ValueError(f"The {what} data at fold {fold} is empty.")
        # the medians and cut points come from the fold's own training rows
        fill = imputer.fit(x.where(~held))
        edges = BL.find_edges(fill.transform(x.where(~held)), filled)
        data = BL.pack(fill.transform(spread(x, n)), filled, F.col("label"), edges, held)
        forests = BL.forest(data, range(len(filled)), most, deepest, least)
        metrics[fold] = BL.recalls(data, forests, [(least.index(t["minInstancesPerNode"]), t["numTrees"], t["maxDepth"]) for t in trials])
    return metrics


def _ranked_trials(spark: SparkSession, trials: Sequence[dict], metrics: np.ndarray) -> DataFrame:
    rows = [(i, json.dumps(t, sort_keys=True), float(m)) for i, (t, m) in enumerate(zip(trials, metrics.mean(axis=0)))]
    ranked = sorted(rows, key=lambda r: (-r[2], r[0]))
    rank = {r[0]: i + 1 for i, r in enumerate(ranked)}
    return spark.createDataFrame([(*r, rank[r[0]]) for r in rows],
                                 "trial int, params string, mean_recall double, rank int")


# -------------------------------------------------------------------- J23: permutation importance
def _coprime_multipliers(n: int, count: int, seed: int) -> list[int]:
    """``count`` distinct multipliers coprime to ``n`` (each defines a permutation of 0..n-1)."""
    from math import gcd
    rng = random.Random(seed)
    out: list[int] = []
    while len(out) < count:
        a = rng.randrange(1, max(2, n)) if n > 2 else 1
        if gcd(a, n) == 1 and (a not in out or n <= 2):
            out.append(a)
    return out


def permuted_copies(df: DataFrame, key: str, features: Sequence[str], seed: int = 42) -> DataFrame:
    """``df`` once unchanged (``_feature = ''``) plus one copy per feature whose values are
    permuted across rows; every other column stays in place.

    One exact hash rank orders the rows; feature ``f`` moves the value at rank ``s`` to the rank ``r`` with
    ``(a_f * r + b_f) mod n = s`` (``a_f`` coprime to ``n``: a bijection).  Only the n x F values travel, each to
    its new rank, where they meet the row as one array; the copies are made there, without a shuffle of rows.
    """
    from .splits import hash_rank
    feats = list(features)
    ranked = hash_rank(df, key, [], seed, rank_col="_r").withColumn("_r", F.col("_r") - 1).checkpoint()
    n = ranked.count()
    if n == 0:
        return ranked.drop("_r", "_stratum_n").withColumn("_feature", F.lit(""))
    mult = _coprime_multipliers(n, len(feats), seed)
    rng = random.Random(seed + 1)
    shift = [rng.randrange(n) for _ in feats]
    back = [pow(a, -1, n) if n > 1 else 0 for a in mult]  # the rank that takes the value of rank s is back * (s - shift)
    values = ranked.select(F.explode(F.array(*[F.struct(
        _affine(F.col("_r"), i, -i * b % n, n).alias("_to"), F.lit(j).alias("_j"), F.col(f).cast("double").alias("_v"))
        for j, (f, i, b) in enumerate(zip(feats, back, shift))])).alias("_m")).select("_m.*")
    taken = values.groupBy("_to").agg(F.transform(F.sort_array(F.collect_list(F.struct("_j", "_v"))), lambda m: m["_v"]).alias("_new"))
    rows = ranked.join(taken, F.col("_r") == F.col("_to"))
    copies = rows.withColumn("_j", F.explode(F.sequence(F.lit(-1), F.lit(len(feats) - 1))))
    changed = {f: F.when(F.col("_j") == j, F.get("_new", F.lit(j))).otherwise(F.col(f).cast("double")) for j, f in enumerate(feats)}
    names = F.element_at(F.array(F.lit(""), *[F.lit(f) for f in feats]), F.col("_j") + 2)
    return copies.withColumns(changed).withColumn("_feature", names).select(*df.columns, "_feature")


def _affine(r, a: int, b: int, n: int):
    """(r * a + b) mod n without overflow: decimal(38) holds the product of two 18-digit longs."""
    wide = r.cast("decimal(19,0)") * F.lit(a).cast("decimal(19,0)") + F.lit(b).cast("decimal(19,0)")
    return F.pmod(wide, F.lit(n).cast("decimal(19,0)")).cast("long")


def permutation_importance(spark: SparkSession, bundle: Bundle, df: DataFrame, key: str,
                           features: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """J23 (re-aimed): AUC drop when one feature is permuted, plus its share of the total drop.

    All copies are scored in one job and their AUCs come from one grouped AUC
    pass.  Returns (feature, importance, share_pct).
    """
    from . import metrics as M
    from .aggregates import importance_share
    feats = list(features or bundle.features)
    scored = bundle.transform(permuted_copies(df, key, feats, seed)).select(
        "_feature", "p", F.col(bundle.label).alias("y"))
    auc = M.roc_auc(scored, "p", "y", ["_feature"])
    # one row per feature: the base AUC reaches every row through a window over that small table
    base = F.max(F.when(F.col("_feature") == "", F.col("roc_auc"))).over(Window.partitionBy())
    imp = auc.withColumn("_base", base).filter(F.col("_feature") != "").select(
        F.col("_feature").alias("feature"), (F.col("_base") - F.col("roc_auc")).alias("importance"))
    return imp.join(importance_share(imp, "feature", "importance"), "feature").select(
        "feature", "importance", "share_pct")
