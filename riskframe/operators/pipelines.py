"""Model builds as Spark ML pipelines of own stages that save and load (J40 with J14, B10, B17, F5, J10, J21).

A build is a ``Pipeline``: label rule, feature rule, removal of leaking columns, selection with its fallback, a calibrated
classifier and a threshold.  The input carries a boolean column (``is_test``); selection, oversampling and fits see the
other rows alone, the threshold is picked on the marked ones.  Oversampling happens inside the classifier's fit, so a
fitted pipeline never adds rows.  ``PipelineModel.save`` keeps everything that scoring needs.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable,
                             MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .features import feat_anxiety, feat_hybrid
from .isotonic import IsotonicMap
from .labels import hybrid_label
from .metrics import pick_threshold, threshold_sweep
from .prep import MedianImputer, spread
from .schema import feature_views, purge_leaks
from .selection import consensus_with_fallback, equal_width_bins, mutual_info, top_k
from .shap import forest_shap
from .train import Bundle, calibrated_transform, fold_calibrated, recursive_elimination

#: Row rules by name: label, composites and views of a build.
RULES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "hybrid_label": lambda df: hybrid_label(df, jitter=True),
    "hybrid_features": feat_hybrid,
    "anxiety_label": lambda df: df.withColumn("RiskCategory", (F.col("GAD7") >= 10).cast("int")),
    "anxiety_features": feat_anxiety,
    "view_without_diagnostics": lambda df: feature_views(df, "RiskCategory")[1],
}


class _Configured(Params):
    """A stage with one parameter, its settings as JSON."""

    def __init__(self, **settings):
        super().__init__()
        self.settings_json = Param(self, "settings_json", "settings of the stage as JSON", TypeConverters.toString)
        self._set(settings_json=json.dumps(settings))

    @property
    def settings(self) -> dict:
        return json.loads(self.getOrDefault("settings_json"))


class RowRules(_Configured, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Applies the named :data:`RULES` in order, then drops the listed columns."""

    def _transform(self, df: DataFrame) -> DataFrame:
        for name in self.settings["rules"]:
            df = RULES[name](df)
        return purge_leaks(df, self.settings.get("purge", []))


class SelectionModel(_Configured, Model, DefaultParamsReadable, DefaultParamsWritable):
    """Checks that the selected features are there (B17); other columns stay for reports."""

    @property
    def features(self) -> list[str]:
        return self.settings["features"]

    def _transform(self, df: DataFrame) -> DataFrame:
        missing = [c for c in self.features if c not in df.columns]
        if missing:
            raise ValueError(f"selected features are missing: {missing}")
        return df


class Selection(_Configured, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Features in at least two of three lists: mutual information (its ``k`` best), recursive elimination (``n_select``) and
    a forest's mean absolute Shapley values (the ``k`` best); where fewer than ``min_size`` agree, those of mutual information,
    best first."""

    def _fit(self, df: DataFrame) -> SelectionModel:
        s = self.settings
        train = df.where(~F.col(s["test"]))
        candidates = [c for c in s["candidates"] if c in df.columns]
        binned = equal_width_bins(train, candidates).select(*candidates, s["label"]).checkpoint()
        best = top_k(mutual_info(binned, candidates, s["label"]), s["k"]).select("feature").checkpoint()
        ranked = recursive_elimination(df.sparkSession, train, candidates, s["label"], s["n_select"], s.get("step", 1), **s.get("forest", {}))
        shaps = forest_shap(df.sparkSession, train, candidates, s["label"], **s.get("forest", {}))
        lists = best.select("feature", F.lit("mi").alias("list_id")).unionByName(
            ranked.where("selected").select("feature", F.lit("rfe").alias("list_id"))).unionByName(
            top_k(shaps, s["k"], "shap").select("feature", F.lit("shap").alias("list_id")))
        return SelectionModel(features=consensus_with_fallback(lists, best, 2, s["min_size"]))


class _MembersWriter(MLWriter):
    def __init__(self, instance: "CalibratedModel"):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        spark = SparkSession.active()
        DefaultParamsWriter.saveMetadata(self.instance, path, spark)
        for i, (b, iso) in enumerate(self.instance.members):
            b.save(spark, f"{path}/member_{i}")
            iso.save(f"{path}/calibrator_{i}")


class _MembersReader(MLReader):
    def load(self, path: str) -> "CalibratedModel":
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = CalibratedModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.members = [(Bundle.load(spark, f"{path}/member_{i}"), IsotonicMap.load(spark, f"{path}/calibrator_{i}"))
                         for i in range(model.settings["members"])]
        return model


class CalibratedModel(_Configured, Model, MLWritable, MLReadable):
    """Mean of the fold members' calibrated probabilities, as column ``p``."""

    members: list

    def _transform(self, df: DataFrame) -> DataFrame:
        return calibrated_transform(df, self.members)

    def write(self) -> MLWriter:
        return _MembersWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _MembersReader()


class CalibratedClassifier(_Configured, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """J21 (and J10): base models on folds of the training rows with an isotonic map each.  With ``oversample`` the training
    rows are balanced by SMOTE first, on median-filled features; only fitting does that."""

    def _fit(self, df: DataFrame) -> CalibratedModel:
        from .sampling import smote
        s = self.settings
        features, key, label = s["features"], s["key"], s["label"]
        train = df.where(~F.col(s["test"])).select(key, label, *features)
        if s.get("oversample"):
            filled = MedianImputer(features).fit(train).transform(train)
            rows = filled.select(F.col(key).alias("id"), label, F.array(*[F.col(c).cast("double") for c in features]).alias("vec"))
            more = smote(rows, "id", "vec", label)
            train = more.select(F.col("id").alias(key), label, *[F.col("vec")[i].alias(c) for i, c in enumerate(features)])
        train = train.checkpoint()
        even = spread(train, train.count())
        train = train if even is train else even.checkpoint()
        members = fold_calibrated(train, lambda: Bundle(s["name"], list(features), label, s["kind"], params=s.get("params", {})),
                                  key, s["folds"])
        model = CalibratedModel(members=len(members), features=list(features))
        model.members = members
        return model


class ThresholdModel(_Configured, Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``needs_attention``: p at or above the picked threshold."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("needs_attention", (F.col("p") >= self.settings["threshold"]).cast("int"))


class Threshold(_Configured, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """The threshold of the sweep by the recall and false-positive rule on the marked rows; ``default`` if no
    threshold reaches the recall."""

    def _fit(self, df: DataFrame) -> ThresholdModel:
        s = self.settings
        held = df.where(F.col(s["test"])).select("p", F.col(s["label"]).cast("int").alias("y"))
        row = pick_threshold(threshold_sweep(held, s["sweep"]), s["min_recall"], s["max_fpr"]).first()
        found = row is not None and row["threshold"] is not None
        return ThresholdModel(threshold=float(row["threshold"]) if found else s["default"], rule=row["rule"] if found else "none")


def build(df: DataFrame, name: str, rules: list[str], candidates: list[str], purge: list[str], key: str = "rec_id",
          label: str = "RiskCategory", test: str = "is_test", kind: str = "logreg", select: bool = True, k: int = 15,
          n_select: int = 12, min_size: int = 10, step: int = 1, folds: int = 5, oversample: bool = True,
          sweep: tuple = (0.25, 0.35, 0.45, 0.55, 0.65, 0.75, 0.85, 0.95), forest: dict | None = None, **params):
    """The fitted pipeline of a build.  The rows after the rules are written once, since every stage reads them."""
    from pyspark.ml import PipelineModel
    spark = df.sparkSession
    first = RowRules(rules=rules, purge=purge)
    path = scratch_path(spark, "build-rows")
    first.transform(df).write.parquet(path)
    rows = spark.read.parquet(path)
    stages: list[Transformer] = [first]
    features = [c for c in candidates if c in rows.columns]
    if select:
        chosen = Selection(candidates=candidates, label=label, test=test, k=k, n_select=n_select, min_size=min_size, step=step,
                           forest=forest or {}).fit(rows)
        features = chosen.features
        stages.append(chosen)
    classifier = CalibratedClassifier(name=name, features=features, key=key, label=label, test=test, kind=kind, folds=folds,
                                      oversample=oversample, params=params).fit(rows)
    path = scratch_path(spark, "build-scored")
    classifier.transform(rows.where(F.col(test))).write.parquet(path)
    threshold = Threshold(label=label, test=test, sweep=list(sweep), min_recall=0.70, max_fpr=0.25, default=0.5).fit(spark.read.parquet(path))
    return PipelineModel([*stages, classifier, threshold])
