"""Mapping configs (A5): JSON entries, checked and compiled to column expressions.

An entry names its source and path and tells how its columns become the common ones.  Everything is checked against the
columns that are there before a row is read: unknown settings, unknown rules, items or rules over absent columns and SQL
that does not parse are errors that name the source and the setting.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import word_or_number
from ..functions.exprs import coerce_numeric
from ..functions.maps import HOLDOUT_SOURCES
from ..operators.schema import rename_map, tag_source
from .files import SourceSpec, path_exists, read_source
from .json_arrays import read_json_arrays

SETTINGS = {"source_name", "path", "fmt", "header", "positions", "column_map", "numeric", "multiline", "schema", "words", "items",
            "scaling", "target_rule"}


class MappingError(ValueError):
    """A config entry that cannot be compiled."""


@dataclass
class CompiledSource:
    """One entry: how to read it, and its columns as expressions over the renamed ones, step by step."""

    spec: SourceSpec
    schema: str | None = None
    steps: list[tuple[str, str, Callable[[DataFrame], Column]]] = field(default_factory=list)

    def read(self, spark: SparkSession) -> DataFrame:
        if self.schema:  # a JSON array file, read in parts
            df = read_json_arrays(spark, self.spec.path, self.schema)
            return tag_source(rename_map(df, self.spec.column_map), self.spec.name)
        return read_source(spark, self.spec)

    def apply(self, df: DataFrame) -> DataFrame:
        """The steps in order: words, items, scaling, target.  A step whose columns are absent raises."""
        for setting, name, make in self.steps:
            try:
                df = df.withColumn(name, make(df))
            except PySparkException as e:
                raise MappingError(f"{self.spec.name}: {setting} of {name}: {e.getCondition() or e}") from e
        return df


def _need(df: DataFrame, columns: list[str], source: str, setting: str) -> None:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise MappingError(f"{source}: {setting}: no column {', '.join(absent)}")


def compile_entry(entry: Mapping) -> CompiledSource:
    """An entry of a mapping config.

    ``words`` {column: {word: number}} maps trimmed words regardless of case and keeps numbers; ``items`` {column: {sum:
    [columns], clip: [low, high]}} adds answers up, missing ones as 0; ``scaling`` {column: factor}; ``target_rule`` is SQL
    over the renamed columns, whose truth is RiskCategory 1, anything else 0."""
    name = entry.get("source_name")
    if not name or not entry.get("path"):
        raise MappingError(f"{name}: source_name and path are needed")
    unknown = sorted(set(entry) - SETTINGS)
    if unknown:
        raise MappingError(f"{name}: unknown setting {', '.join(unknown)}")
    out = CompiledSource(SourceSpec.from_dict(dict(entry)), entry.get("schema"))

    def words(column: str, table: Mapping):
        def make(df: DataFrame) -> Column:
            _need(df, [column], name, "words")
            return word_or_number(F.col(column).cast("string"), dict(table))
        return make

    def items(rule: Mapping):
        def make(df: DataFrame) -> Column:
            _need(df, list(rule["sum"]), name, "items")
            total = sum((F.coalesce(coerce_numeric(F.col(c)), F.lit(0.0)) for c in rule["sum"]), F.lit(0.0))
            low, high = rule.get("clip", (None, None))
            total = total if low is None else F.greatest(total, F.lit(float(low)))
            return total if high is None else F.least(total, F.lit(float(high)))
        return make

    def scaled(column: str, factor: float):
        def make(df: DataFrame) -> Column:
            _need(df, [column], name, "scaling")
            return coerce_numeric(F.col(column)) * F.lit(float(factor))
        return make

    for column, table in entry.get("words", {}).items():
        out.steps.append(("words", column, words(column, table)))
    for column, rule in entry.get("items", {}).items():
        if set(rule) - {"sum", "clip"} or not rule.get("sum"):
            raise MappingError(f"{name}: items of {column}: sum and clip are known")
        out.steps.append(("items", column, items(rule)))
    for column, factor in entry.get("scaling", {}).items():
        out.steps.append(("scaling", column, scaled(column, factor)))
    if rule := entry.get("target_rule"):
        out.steps.append(("target_rule", "RiskCategory", lambda df: F.coalesce(F.expr(f"({rule})").cast("boolean"), F.lit(False)).cast("int")))
    return out


def compile_config(config: str | Mapping) -> tuple[list[str], list[CompiledSource]]:
    """(common columns, compiled sources) of a config text or object {common_features, sources}; names are unique."""
    plain = json.loads(config) if isinstance(config, str) else config
    unknown = sorted(set(plain) - {"common_features", "sources"})
    if unknown:
        raise MappingError(f"unknown setting {', '.join(unknown)}")
    sources = [compile_entry(e) for e in plain["sources"]]
    names = [s.spec.name for s in sources]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise MappingError(f"source {', '.join(twice)} is named twice")
    return list(plain["common_features"]), sources


def unify(spark: SparkSession, configs: list, exclude=HOLDOUT_SOURCES) -> tuple[DataFrame | None, DataFrame]:
    """All present sources of the configs under the union of their common columns, RiskCategory and DatasetSource, and
    the table of skipped ones.  Numbers become double; columns that a source lacks are NULL."""
    common: list[str] = []
    compiled: list[CompiledSource] = []
    for config in configs:
        features, sources = compile_config(config)
        common += [c for c in features if c not in common]
        compiled += sources
    skipped, frames = [], []
    for source in compiled:
        reason = "excluded" if source.spec.name in exclude else None if path_exists(spark, source.spec.path) else "absent"
        if reason:
            skipped.append((source.spec.name, source.spec.path, reason))
            continue
        df = source.apply(source.read(spark))
        cells = [coerce_numeric(F.col(c)).alias(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in common]
        risk = F.col("RiskCategory").cast("int") if "RiskCategory" in df.columns else F.lit(None).cast("int")
        frames.append(df.select(*cells, risk.alias("RiskCategory"), "DatasetSource"))
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    return out, spark.createDataFrame(skipped, "source string, path string, reason string")
