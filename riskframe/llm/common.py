"""Helpers shared by the operators of this package."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(col, UPPER, LOWER)


def held_out(id_col: str, folds: int) -> Column:
    """True for the fold whose crc32 of the id as text is 0 modulo ``folds`` (a null id counts as '')."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the shared folder and read it back: cuts the lineage, survives lost executors
    and lets several consumers read the same rows without computing them again."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts reach Python in batches of ``rows`` instead of Spark's default 10,000, so a worker holds some
    megabytes of them. A setting of the cluster's own is kept."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(rows))


def with_arrow(df: DataFrame, fn, added: str, names: list[str] | None = None) -> DataFrame:
    """``df`` with the columns ``added`` (DDL) that ``fn(batch) -> list of Arrow arrays`` makes of each record batch.
    The other columns pass as they are, whatever their types, names or nulls."""
    small_batches(df.sparkSession)
    columns = df.columns
    flat = df.toDF(*[f"c{i}" for i in range(len(columns))])  # own names: the input's may clash or repeat
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in flat.schema.fields)
    names = names or [part.split()[0] for part in added.split(",")]

    def run(batches):
        for batch in batches:
            new = fn(batch.rename_columns(columns))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    out = flat.mapInArrow(run, f"{schema}, {added}" if schema else added)
    return out.toDF(*columns, *names)


def strings(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null is ''."""
    return [t or "" for t in column.to_pylist()]
