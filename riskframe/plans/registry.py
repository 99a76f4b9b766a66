"""Query registry: one entry per operator key, with its DuckDB oracle SQL.

Every query takes ``(spark, sf_dir)`` and reads the given tables (or data
Spark derives from them), so its work grows with the tables.  Oracle SQL
strings are wrapped with casts generated from the Spark output schema
(``oracle_manifest.json``) so both engines return the same column types, and
doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = os.path.join(os.path.dirname(__file__), "oracle_manifest.json")
ROUND_DIGITS = 6
SCALE = float(10 ** ROUND_DIGITS)


@dataclass
class Entry:
    key: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        if key in REGISTRY:
            raise ValueError(f"duplicate query key {key}")
        REGISTRY[key] = Entry(key, fn, sql)
        return fn
    return deco


def normalize(df: DataFrame) -> DataFrame:
    """Round doubles (and floats/decimals) to 6 places; NaN becomes NULL."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            x = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
            # floor(x*1e6 + 0.5)/1e6 is plain IEEE arithmetic, bit-identical in any engine
            c = F.when(F.abs(x) < 1e12, F.floor(x * SCALE + 0.5) / SCALE).otherwise(x)
        out.append(c.alias(f.name))
    return df.select(*out)


_DUCK_TYPES = {
    "long": "BIGINT", "integer": "INTEGER", "short": "SMALLINT", "byte": "TINYINT",
    "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE", "float": "DOUBLE", "date": "DATE",
}


def _wrap_sql(sql: str, schema: list[list[str]]) -> str:
    cols = []
    for name, typ in schema:
        q = f'"{name}"'
        if typ in ("double", "float") or typ.startswith("decimal"):
            d = f"CAST({q} AS DOUBLE)"
            x = f"(CASE WHEN isnan({d}) THEN NULL ELSE {d} END)"
            cols.append(f"(CASE WHEN abs({x}) < 1e12 THEN floor({x} * {SCALE} + 0.5) / {SCALE} ELSE {x} END) AS {q}")
        elif typ in _DUCK_TYPES:
            cols.append(f"CAST({q} AS {_DUCK_TYPES[typ]}) AS {q}")
        else:
            cols.append(q)
    body = sql.strip().rstrip(";")
    return f"SELECT {', '.join(cols)} FROM (\n{body}\n) AS q"


def load_manifest() -> dict:
    if os.path.exists(MANIFEST):
        with open(MANIFEST) as fh:
            return json.load(fh)
    return {}


def oracle_sql_map() -> dict[str, str]:
    manifest = load_manifest()
    out = {}
    for key, e in REGISTRY.items():
        if e.sql is None:
            continue
        schema = manifest.get(key)
        out[key] = _wrap_sql(e.sql, schema) if schema else e.sql
    return out


def query_map() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from ..session import ensure_checkpoint_dir, tune_session
            ensure_checkpoint_dir(spark)
            tune_session(spark)
            return normalize(fn(spark, sf_dir))
        run.__name__ = getattr(fn, "__name__", "query")
        return run
    return {k: wrap(e.fn) for k, e in REGISTRY.items()}
