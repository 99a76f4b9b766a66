"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

# Defaults for a local test session.  On a cluster the submitter's settings win:
# ``builder.config`` only fills what ``getOrCreate`` does not already have.
LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.driver.memory": "8g",
}

# Wide projections (the ~150-column survey pool) generate stage methods larger than
# the JVM's JIT limit (8,000 bytes of bytecode): they would run interpreted.  With
# this limit Spark falls back to split, JIT-compilable projections instead.
TUNING = {"spark.sql.codegen.hugeMethodLimit": ("65535", "8000")}


def get_session(master: str | None = None, app_name: str = "riskframe", **conf) -> SparkSession:
    """Return the active session or build a local one with test defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    builder = builder.master(master or os.environ.get("RISKFRAME_MASTER", "local[8]"))
    for key, value in {**LOCAL_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    tune_session(spark)
    return spark


def tune_session(spark: SparkSession) -> None:
    """Apply :data:`TUNING` only where the session still has Spark's default value
    (an explicit cluster setting always wins)."""
    for key, (default, value) in TUNING.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting is always used when present; a folder of our own is
    only chosen when the session has none (local tests).
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not conf_dir:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        conf_dir = fallback or os.path.join("/tmp", "riskframe-checkpoints")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    spark.sparkContext.setCheckpointDir(conf_dir)
    return conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh table path under the shared checkpoint folder (never machine-local)."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/riskframe/{name}-{uuid.uuid4().hex[:12]}"
