"""Session helper: UTC, AQE with skew handling, Arrow for the few grouped-pandas operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",   # keyed state
}
STATIC_CONF = {
    "spark.python.sql.dataFrameDebugging.enabled": "false",     # call-site capture doubles plan-building time
}


def build_session(app: str = "keelson", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **STATIC_CONF, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime options every operator relies on (safe to call on a session made elsewhere)."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value and spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Directory for checkpoint(): the one the cluster names, or a local one where none is set (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative jobs on a cluster")
    path = os.path.join(tempfile.mkdtemp(prefix="keelson-"), "checkpoints")
    sc.setCheckpointDir(path)
    return path


def materialise(df):
    """Compute a frame that several branches read once, and cut its lineage through the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


_SHARED: dict[tuple[str, str], object] = {}


def shared(spark: SparkSession, key: str, build):
    """Result of build(), made once per application and reused by later queries (tables are checkpointed by the builder).

    For intermediate tables many queries start from, such as the feature dataset; an output a query is measured on is not shared.
    """
    slot = (spark.sparkContext.applicationId, key)
    if slot not in _SHARED:
        _SHARED[slot] = build()
    return _SHARED[slot]
