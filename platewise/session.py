"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC wall clock (prediction timestamps are UTC),
# adaptive execution for runtime re-planning (partition coalescing, skew-join
# splitting, broadcast conversion from measured shuffle sizes).
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


# Set only when this module builds the session (core settings are fixed once
# the context runs): checkpoint files of DataFrames that are no longer
# referenced are removed by the context cleaner instead of piling up in the
# shared folder.
_STATIC_DEFAULTS = {
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "platewise") -> SparkSession:
    """Return the active session, or build one with the defaults above.

    On a cluster the session already exists (spark-submit); only local runs
    and tests build one here.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        for k, v in _DEFAULTS.items():
            if k != "spark.sql.sources.partitionOverwriteMode" or not active.conf.get(k, None):
                active.conf.set(k, v)
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in {**_DEFAULTS, **_STATIC_DEFAULTS}.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_CHECKPOINT_DIRS: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only when the setting is unset (local runs, tests) a fresh local folder
    is created and registered with the SparkContext (the setting itself is a
    core config that cannot change at run time); on a cluster the configured
    shared path is used.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured
    key = sc.applicationId
    if key not in _LOCAL_CHECKPOINT_DIRS:
        existing = sc.getCheckpointDir()
        if existing:
            _LOCAL_CHECKPOINT_DIRS[key] = existing
        elif not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        else:
            local = tempfile.mkdtemp(prefix="platewise-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
            sc.setCheckpointDir(local)
            _LOCAL_CHECKPOINT_DIRS[key] = local
    return _LOCAL_CHECKPOINT_DIRS[key]


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate files under the shared checkpoint
    folder (never a machine-local temp dir on a cluster)."""
    import uuid
    return os.path.join(checkpoint_dir(spark), "scratch", f"{name}-{uuid.uuid4().hex[:12]}")


def cut_lineage(df):
    """Materialise ``df`` in the shared checkpoint folder and return a
    DataFrame that reads it back (reliable ``checkpoint``, never the
    executor-local variant): used where one intermediate result feeds
    several branches of a flow."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
