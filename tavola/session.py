"""SparkSession settings the queries rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings every query depends on for correct results.
#  - UTC session zone: month bucketing (OQ7) and date parsing at ingest.
#  - ANSI on: arithmetic overflow raises; the queries use try_* where SQL
#    semantics want NULL (division by zero, unparsable text).
_REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

# Runtime settings for scale: re-planning at stage boundaries, partition
# coalescing, skew splitting and runtime broadcast conversion. Applied only
# to keys the submitted configuration does not set, so a cluster's own
# values win.
_SCALE_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
}

# On a cluster the per-restaurant shuffles and full sorts start with many small
# partitions, which adaptive execution joins to the advisory size.
_CLUSTER_DEFAULTS = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": "4000"}
_DONE = "tavola.configured"

# Static settings for a session this module starts itself (local runs, tests).
_LOCAL_STATIC = {
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, app_name: str = "tavola",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    """Return a session with the settings the queries need.

    ``master`` and ``shuffle_partitions`` are for local runs and tests; on a
    cluster leave them unset so the submitted configuration is kept.
    """
    extra = dict(extra or {})
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        for key, value in _LOCAL_STATIC.items():
            builder = builder.config(key, value)
    if shuffle_partitions:
        extra["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in extra.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on, and the scale defaults the submitted
    configuration leaves unset. No folder is made: a job that cuts its lineage
    uses the cluster's ``spark.checkpoint.dir`` or a path it is given."""
    for key, value in _REQUIRED.items():
        spark.conf.set(key, value)
    if spark.conf.get(_DONE, None) is None:  # once a session: later settings of the user's stay
        submitted = spark.sparkContext.getConf()
        defaults = _SCALE_DEFAULTS if submitted.get("spark.master", "local").startswith("local") else _SCALE_DEFAULTS | _CLUSTER_DEFAULTS
        for key, value in defaults.items():
            if not submitted.contains(key):
                spark.conf.set(key, value)
        spark.conf.set(_DONE, "true")
    checkpoint = spark.conf.get("spark.checkpoint.dir", None)
    if checkpoint and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a session that runs in one process (``local``: tests) and has none
    gets a temporary one; anywhere else its absence is an error.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tavola-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")
