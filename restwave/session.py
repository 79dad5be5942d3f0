"""Session settings and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

_local_scratch: str | None = None


def build_session(app: str = "restwave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every plan relies on; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Pin the session zone: stored instants are UTC and no operator depends on another zone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def scratch_uri(spark: SparkSession, label: str) -> str:
    """A new directory name under the cluster's shared scratch folder.

    The folder is the session's `spark.checkpoint.dir`. A machine-local folder is used only
    where that is unset and the session itself is local (tests).
    """
    global _local_scratch
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        if _local_scratch is None:
            _local_scratch = "file:" + tempfile.mkdtemp(prefix="restwave-")
        root = _local_scratch
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
